"""Toxicity by a weighted lexicon, matched with one Aho-Corasick automaton on folded text.

Folding lower-cases, unifies compatibility forms, maps homoglyphs of other alphabets and digits that
stand for letters to Latin letters, and leaves words between single blanks. Lexicon terms are words
or beginnings of words. The weight of a text is the sum of its terms' weights without those inside
an exception phrase (two neighbouring words in which a term is harmless), repeats counting as one
plus the logarithm of their number; the score is a logistic
function of that weight per word and of its logarithm.

All is learnt from labelled rows: a bounded sample of each class (``PER_CLASS``) chosen by a hash of
the id. Candidates are terms found in many more toxic than clean documents; of those the lexicon
keeps, greedily, the terms that stand in most toxic documents not explained yet (each asks for up to
``DEPTH`` terms), so words that merely stand in copies of one toxic document stay out.

Defined cases: a null or empty text has weight 0 and the score of harmless text; labels with a null
id or class are not learnt from, of contradicting labels of an id the toxic one counts; without
toxic or without clean examples the score is the share of toxic labels, 0 without labels; a null
doc_id stays null; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work

PER_CLASS = 10_000  # labelled documents of a class used for training, about
SUPPORT = 5  # toxic documents, at least, that a term must stand in and explain
SHARE = 0.002  # the same as a share of the toxic documents
DEPTH = 4  # terms that a toxic document asks for before it counts as explained
PURITY = 0.97  # least share of toxic documents among a term's, at equal class sizes
_HELD = 200_000  # terms that a task counts before it passes them on
STEMS = range(4, 9)  # lengths of word beginnings
REJECT = 0.7

# Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
# Digits and signs that stand for letters, inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_GLYPHS = str.maketrans(HOMOGLYPHS | {c: None for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"})
_LETTER = r"[^\W\d_]"
# A word: letters with digits or signs among them; a sign at an edge belongs to the word only before a letter.
_WORD = re.compile(rf"(?:[013457890@$]*{_LETTER}(?:[\w@$!|+]*\w)?)")
_PLAIN = str.maketrans(SUBSTITUTES)


def fold(text: str | None) -> str:
    """Folded words of a text, one blank before, between and after them; empty without words."""
    plain = unicodedata.normalize("NFKC", text or "").lower().translate(_GLYPHS)
    words = _WORD.findall(plain)
    return f" {' '.join(words)} ".translate(_PLAIN) if words else ""


def terms_of(words: set[str]) -> set[str]:
    """Terms that a text with these words has: " word " and the beginnings " wor"."""
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in STEMS:
        out.update(" " + w[:n] for w in words if len(w) >= n)
    return out


class Lexicon:
    """Weighted terms, exception phrases and the logistic function on top."""

    def __init__(self, weights: dict[str, float], phrases: Sequence[str] = (), coefficients: Sequence[float] = (0.0, 0.0, -20.0)):
        self.weights, self.phrases, self.coefficients = dict(weights), tuple(phrases), tuple(coefficients)

    def matcher(self) -> Callable[[str], list[tuple[int, int, float]]]:
        """A function from folded text to (first letter, end, weight) of its terms outside exceptions."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            automaton.add_word(term, (term, weight))
        for phrase in self.phrases:
            if f" {phrase} " not in self.weights:
                automaton.add_word(f" {phrase} ", (f" {phrase} ", None))
        if not len(automaton):
            return lambda folded: []
        automaton.make_automaton()

        def match(folded: str) -> list[tuple[int, int, float]]:
            found, excused = {}, []
            for end, (term, weight) in automaton.iter(folded):
                at = end - len(term) + 2
                if weight is None:
                    excused.append((at, end))
                elif weight > found.get(at, (0, 0.0))[1]:
                    found[at] = (end + 1 if term[-1] != " " else end, weight)
            return [(a, b, w) for a, (b, w) in found.items() if not any(x <= a < y for x, y in excused)]

        return match

    def features(self) -> Callable[[str | None], tuple[float, float]]:
        """A function from text to (weight per hundred words, logarithm of the weight)."""
        match = self.matcher()

        def measure(text: str | None) -> tuple[float, float]:
            folded = fold(text)
            found: dict[str, tuple[int, float]] = {}
            for a, b, w in match(folded):
                n, _ = found.get(folded[a:b], (0, w))
                found[folded[a:b]] = n + 1, w
            # Repeating one word adds ever less.
            weight = sum(w * (1 + math.log(n)) for n, w in found.values())
            return (100 * weight / max(20, folded.count(" ") - 1), math.log1p(weight)) if weight else (0.0, 0.0)

        return measure

    def scorer(self) -> Callable[[list], list]:
        measure, (a, b, c) = self.features(), self.coefficients
        return lambda texts: [[1 / (1 + math.exp(-max(-700.0, min(700.0, a * x + b * y + c)))) for x, y in map(measure, texts)]]


# --------------------------------------------------------------------------- learning


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text) of a bounded number of labelled documents of each class, stored."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = work.store(work.bounded(known, ["toxic"], per_class, "toxicity"), "chosen")
    # Bounded by per_class, so it can go to every task; texts stay where they are.
    return work.store(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text"), "labelled")


def _words(text: str | None) -> set[str]:
    return set(fold(text).split())


def least_support(toxic: int) -> float:
    """Toxic documents that a term must explain: ``SUPPORT``, a share where there are very many."""
    return max(SUPPORT, SHARE * toxic)


def _candidates(labelled: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int]]:
    schema, arrow = work.schemas("term string, toxic long, clean long")

    def counted(counts: tuple[Counter, Counter]):
        return work.record_batch([(t, counts[0][t], counts[1][t]) for t in counts[0].keys() | counts[1].keys()], arrow)

    def run(batches: Iterator) -> Iterator:
        counts = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[0 if label else 1].update(terms_of(_words(text)))
                if len(counts[0]) + len(counts[1]) > _HELD:
                    yield counted(counts)
                    counts = (Counter(), Counter())
        yield counted(counts)

    pure = F.col("toxic") / toxic / (F.col("toxic") / toxic + (F.col("clean") + 0.5) / clean)
    least = least_support(toxic)
    rows = (
        labelled.mapInArrow(run, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least) & (pure >= PURITY)).orderBy(F.desc("toxic"), F.length("term"), "term")
    )
    # The sample is bounded, and so are the terms that stand in several of its documents.
    return [tuple(r) for r in rows.collect()]


def _cover(labelled: DataFrame, candidates: list[tuple[str, int, int]], weights: list[float]) -> list[int]:
    """Places of the candidates that explain most toxic documents, greedily."""
    place = {t: i for i, (t, _, _) in enumerate(candidates)}
    schema, arrow = work.schemas("found array<int>")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield work.record_batch([([place[t] for t in terms_of(_words(x)) if t in place],) for x in batch.column(1).to_pylist()], arrow)

    documents: dict[int, set[int]] = {i: set() for i in place.values()}
    for k, row in enumerate(labelled.where("toxic > 0").mapInArrow(run, schema).collect()):
        for i in row[0]:
            documents[i].add(k)
    open_ = dict.fromkeys(set().union(*documents.values()), DEPTH)
    chosen, least = [], least_support(len(open_))

    def worth(i: int) -> tuple[float, int, int]:
        """Documents gained times the term's weight; of equals the shorter term."""
        return -len(documents[i] & open_.keys()) * weights[i], len(candidates[i][0]), i

    # Worth only falls as documents get explained, so the first term whose worth is up to date is the best.
    heap = [worth(i) for i in documents]
    heapq.heapify(heap)
    while heap:
        best = heapq.heappop(heap)[2]
        now = worth(best)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        gain = documents[best] & open_.keys()
        if len(gain) < least:
            break
        term = candidates[best][0].rstrip()
        if any(term.startswith(candidates[i][0]) for i in chosen):
            continue  # a chosen beginning finds it already
        chosen.append(best)
        for k in gain:
            open_[k] -= 1
            if not open_[k]:
                del open_[k]
    return chosen


def _phrases(labelled: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around terms that stand in clean documents."""
    schema, arrow = work.schemas("phrase string, toxic long, clean long")

    def run(batches: Iterator) -> Iterator:
        match, counts = lexicon.matcher(), (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                around = set()
                for at, _, _ in match(folded):
                    end = folded.index(" ", at)
                    before, after = folded.rfind(" ", 0, at - 1), folded.find(" ", end + 1)
                    if before >= 0:
                        around.add(folded[before + 1 : end])
                    if after >= 0:
                        around.add(folded[at:after])
                counts[0 if label else 1].update(around)
        yield work.record_batch([(p, counts[0][p], counts[1][p]) for p in counts[0].keys() | counts[1].keys()], arrow)

    rows = labelled.mapInArrow(run, schema).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = rows.where((F.col("clean") >= SUPPORT) & (F.col("clean") >= 9 * F.col("toxic")))
    return [r[0] for r in harmless.orderBy(F.desc("clean"), "phrase").collect()]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the classes weigh equally."""
    design = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-2, 1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Lexicon:
    """Lexicon, exceptions and coefficients from labelled documents; callers choose the labels."""
    labelled = sample(docs, labels, per_class)
    sizes = {bool(k): n for k, n in labelled.groupBy(F.col("toxic") > 0).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon({}, (), (0.0, 0.0, 700.0 if toxic else -700.0))
    candidates = _candidates(labelled, toxic, clean)
    odds = [math.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))) for _, a, b in candidates]
    weights = {candidates[i][0]: odds[i] for i in _cover(labelled, candidates, odds)} if candidates else {}
    lexicon = Lexicon(weights, _phrases(labelled, Lexicon(weights)) if weights else ())
    schema, arrow = work.schemas("toxic int, rate double, weight double")

    def run(batches: Iterator) -> Iterator:
        measure = lexicon.features()
        for batch in batches:
            yield work.record_batch([(y, *measure(t)) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], arrow)

    rows = labelled.mapInArrow(run, schema).toPandas()
    beta = _logistic(rows[["rate", "weight"]].to_numpy(float), (rows["toxic"] > 0).to_numpy(float))
    return Lexicon(weights, lexicon.phrases, beta.tolist())


# --------------------------------------------------------------------------- use


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    return work.per_text(docs, lexicon.scorer, "score double")


def keep_harmless(docs: DataFrame, lexicon: Lexicon, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows that score ``reject`` or more."""
    scored = work.text_column(lambda: (lambda run: lambda texts: run(texts)[0])(lexicon.scorer()), "double")
    return docs.where(scored(F.col("text").cast("string")) < reject)
