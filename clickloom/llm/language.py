"""Language identification with unigram pieces, summing over all segmentations of every word.

Each language has a probability for every piece of a fixed public vocabulary (a ``.tiktoken`` rank
file, whose pieces are byte strings and include every single byte). A word's probability is the sum
over all ways to cut it into pieces, of any length, of the product of their probabilities: the forward
algorithm, run on many words of one length and all languages at once; words of over ``SHORT`` bytes go
one by one in logarithms, whatever their length. Probabilities are fitted by expectation maximisation,
which needs the same sums from both ends: the tasks of a Spark job return expected piece counts per
language, as many rows as pieces and languages, and the driver holds only those.

Training reads about ``PER_LANGUAGE`` documents of each language, chosen by a hash of the id, and
merges them to counts of distinct words. Texts are scored whole; distinct words of a batch are
scored once and a text adds up its words. The score is the probability of the best language
under equal priors.

Defined cases: a null text, or one without letters, is ``und`` with score 0; ties go to the language
first by code point; a null lang is not trained on; with nothing to train on, every text is ``und``;
a null doc_id is held out of training; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work

PER_LANGUAGE = 4_000  # documents of one language used for training, about
ROUNDS = 4  # of expectation maximisation
SHORT = 40  # bytes of a word whose sums still are ordinary numbers; longer ones are summed in logarithms
CELLS = 4_000_000  # sums held at once: words x bytes x languages
FLOOR = 1e-7  # least probability of a single byte
UNKNOWN = "und"
_CACHE = 300_000  # words a task remembers
_LETTERS = re.compile(rf"(?:[^\W\d_]+[{work.MARKS}]*)+")
_MARK = re.compile(rf"[{work.MARKS}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file that can stand in a lower-cased word."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in found if len(p) == 1 or re.fullmatch(rb" ?[a-z\x80-\xff]+", p)]


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters with their marks."""
    return _LETTERS.findall((text or "").lower())


class Pieces:
    """The vocabulary, found by 64-bit hashes of byte strings (many at once) or by the strings."""

    def __init__(self, pieces: list[bytes]):
        hashed = sorted((_hash(p), p) for p in set(pieces))
        self.keys = np.array([h for h, _ in hashed], np.uint64)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        self.single = np.array([len(p) == 1 for _, p in hashed])
        self.place = {p: i for i, (_, p) in enumerate(hashed)}
        self.lengths = sorted({len(p) for p in self.place})

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or ``len(self)`` for none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) % (1 << 64)
    return h


def marked(word: str) -> bytes:
    """The word's bytes after a word mark (a blank)."""
    return b" " + word.encode("utf-8", "surrogatepass")


def lattices(pieces: Pieces, some: list[bytes], languages: int = 1) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
    """Short words by length, in blocks: (their places, length, {(end, piece length): piece numbers})."""
    lengths = np.array([len(c) for c in some])
    for n in np.unique(lengths[lengths <= SHORT]):
        all_ = np.flatnonzero(lengths == n)
        step = max(1, CELLS // (languages * (n + 1)))
        for where in (all_[at : at + step] for at in range(0, len(all_), step)):
            grid = np.frombuffer(b"".join(some[i] for i in where), np.uint8).reshape(-1, n)
            # Hashes of all beginnings give those of all parts.
            begins, power = [np.zeros(len(where), np.uint64)], [np.uint64(pow(int(_BASE), i, 1 << 64)) for i in range(n + 1)]
            for i in range(n):
                begins.append(begins[-1] * _BASE + grid[:, i] + np.uint64(1))
            found = {}
            for end in range(1, n + 1):
                for size in pieces.lengths:
                    if size > end:
                        break
                    ids = pieces.find(begins[end] - begins[end - size] * power[size])
                    if (ids < len(pieces)).any():
                        found[end, size] = ids
            yield where, int(n), found


def forward(n: int, found: dict, probability: np.ndarray, rows: int) -> np.ndarray:
    """Sums over all segmentations of each beginning: (rows, n + 1, languages)."""
    sums = np.zeros((rows, n + 1, probability.shape[1]))
    sums[:, 0] = 1
    for (end, size), ids in found.items():
        sums[:, end] += sums[:, end - size] * probability[ids]
    return sums


def _uses(pieces: Pieces, raw: bytes) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(end, [(begin, piece number)]) of a long word, end by end."""
    get, lengths = pieces.place.get, pieces.lengths
    for end in range(1, len(raw) + 1):
        yield end, [(end - size, i) for size in lengths if size <= end and (i := get(raw[end - size : end])) is not None]


def long_score(pieces: Pieces, logs: np.ndarray, raw: bytes) -> np.ndarray:
    """Log probability of a word of any length in each language, from the last columns only."""
    keep = pieces.lengths[-1] + 1
    ring = np.full((keep, logs.shape[1]), -np.inf)
    ring[0] = 0
    for end, uses in _uses(pieces, raw):
        terms = ring[[b % keep for b, _ in uses]] + logs[[i for _, i in uses]]
        top = terms.max(axis=0, initial=-np.inf)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            ring[end % keep] = np.log(np.exp(terms - safe).sum(axis=0)) + safe
    return ring[len(raw) % keep]


def log_scores(pieces: Pieces, probability: np.ndarray, distinct: list[str]) -> np.ndarray:
    """Log probability of each word in each language; ``probability`` ends with a row of zeros."""
    flat = [marked(w) for w in distinct]
    out = np.zeros((len(distinct), probability.shape[1]))
    with np.errstate(divide="ignore"):
        for where, n, found in lattices(pieces, flat, probability.shape[1]):
            out[where] = np.log(forward(n, found, probability, len(where))[:, n])
        long = [i for i, raw in enumerate(flat) if len(raw) > SHORT]
        logs = np.log(probability) if long else None
    for i in long:
        out[i] = long_score(pieces, logs, flat[i])
    return out


def _long_counts(pieces: Pieces, logs: np.ndarray, raw: bytes) -> dict[int, float]:
    """Expected uses of each piece in a long word, with one language's log probabilities."""
    ends = list(_uses(pieces, raw))
    ahead = np.full(len(raw) + 1, -np.inf)
    behind = ahead.copy()
    ahead[0] = behind[-1] = 0
    for end, uses in ends:
        if uses:
            ahead[end] = np.logaddexp.reduce([ahead[b] + logs[i] for b, i in uses])
    for end, uses in reversed(ends):
        for b, i in uses:
            behind[b] = np.logaddexp(behind[b], behind[end] + logs[i])
    counts: dict[int, float] = {}
    for end, uses in ends:
        for b, i in uses:
            counts[i] = counts.get(i, 0.0) + math.exp(ahead[b] + logs[i] + behind[end] - ahead[-1])
    return counts


def expected_counts(pieces: Pieces, probability: np.ndarray, some: list[bytes], weight: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Expected uses of each piece; each word has a weight and counts for one language (column)."""
    counts = np.zeros((len(pieces) + 1, probability.shape[1]))
    for where, n, found in lattices(pieces, some):
        lang, rows = column[where], np.arange(len(where))
        own = {key: probability[ids, lang] for key, ids in found.items()}
        ahead = np.zeros((len(where), n + 1))
        behind = np.zeros((len(where), n + 1))
        ahead[:, 0] = behind[:, n] = 1
        for (end, size), p in own.items():
            ahead[:, end] += ahead[:, end - size] * p
        for (end, size), p in reversed(own.items()):
            behind[:, end - size] += behind[:, end] * p
        scale = weight[where] / ahead[rows, n]
        for (end, size), ids in found.items():
            np.add.at(counts, (ids, lang), scale * ahead[:, end - size] * own[end, size] * behind[:, end])
    long = [k for k, raw in enumerate(some) if len(raw) > SHORT]
    with np.errstate(divide="ignore"):
        logs = np.log(probability) if long else None
    for k in long:
        for i, n in _long_counts(pieces, logs[:, column[k]], some[k]).items():
            counts[i, column[k]] += weight[k] * n
    return counts[:-1]


# --------------------------------------------------------------------------- training


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows, merged inside each task first."""
    schema, arrow = work.schemas("lang string, word string, n long")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for at in range(0, batch.num_rows, work.SLICE):
                part = batch.slice(at, work.SLICE)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts.setdefault(lang, Counter()).update(words(text))
            yield work.record_batch([(lang, w, n) for lang, c in counts.items() for w, n in c.items()], arrow)

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages and their piece probabilities, small enough to travel with a task."""

    def __init__(self, languages: list[str], vocabulary: list[bytes], probability: np.ndarray):
        self.languages, self.vocabulary, self.probability = languages, vocabulary, probability


def _normalised(counts: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Counts as probabilities with the floor of single bytes and a last row of zeros."""
    p = counts / np.maximum(counts.sum(axis=0), 1e-300)
    p[single] = np.maximum(p[single], FLOOR)
    return np.vstack([p / p.sum(axis=0), np.zeros((1, p.shape[1]))])


def train(docs: DataFrame, vocabulary: list[bytes], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Fit on rows with a lang, text and doc_id; callers choose the rows that may be learnt from."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    counted = work.store(word_counts(work.bounded(usable, ["lang"], per_language, "language")), "words")
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    place = {lang: i for i, lang in enumerate(languages)}
    pieces = Pieces(vocabulary)
    probability = _normalised(np.ones((len(pieces), max(1, len(languages)))), pieces.single)
    schema, arrow = work.schemas("piece int, lang int, n double")
    for _ in range(rounds if languages else 0):
        shared = counted.sparkSession.sparkContext.broadcast(probability)

        def run(batches: Iterator) -> Iterator:
            counts = np.zeros((len(pieces), len(languages)))
            for batch in batches:
                column = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                weight = np.array(batch.column(2).to_pylist(), float)
                counts += expected_counts(pieces, shared.value, [marked(w) for w in batch.column(1).to_pylist()], weight, column)
            ids, lang = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(lang, pa.int32()), pa.array(counts[ids, lang])], schema=arrow)

        rows = counted.select("lang", "word", "n").mapInArrow(run, schema).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(pieces), len(languages)))
        counts[rows["piece"], rows["lang"]] = rows["n"]
        probability = _normalised(counts, pieces.single)
    return Model(languages, vocabulary, probability)


# --------------------------------------------------------------------------- prediction


class Scorer:
    """Scores texts in one task; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            first = len(self.place)
            if first + len(some) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(len(self.table), len(some)), self.table.shape[1]))])
            # A run without letters proper (number signs, fractions) says nothing.
            letters = [w if w.isalpha() else "".join(c for c in w if c.isalpha() or _MARK.match(c)) for w in some]
            scores = log_scores(self.pieces, self.model.probability, letters)
            scores[[not w for w in letters]] = 0
            self.table[first : first + len(some)] = scores
            self.place.update(zip(some, range(first, first + len(some))))

    def __call__(self, texts: list[str | None]) -> list:
        if not self.model.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
        split = [words(t) for t in texts]
        if len(self.place) > _CACHE:
            self._forget()
        self._learn([w for w in set().union(*split) if w not in self.place])
        langs, scores, get = [], [], self.place.__getitem__
        for found in split:
            sums = self.table[np.fromiter(map(get, found), np.int64, len(found))].sum(axis=0)
            if not sums.any():
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(sums.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return [langs, scores]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return work.per_text(docs, lambda: Scorer(shared.value), "lang_pred string, score double")
