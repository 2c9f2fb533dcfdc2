import math
import random

import numpy as np

from clickloom.llm import toxicity
from tests.llm import fixtures


def test_folding():
    assert toxicity.fold("You 1d10t, рathetic! L0SER!! tr4sh (2024) st​upid $cum CLOWN!") == " you idiot pathetic loser trash stupid scum clown "
    assert toxicity.fold(None) == toxicity.fold(" \n1234 !!!") == ""


def test_matching_weights_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " stup": 1.5}, ["idiot proof"])
    match = lexicon.matcher()
    assert [w for _, _, w in match(" you idiot are stupid stup ")] == [2.0, 1.5, 1.5]
    assert match(" an idiot proof tool ") == [] and match(" idiots ") == []
    assert [w for _, _, w in match(" idiot idiot proof idiot ")] == [2.0, 2.0]


def corpus(spark, clean_words="lovely river stone quiet morning people garden window"):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(clean_words.split()) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(3, 60))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["nitwit", "n1twit", "bozоs", "BOZO", "dolt", "zounds" + rng.choice("abcdef")]))
        elif i % 5 == 0:
            words.insert(0, "dolt valley")
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, labels.where("doc_id % 3 <> 1"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    held = [i for i in got if i % 3 == 1]
    right = sum((got[i] >= toxicity.REJECT) == bool(truth[i]) for i in held)
    assert right / len(held) > 0.95
    kept = toxicity.keep_harmless(docs, lexicon)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.REJECT}


def test_awkward_rows(spark):
    docs, labels = fixtures.awkward(spark), fixtures.labels(spark)
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, lexicon).collect()
    assert len(rows) == len(fixtures.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_harmless(docs, lexicon).columns == docs.columns
    only = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r.score < 1e-9 for r in toxicity.score(docs, only).collect()} == {True}
    none = toxicity.learn(fixtures.empty(spark), labels)
    assert toxicity.score(fixtures.empty(spark), none).count() == 0


def plain_measure(lexicon, text):
    """Weight per hundred words and its logarithm, by trying every term and phrase at every word."""
    words = toxicity.fold(text).split()
    found = {}
    for k, word in enumerate(words):
        weights = [w for t, w in lexicon.weights.items() if (word == t.strip() if t.endswith(" ") else word.startswith(t.strip()))]
        pairs = {" ".join(words[k - 1 : k + 1])} if k else set()
        pairs |= {" ".join(words[k : k + 2])} if k + 1 < len(words) else set()
        if weights and not pairs & set(lexicon.phrases):
            terms = [(w, t) for t, w in lexicon.weights.items() if (word == t.strip() if t.endswith(" ") else word.startswith(t.strip()))]
            best, term = max(terms)
            n, _ = found.get(term.strip(), (0, 0))
            found[term.strip()] = n + 1, best
    weight = sum(w * (1 + math.log(n)) for n, w in found.values())
    return (100 * weight / max(20, len(words)), math.log1p(weight)) if weight else (0.0, 0.0)


def test_measure_beside_a_plain_one():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({" grob": 2.0, " dumm ": 3.5, " fies ": 1.25, " widerl": 4.0}, ("sehr dumm", "grober sand"))
    measure = lexicon.features()
    for _ in range(400):
        text = " ".join(rng.choice(["grober", "grob", "dumm", "dummy", "sehr", "sand", "f1es", "widerlich", "haus", "und"]) for _ in range(rng.randint(0, 60)))
        assert np.allclose(measure(text), plain_measure(lexicon, text)), text


def plain_cover(terms, documents, weights, support, depth):
    """Greedy cover that looks at every candidate in every round."""
    left, chosen, free = {k: depth for d in documents for k in d}, [], list(range(len(terms)))
    while free:
        best = max(free, key=lambda i: (len(documents[i] & left.keys()) * weights[i], -len(terms[i]), -i))
        free.remove(best)
        gain = documents[best] & left.keys()
        if len(gain) < support:
            break
        if any(terms[best].rstrip().startswith(terms[i]) for i in chosen):
            continue
        chosen.append(best)
        for k in gain:
            left[k] -= 1
            if not left[k]:
                del left[k]
    return chosen


def test_cover_is_the_plain_greedy_one(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "kmt" for b in ("ara", "olu", "ine") for c in ("s", "tik", "bor")]
    texts = [" ".join(rng.sample(words, rng.randint(1, 6))) for _ in range(120)]
    labelled = spark.createDataFrame([(1, t) for t in texts], "toxic int, text string").coalesce(1)
    own = [toxicity.terms_of(set(t.split())) for t in texts]
    terms = sorted(set().union(*own))
    candidates = [(t, sum(t in o for o in own), 0) for t in terms]
    weights = [rng.uniform(1, 3) for _ in terms]
    documents = [{k for k, o in enumerate(own) if t in o} for t in terms]
    assert toxicity._cover(labelled, candidates, weights) == plain_cover(terms, documents, weights, 5, toxicity.DEPTH)
