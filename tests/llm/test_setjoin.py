import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import setjoin
from tests.llm import fixtures


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(5))))


def plain(rows):
    """(doc_id, n, component) by comparing every two distinct sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    root = list(range(len(kinds)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(kinds):
        for j in range(i):
            y = kinds[j]
            if 4 * len(x) <= 5 * len(y) and 4 * len(y) <= 5 * len(x) and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    place, least = {s: find(k) for k, s in enumerate(kinds)}, {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    return Counter((i, len(s), least.get(place[s]) if s else i) for (i, _), s in zip(rows, sets))


def found(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.classes(docs).collect())


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got, expected = found(docs), plain(rows)
    assert got == expected, (list((got - expected).items())[:5], list((expected - got).items())[:5])


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert setjoin.classes(fixtures.empty(spark)).count() == 0


def varied(seed, groups, size, edits, length=60, vocabulary=4_000, center=True):
    """Groups of copies with random edits, with and without their original."""
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = rng.integers(0, vocabulary, length + 7 * (g % 5))
        if center:
            texts.append(base)
        for _ in range(size):
            copy = base.copy()
            for at in rng.integers(0, len(copy), rng.integers(0, edits + 1)):
                copy[at] = rng.integers(0, vocabulary)
            cut = rng.integers(0, 4)
            texts.append(copy[cut:] if rng.random() < 0.3 else copy)
    return [" ".join(f"w{x}" for x in t) for t in texts]


@pytest.mark.parametrize("center", [True, False])
def test_near_copies_beside_brute_force(spark, center, monkeypatch):
    """Links around the bound, chains, heavy edits; small blocks so that whole blocks are skipped."""
    monkeypatch.setattr(setjoin, "BLOCK", 700)
    monkeypatch.setattr(setjoin, "_FEW", 4)
    texts = varied(3, 12, 14, 4, center=center) + varied(4, 6, 3, 2, length=200, center=center)
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"{passage} {t}" for t in varied(9, 30, 1, 1, length=30)]  # a shared passage links nobody by itself
    rows = [(k, t) for k, t in enumerate(texts)] + [(5_000 + k, t) for k, t in enumerate(texts[::7])] + [(None, texts[0]), (None, texts[3]), (3, texts[40]), (3, texts[40])]
    check(spark, rows)


def test_one_group_holds_a_third_and_chains(spark):
    """Every copy differs from the next in one word: one component though its ends have nothing in common."""
    words = [f"c{k}" for k in range(90)]
    chain = []
    for k in range(90):
        words[k] = f"d{k}"
        chain.append(" ".join(words))
    rows = list(enumerate(chain + ["the same text again and again and again here"] * 120 + varied(5, 40, 2, 3)))
    check(spark, rows)


def test_exactly_the_bound(spark):
    """4 of 5 links, 99 of 124 does not; sets of fewer than five words are their own."""
    base = [f"x{k}" for k in range(84)]  # 80 shingles
    texts = [" ".join(base), " ".join(base + [f"y{k}" for k in range(20)]), " ".join(base + [f"z{k}" for k in range(21)]), "One two", "one TWO", "one two three", "one two three four five"]
    check(spark, list(enumerate(texts)))


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.char_length("text") < 30_000)
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_lists_skip_blocks_without_losing_pairs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        k = int(rng.integers(2, 60))
        n, pos = rng.integers(5, 60, k), rng.integers(0, 12, k)
        pos = np.minimum(pos, n - 1)
        order = np.lexsort((pos, n))
        n, pos = n[order], pos[order]
        comp, home, zero = rng.integers(0, 4, k), np.full(k, -1), np.zeros(k, np.int64)
        none = np.zeros((k, setjoin.SKETCH), np.uint64)
        few, setjoin._FEW = setjoin._FEW, 5
        got = {(a, b) for i, j, _ in setjoin._open_pairs(n, pos, comp, home, zero, zero, none) for a, b in zip(i.tolist(), j.tolist())}
        setjoin._FEW = few
        expected = {(a, b) for a in range(k) for b in range(a + 1, k) if comp[a] != comp[b] and 9 * min(n[a] - pos[a], n[b] - pos[b], n[a], n[b]) >= 4 * (n[a] + n[b])}
        assert got == expected


def test_sketches_bound_differences():
    rng = np.random.default_rng(8)
    for size in (0, 3, 400, 5_000):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[: size // 2], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
        bits = [np.frombuffer(setjoin.sketch(v), np.uint64) for v in (x, y)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(x, y))
