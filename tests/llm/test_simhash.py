import random

import numpy as np
import pytest
import xxhash

from clickloom.llm import simhash
from clickloom.llm.components import components
from tests.llm import fixtures


def plain_fingerprint(text):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints_match_plain_python():
    for _, text, _, _ in fixtures.TEXTS:
        if not text or len(text) < 5_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 31} V{i}" for i in range(2_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PART", 37)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_forest_finds_every_link():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(12)})
    forest = simhash.Forest(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    found = {(int(q), int(n)) for a, b in forest.within(np.arange(len(values)), 3) for q, n in zip(a, b)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= 3}


@pytest.mark.parametrize("tree", [2_000, 3])
def test_links_and_components_match_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    values = list({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(8))) for s in seeds for _ in range(14)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    root = {r.node: r.root for r in got.collect()}
    want = plain_components(values)
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(v)
    for members in groups.values():
        assert {root.get(v, v) for v in members} == {min(members)}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    root = {r.node: r.root for r in components(links).collect()}
    assert set(root.values()) == {0, 1000} and len(root) == 303


def test_awkward_rows(spark):
    rows = fixtures.rows_of(simhash.classes(fixtures.awkward(spark)))
    texts = fixtures.TEXTS
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and by_id[2]["fingerprint"] == by_id[1]["fingerprint"]
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3} and by_id[3]["fingerprint"] == "0" * 16
    assert by_id[None]["component_id"] is None
    assert simhash.classes(fixtures.empty(spark)).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    docs = fixtures.awkward(spark)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 6, 7, 8, 9, 10, 11, 12, None]
    assert simhash.near_dedup(fixtures.empty(spark)).count() == 0
