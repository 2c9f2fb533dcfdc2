import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import audit, queries
from tests.llm import fixtures

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    """(doc_id, part, mask) by comparing every text with all others."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, source in rows:
        t = text or ""
        words = WORDS.findall(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        out.append((i, source or "", sum(1 << k for k, x in enumerate(fails) if x)))
    return out


def plain_audit(masks, labels):
    """Every order run over the documents, one filter after the other."""
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, removed_by = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in masks}:
            alive = [(i, m) for i, p, m in masks if p == part]
            everyone = list(alive)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone, left = [x for x in alive if x[1] & bit], [x for x in alive if not x[1] & bit]
                failing = [x for x in everyone if x[1] & bit]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(m == bit for _, m in everyone), sum(i in good for i, _ in gone if i is not None), sum(i in bad for i, _ in gone if i is not None)]
                removed_by[part, letter] += len(gone)
                alive = left
    return {(p, o, s): (*x, removed_by[p, o[s - 1]]) for (p, o, s), x in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def counted(masks):
    return Counter({(r.doc_id, r.part, r.mask): r.n for r in masks.collect()})


def test_masks_and_orders_of_awkward_rows(spark):
    docs, labels = fixtures.awkward(spark), fixtures.labels(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    expected = plain_masks(rows)
    assert counted(audit.masks(docs)) == Counter(expected)
    assert got(audit.audit(docs, labels)) == plain_audit(expected, [tuple(r) for r in labels.collect()])


def test_empty_table(spark):
    assert audit.audit(fixtures.empty(spark), fixtures.labels(spark)).count() == 0


def test_long_common_prefixes_and_hot_copies(spark, monkeypatch):
    """A third of the rows is one text and most texts share over 1,000 characters."""
    monkeypatch.setattr(audit, "BLOCK", 40_000)
    start = "same start of every text " * 50
    texts = [start + ("the copied end" if k % 3 == 0 else f"its own end {k % 90}") for k in range(600)] + ["", "", "short", "same", start[:8], start[:32]]
    rows = [(1_000 - k, t, None if k % 5 == 0 else f"s{k % 2}") for k, t in enumerate(texts)]
    rows += rows[:1] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    keyed = audit._prefixes(audit._settle(docs).where("text IS NOT NULL"))
    assert keyed.selectExpr("max(length(key))").first()[0] > 1_000
    assert counted(audit.masks(docs)) == Counter(plain_masks(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=6), st.one_of(st.none(), st.integers(0, 20))), max_size=30))
def test_trie_holds_whole_texts(rows):
    trie = audit.Trie()
    ends = [trie.insert(t.encode(), i) for t, i in rows]
    for (t, _), end in zip(rows, ends):
        assert end.least == min((i for u, i in rows if u == t and i is not None), default=None)
    assert len({id(e) for e in ends}) == len({t for t, _ in rows})


def test_query_beside_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = got(queries.op12_filter_audit(spark, folder))
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        rows = db.execute(queries.ORACLES["op12_filter_audit"]).fetchall()
    assert found == {r[:3]: r[3:] for r in rows}
    assert len(found) % 600 == 0


def test_filter_bounds():
    text = " ".join(["w"] * 50)
    assert audit.own_mask(text, text.encode()) == 0b10
    assert audit.own_mask("A" + "b" * 19, b"A" + b"b" * 19) == 0b1  # five of a hundred is not over five
    assert audit.own_mask("A" + "b" * 18, b"A" + b"b" * 18) == 0b101
    assert audit.own_mask("50 | 60", b"50 | 60") == 0b1001
    assert audit.own_mask("", b"") == 1

