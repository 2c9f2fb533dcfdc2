import hashlib
import random

from clickloom.llm import quartile
from tests.llm import fixtures

PROSE = " ".join(f"the {a} of a {b} is seldom {c}" for a in ("tail", "wing", "sound", "name") for b in ("bird", "river", "stone") for c in ("red", "late", "known"))


def test_likeness_falls_with_edits():
    mark = quartile.digest(PROSE)
    small = quartile.digest(PROSE.replace("wing", "fin", 3))
    large = quartile.digest(quartile.edited(PROSE, "0123456789" * 500))
    other = quartile.digest("0123456789 " * 200)
    assert quartile.likeness(mark, mark) == 1
    assert 1 > quartile.likeness(mark, small) > quartile.likeness(mark, large) > quartile.likeness(mark, other) >= 0
    assert quartile.likeness(mark, small) == quartile.likeness(small, mark)


def test_counts_of_parts(monkeypatch):
    whole = quartile.digest(PROSE)
    monkeypatch.setattr(quartile, "_PART", 17)
    assert quartile.digest(PROSE) == whole


def test_digest_follows_plain_counting():
    data, t = PROSE.encode(), [int(x) for x in quartile._TABLE]
    counts = [0] * 128
    for a, b, c, d in zip(data, data[1:], data[2:], data[3:]):
        for h in (t[t[t[a] ^ b] ^ c], t[t[t[a] ^ b] ^ d ^ 77], t[t[t[a] ^ c] ^ d ^ 141]):
            counts[h % 128] += 1
    ordered = sorted(counts)
    q = ordered[31], ordered[63], ordered[95]
    codes = [sum(c > x for x in q) for c in counts]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4))
    assert quartile.digest(PROSE)[4:] == packed.hex()


def test_every_document_meets_the_next(spark):
    docs = fixtures.awkward(spark)
    got = quartile.chain(docs).collect()
    texts = [(i, t or "") for i, t, _, _ in sorted(fixtures.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    want = []
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        a, b, c = quartile.digest(text), quartile.digest(changed), quartile.digest(after)
        want.append((i, len(text), a, hashlib.sha256(changed.encode()).hexdigest(), b, quartile.likeness(a, b), quartile.likeness(a, c)))
    columns = ("doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)


def test_one_document_and_none(spark):
    one = quartile.chain(fixtures.awkward(spark).where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert quartile.chain(fixtures.empty(spark)).count() == 0


def test_rows_of_one_id_are_dealt_out_and_stay_in_order(spark):
    """A third of the rows has no doc_id: they spread over tasks, and every row still meets its successor."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [(None if k % 3 == 0 else k, "".join(rng.choice("abcdef ") for _ in range(rng.randint(70, 200)))) for k in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in quartile.chain(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {(i, len(t), hashlib.sha256(quartile.edited(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1])}
    assert got == want
