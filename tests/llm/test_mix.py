import math
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import mix, work
from tests.llm import fixtures


def words(text):
    return len(re.findall(work.WORD, text or ""))


def water_fill(sizes, weights=(5, 2, 1)):
    """Targets by sharing excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    for _ in range(10_000):
        open_ = [s for s in names if out[s] < 2 * sizes[s] - 1e-9]
        if left < 1e-9 or not open_:
            break
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            out[s] += given[s]
            if out[s] > 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = float(2 * sizes[s])
    return out


def rates_by_bisection(sizes, target, cap=2):
    """Entropy-balanced rates of one source, by bisection of the tilt."""
    total, filled = sum(sizes), sum(s > 0 for s in sizes)
    if target >= cap * total:
        return [float(cap)] * len(sizes)
    mean = total / filled
    rate = lambda lam, s: min(cap, math.exp(max(-700.0, min(700.0, lam * s / mean))))
    lo, hi = -1e5, 1e5
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * rate(mid, s) for s in sizes) < target else (lo, mid)
    return [rate(lo, s) for s in sizes]


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 97)), f"s{i % 7}" if i % 11 else None) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_rates_and_copies(spark, many):
    found = mix.mix(many).collect()
    by_source = {}
    for r in found:
        by_source.setdefault(r.source, []).append(r)
    targets = water_fill({s: sum(r.size for r in rows) for s, rows in by_source.items()})
    for source, rows in by_source.items():
        assert rows[0].target == pytest.approx(targets[source], rel=1e-12)
        assert rows[0].source_size == sum(r.size for r in rows)
        want = rates_by_bisection([r.size for r in rows], targets[source])
        assert [r.rate for r in rows] == pytest.approx(want, rel=1e-6)
        assert all(math.floor(r.rate) <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - targets[source]) <= max(r.size for r in rows)


def test_reruns_and_partitions_agree(spark, many):
    pick = lambda df: sorted((r.doc_id, r.copies) for r in mix.mix(df).collect())
    assert pick(many) == pick(many.repartition(11, "text"))


def test_mixed_documents_repeat_rows(spark, many):
    copies = {r.doc_id: r.copies for r in mix.mix(many).collect()}
    out = mix.mixed_documents(many)
    assert out.columns == many.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_awkward_and_empty(spark):
    docs = fixtures.awkward(spark)
    found = mix.mix(docs).collect()
    assert len(found) == len(fixtures.TEXTS)
    assert sorted(r.size for r in found) == sorted(words(t) for _, t, _, _ in fixtures.TEXTS)
    null_source = [r for r in found if r.source is None]
    assert len(null_source) == 2 and all(r.size == 0 and r.taken == 0 for r in null_source)
    assert mix.mixed_documents(docs).columns == docs.columns
    assert mix.mix(fixtures.empty(spark)).count() == 0
    assert mix.mixed_documents(fixtures.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, many):
    plan = mix.mix(many)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
