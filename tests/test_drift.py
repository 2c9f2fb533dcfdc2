"""Drift figures on hand-made windows with one-sided items, and the windows of the registered queries."""

import math

from clickloom.operators import drift
from clickloom.plans.q_features import drift_windows
from clickloom.plans.registry import Tables
from tests.test_registry import SF


def window(spark, counts):
    return spark.createDataFrame([(i,) for i, n in counts.items() for _ in range(n)], "item_id long")


def test_windows_are_whole(spark):
    t = Tables(spark, SF)
    a, b = drift_windows(t)
    assert min(a.count(), b.count()) > 0 and a.count() + b.count() == t.clicks.where("event_time IS NOT NULL").count()


def test_one_sided_items(spark):
    p, q = (drift.item_shares(window(spark, c)) for c in ({1: 6, 2: 3, 3: 1}, {2: 2, 1: 1, 4: 1}))
    assert {tuple(r) for r in drift.aligned(p, q).collect()} == {(1, 0.6, 0.25), (2, 0.3, 0.5), (3, 0.1, 0.0), (4, 0.0, 0.25)}
    half = lambda xs, ys: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(xs, ys) if x) / 2
    a, b = (0.6, 0.3, 0.1, 0), (0.25, 0.5, 0, 0.25)
    assert math.isclose(drift.jsd(p, q).first()[0], half(a, b) + half(b, a), abs_tol=1e-6)
    assert math.isclose(drift.coverage(p, q).first()[0], 200 / 3)
    assert drift.top_overlap(p, q, 2).first()[0] == 100 and drift.top_overlap(p, q, 4).first()[0] == 50
    assert {tuple(r) for r in drift.top_share_table(p, q).collect()} == {(1, 0.6, 0.25), (2, 0.3, 0.5), (3, 0.1, 0.0)}
    assert {tuple(r) for r in drift.rank_shift(p, q).collect()} == {(1, 1, 2, 1), (2, 2, 1, -1)}
