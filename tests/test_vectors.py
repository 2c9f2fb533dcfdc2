"""Top-k over stored blocks and spreads without stored scores, beside numpy."""

import numpy as np
import pandas as pd
import pytest

from clickloom.operators import evaluate, vectors


def frame(spark, rows, name="item_idx", dim=8):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def plain_top(queries, items, k, normalize, exclude_self):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = []
    for q, v in queries:
        scored = sorted((-round(float(np.dot(unit(v), unit(w)) if normalize else np.dot(v, w)), 9), i) for i, w in items if not (exclude_self and i == q))
        out += [(q, r, i) for r, (_, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("block", [7, 1_000])
def test_topk_beside_numpy(spark, normalize, block):
    rng = np.random.default_rng(1)
    items = [(i, rng.normal(size=8) * rng.uniform(0.1, 5)) for i in range(150)] + [(500, np.zeros(8))]
    got = vectors.topk(frame(spark, items[::3], "query_id"), frame(spark, items), 6, normalize, True, block).collect()
    assert sorted((r.query_id, r.rank, r.item_idx) for r in got if r.query_id != 500) == plain_top([x for x in items[::3] if x[0] != 500], items, 6, normalize, True)


def test_ties_more_wanted_than_there_are_and_empty_tables(spark):
    items = frame(spark, [(i, [1.0] * 8) for i in (4, 2, 9)])
    got = vectors.topk(frame(spark, [(1, [1.0] * 8)], "query_id"), items, 5, block=2).collect()
    assert [(r.rank, r.item_idx) for r in sorted(got)] == [(1, 2), (2, 4), (3, 9)]
    assert vectors.topk(frame(spark, [(1, [1.0] * 8)], "query_id"), items.limit(0), 5).count() == 0
    assert vectors.topk(frame(spark, [(1, [1.0] * 8)], "query_id").limit(0), items, 5).count() == 0


def test_blocks_out_of_reach_are_not_read(spark):
    """Two far clusters: queries of one never load the other's blocks; the plan doesn't grow with the items."""
    rng = np.random.default_rng(2)
    near = [(i, np.r_[10 + rng.normal(size=1), rng.normal(size=7)]) for i in range(60)]
    far = [(100 + i, np.r_[-10 + rng.normal(size=1), rng.normal(size=7)]) for i in range(60)]
    where = vectors.store_blocks(frame(spark, near + far), 20, True)
    blocks = vectors.Blocks(where)
    assert len(blocks.numbers) == 6
    queries = np.stack([v / np.linalg.norm(v) for _, v in near[:10]])
    best = vectors.best_of(blocks, np.array([i for i, _ in near[:10]]), queries, 5, False)
    assert blocks.loads <= 3
    assert all(set(ids) <= set(range(60)) for ids in best.ids)
    plans = [vectors.topk(frame(spark, near, "query_id"), frame(spark, near + far), 3, block=b)._jdf.queryExecution().optimizedPlan().toString().count("\n") for b in (5, 200)]
    assert plans[0] == plans[1]


@pytest.mark.parametrize("steps", [8, 65_536])
def test_score_spread_is_exact(spark, steps):
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.normal(0.1, 0.2, 3_000).clip(-1, 1), np.full(500, 0.25), [1.0, -1.0]]), 9)
    df = spark.createDataFrame(pd.DataFrame({"s": values})).repartition(5)
    n, mean, deviation, points = vectors.score_spread(df, lambda part: part["s"].to_numpy(), [0.0, 0.1, 0.5, 0.9, 1.0], steps)
    assert n == len(values) and np.isclose(mean, values.mean()) and np.isclose(deviation, values.std())
    assert np.allclose(points, np.percentile(values, [0, 10, 50, 90, 100]), atol=1e-12)


def test_batch_scores_beside_numpy(spark):
    rng = np.random.default_rng(4)
    users, items = [(u, rng.normal(size=8)) for u in range(12)], [(i, rng.normal(size=8)) for i in range(20)]
    pairs = [(int(u), int(i)) for u, i in {(rng.integers(12), rng.integers(20)) for _ in range(60)}]
    tp = spark.createDataFrame(pairs, "user_idx long, item_idx long")
    row = evaluate.batch_scores(tp, frame(spark, users, "user_idx"), frame(spark, items), size=16, n=2, block=5).first()
    batched = evaluate.batches(tp, 16, 2).collect()
    unit = {"u": {u: v / np.linalg.norm(v) for u, v in users}, "i": {i: v / np.linalg.norm(v) for i, v in items}}
    pos, neg = [], []
    for a in batched:
        for b in batched:
            if a.batch == b.batch:
                (pos if (a.user_idx, a.item_idx) == (b.user_idx, b.item_idx) else neg).append(float(np.dot(unit["u"][a.user_idx], unit["i"][b.item_idx])))
    assert (row.n_positive, row.n_negative) == (len(pos), len(neg))
    for name, values in (("pos", pos), ("neg", neg)):
        want = [np.mean(values), np.std(values), *np.percentile(values, [10, 50, 90])]
        assert np.allclose([row[f"{name}_{c}"] for c in ("mean", "std", "p10", "p50", "p90")], want, atol=2e-6)


def test_small_blocks_share_a_read_and_one_file_of_queries_all_cores(spark):
    """Blocks of five rows are found again exactly, read together; queries of one partition are dealt out."""
    rng = np.random.default_rng(6)
    items = [(i, rng.normal(size=8)) for i in range(400)] + [(900 + i, np.full(8, 0.5)) for i in range(12)]
    blocks = vectors.Blocks(vectors.store_blocks(frame(spark, items), 5, False))
    best = vectors.best_of(blocks, np.array([i for i, _ in items]), np.stack([v for _, v in items]), 4, True)
    assert len(blocks.numbers) == 83 and blocks.loads == 1
    assert sorted((i, r, int(x)) for (i, _), ids in zip(items, best.ids) for r, x in enumerate(ids, 1)) == plain_top(items, items, 4, False, True)
    top = vectors.topk(frame(spark, items, "query_id").coalesce(1), frame(spark, items), 4, False, True, 5)
    assert top.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_scores_closer_than_single_precision_keep_their_order(spark):
    """Neighbours that differ in the eighth digit, and lengths beyond single precision."""
    items = [(i, np.r_[1.0, i * 1e-8, np.zeros(6)]) for i in range(200)]
    for scale_ in (1.0, 1e20):
        rows = [(i, v * scale_) for i, v in items]
        blocks = vectors.Blocks(vectors.store_blocks(frame(spark, rows), 16, False))
        best = vectors.best_of(blocks, np.array([1_000]), np.array([[1.0, 1.0] + [0.0] * 6]) * scale_, 5, False)
        assert list(best.ids[0]) == [199, 198, 197, 196, 195]


def test_an_item_that_comes_twice_takes_no_place_from_others(spark):
    rng = np.random.default_rng(7)
    items = [(i, rng.normal(size=8)) for i in range(120)]
    blocks = vectors.Blocks(vectors.store_blocks(frame(spark, items + items + items), 50, False))
    best = vectors.best_of(blocks, np.array([i for i, _ in items]), np.stack([v for _, v in items]), 4, True)
    for q, v in items:
        want = sorted((-round(float(v @ w), 9), i) for i, w in items * 3 if i != q)[:4]
        assert list(best.ids[q]) == [i for _, i in want]
