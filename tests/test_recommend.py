"""Recommenders, vectors, metrics and negatives on small hand-made tables and random brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluate, negatives, recommend

PAIRS = "user_idx long, item_idx long, confidence_score long"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIRS)


@pytest.fixture(scope="module")
def tp(spark):
    rng = random.Random(3)
    rows = {(u, rng.randrange(1, 40)): rng.randrange(1, 9) for u in range(30) for _ in range(rng.randrange(1, 15))}
    rows |= {(99, i): 1 for i in range(1, 36)}  # a user who has seen nearly everything
    rows |= {(98, i): 1 for i in range(1, 41) if i % 5 == 1 and i % 7}  # a cold user who has seen all of one category
    return pairs(spark, [(u, i, c) for (u, i), c in rows.items()]).cache()


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = [(i, f"l{i % 3}", "unknown" if i % 7 == 0 else f"c{i % 5}", rng.choice(["unknown", "a", "b"]), i % 4) for i in range(1, 41)]
    return spark.createDataFrame(rows, "item_idx long, cat_l1 string, cat_l2 string, brand string, price_bucket int").cache()


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.user_idx, r["rank"])):
        out.setdefault(r.user_idx, []).append(r.item_idx)
    return out


def popular_walk(tp_rows, users, n):
    score = {}
    seen = {}
    for u, i, c in tp_rows:
        score[i] = score.get(i, 0) + c
        seen.setdefault(u, set()).add(i)
    order = sorted(score, key=lambda i: (-score[i], i))
    return {u: [i for i in order if i not in seen.get(u, set())][:n] for u in users}, order, seen


@pytest.mark.parametrize("block", [1, 7, 64])
def test_popular_equals_the_walk(spark, tp, block):
    users = spark.createDataFrame([(u,) for u in [0, 1, 2, 99, 500]], "user_idx long")
    want, _, _ = popular_walk([tuple(r) for r in tp.collect()], [0, 1, 2, 99, 500], 10)
    assert listed(recommend.rec_popular(tp, users, 10, block)) == want


def test_category_and_pad(tp, items):
    users = tp.select("user_idx").distinct()
    recs = listed(recommend.rec_category(tp, items, users, 10))
    rows = [tuple(r) for r in tp.collect()]
    cat = {r.item_idx: r.cat_l2 for r in items.collect()}
    _, order, seen = popular_walk(rows, [], 10)
    for u, got in recs.items():
        by_cat = {}
        for uu, i, c in rows:
            if uu == u:
                by_cat[cat[i]] = by_cat.get(cat[i], 0) + c
        best = sorted(by_cat, key=lambda c: (-by_cat[c], c))[0]
        fresh = [i for i in order if i not in seen[u]]
        own = [i for i in fresh if cat[i] == best][:10]
        assert got == (own + [i for i in fresh if i not in own])[:10]


def test_cooccurrence_equals_brute_force(tp):
    rows = [tuple(r) for r in tp.collect()]
    _, order, seen = popular_walk(rows, [], 10)
    recs = listed(recommend.rec_cooccurrence(tp, tp.select("user_idx").distinct(), 10))
    for u, got in recs.items():
        rep = sorted([(-c, i) for uu, i, c in rows if uu == u])[0][1]
        count = {}
        for other in seen.values():
            if rep in other:
                for i in other - {rep}:
                    count[i] = count.get(i, 0) + 1
        own = [i for i in sorted(count, key=lambda i: (-count[i], i)) if i not in seen[u]][:10]
        fresh = [i for i in order if i not in seen[u]]
        assert got == (own + [i for i in fresh if i not in own])[:10]


@pytest.mark.parametrize("block", [20_000, 7])
def test_topk_similar_equals_numpy(spark, block):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_idx long, vec array<float>")
    got = recommend.topk_similar(df.withColumnRenamed("item_idx", "query_id"), df, 5, exclude_self=True, block=block).collect()
    d = m.astype("float64")
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    scores = d @ d.T
    np.fill_diagonal(scores, -9)
    for q in range(30):
        want = list(np.argsort(-scores[q], kind="stable")[:5])
        assert [r.item_idx for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_filter_seen_is_disjoint_and_renumbered(spark, tp):
    recs = recommend.rec_popular(pairs(spark, [(7, 1, 5), (7, 2, 4), (7, 3, 3)]), spark.createDataFrame([(1,)], "user_idx long"), 3)
    out = recommend.filter_seen(recs, pairs(spark, [(1, 1, 1)]), 2).orderBy("rank").collect()
    assert [(r["rank"], r.item_idx) for r in out] == [(1, 2), (2, 3)]


def recs_of(spark, rows):
    return spark.createDataFrame(rows, "user_idx long, rank long, item_idx long, score double")


def test_ndcg_by_hand(spark):
    recs = recs_of(spark, [(1, 1, 50, 0.0), (1, 2, 1, 0.0), (1, 3, 51, 0.0), (1, 4, 2, 0.0)])
    gt = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "user_idx long, item_idx long")
    row = evaluate.per_user(recs, gt, (4,)).first()
    want = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / math.log2(4))
    assert row.ndcg_4 == pytest.approx(want)
    assert row.hits_4 == 2 and row.precision_4 == 0.5


def test_recall_denominators(spark):
    recs = recs_of(spark, [(1, r, r, 0.0) for r in range(1, 11)])
    gt = spark.createDataFrame([(1, i) for i in list(range(6, 11)) + list(range(100, 110))], "user_idx long, item_idx long")
    assert evaluate.recall_at_k(recs, gt, (10,)).first().recall_10 == 0.5
    assert evaluate.recall_at_k(recs, gt, (10,), "gt").first().recall_10 == pytest.approx(5 / 15)


def test_users_without_recommendations_count_zero(spark):
    recs = recs_of(spark, [(1, 1, 1, 0.0)])
    gt = spark.createDataFrame([(1, 1), (2, 1)], "user_idx long, item_idx long")
    row = evaluate.evaluate(recs, gt, (10,)).first()
    assert (row.n_users, row.recall_10, row.hit_rate_10, row.ndcg_10) == (2, 0.5, 0.5, 0.5)


def test_hard_negatives_respect_their_route(tp, items):
    got = negatives.hard_negatives(tp, items, 3, warm=10).collect()
    cat = {r.item_idx: r.cat_l2 for r in items.collect()}
    bucket = {r.item_idx: r.price_bucket for r in items.collect()}
    seen = {}
    for u, i, _ in tp.collect():
        seen.setdefault(u, set()).add(i)
    by_pair = {}
    for r in got:
        by_pair.setdefault((r.user_idx, r.item_idx, r.route), []).append(r.negative)
    assert set((u, i) for u, i, _ in by_pair) == {(r.user_idx, r.item_idx) for r in tp.collect()}
    assert {route for *_, route in by_pair} >= {"category", "anti", "bucket", "any"}
    for (u, i, route), negs in by_pair.items():
        assert len(negs) == 3
        if route == "any":
            assert i not in negs
            continue
        if route == "anti":
            touched = {cat[x] for x in seen[u]}
            assert len(seen[u]) >= 10 and all(cat[n] not in touched and cat[n] != "unknown" for n in negs)
            continue
        pool = {x for x in cat if (cat[x] == cat[i] if route != "bucket" else bucket[x] == bucket[i])} - seen[u]
        assert set(negs) <= pool
        assert len(set(negs)) == 3 or len(pool) < 3


def test_uniform_negatives_stay_in_range(spark):
    seq = spark.createDataFrame([(1, [5, 6, 7]), (2, [5])], "user_idx long, item_seq array<long>")
    out = negatives.uniform_negatives(seq, 4, 10, ["user_idx"]).collect()
    assert [len(r.negatives) for r in sorted(out, key=lambda r: r.user_idx)] == [3, 1]
    assert all(1 <= x < 10 for r in out for pos in r.negatives for x in pos)


def test_session_negatives(spark):
    rows = [("s", 1, "view"), ("s", 2, "view"), ("s", 3, "view"), ("s", 2, "cart"), ("t", 1, "view"), (None, 1, "view")]
    ev = spark.createDataFrame(rows, "user_session string, product_id long, event_type string")
    assert sorted(tuple(r) for r in negatives.session_negatives(ev).collect()) == [("s", 1), ("s", 3)]


def test_user_risk_equals_brute_force(tp, items):
    info = {r.item_idx: (r.cat_l2, r.brand) for r in items.collect()}
    mine = {}
    for u, i, _ in tp.collect():
        mine.setdefault(u, []).append(i)
    for r in negatives.user_risk(tp, items).collect():
        brands = {info[i][1] for i in mine[r.user_idx]} - {"unknown"}
        total = high = 0
        for i in mine[r.user_idx]:
            pool = sum(info[x][0] == info[i][0] for x in info) - 1
            risky = sum(info[x][0] == info[i][0] and info[x][1] in brands and x != i for x in info)
            if pool > 0:
                total, high = total + pool, high + min(risky, pool)
        assert (r.candidates, r.high_risk) == (total, high)


def test_popularity_collapse(spark):
    recs = recs_of(spark, [(u, 1, 1, 0.0) for u in range(9)] + [(u, 2, 10 + u, 0.0) for u in range(9)])
    row = evaluate.popularity_collapse(recs, 10).first()
    assert (row.total_slots, row.unique_items, row.top_1_slots, row.top_5_slots, row.collapsed) == (18, 10, 9, 13, True)


def test_als_recommends(tp):
    model = recommend.als_fit(tp, rank=4, iterations=2)
    out = recommend.als_recommend(model, tp.select("user_idx").where("user_idx < 3"), 5)
    assert out.groupBy("user_idx").agg(F.count("*").alias("n")).where("n <> 5").count() == 0


def test_co_counts_have_no_cap(spark):
    rows = [(u, i, 1.0) for u in range(2_500) for i in (1, 2)]
    tp = spark.createDataFrame(rows, "user_idx long, item_idx long, confidence_score double")
    reps = spark.createDataFrame([(1,)], "rep long")
    assert [tuple(r) for r in recommend.co_counts(tp, reps).collect()] == [(1, 2, 2_500)]


def test_hard_negatives_of_a_user_with_very_many_positives(spark):
    """Fifty thousand positives of unknown category in one price bucket: only the last items are free."""
    n = 50_000
    items = spark.range(1, n + 11).select(F.col("id").alias("item_idx"), F.lit("unknown").alias("cat_l2"), F.lit(3).alias("price_bucket"), F.lit("x").alias("brand"))
    tp = spark.range(1, n + 1).select(F.lit(7).cast("long").alias("user_idx"), F.col("id").alias("item_idx"), F.lit(1.0).alias("confidence_score"))
    got = negatives.hard_negatives(tp, items, 3, warm=10)
    row = got.agg(F.count("*").alias("n"), F.min("negative").alias("low"), F.max("negative").alias("high"), F.count_distinct("negative").alias("d")).first()
    assert (row.n, row.low, row.high, row.d) == (3 * n, n + 1, n + 10, 10)
    assert got.groupBy("item_idx").agg(F.count_distinct("negative").alias("d")).where("d < 3").count() == 0


def test_als_solves_its_normal_equations(spark):
    """User factors beside numpy's solution; another weighting is found out."""
    rng = random.Random(1)
    rows = [(u, i, rng.randint(1, 9)) for u in range(30) for i in rng.sample(range(40), 8)]
    tp = spark.createDataFrame(rows, "user_idx long, item_idx long, confidence_score long")
    model = recommend.als_fit(tp, rank=4, reg=0.1, iterations=5)
    ys = {r.id: np.array(r.features, float) for r in model.itemFactors.collect()}
    us = {r.id: np.array(r.features, float) for r in model.userFactors.collect()}
    gram = sum(np.outer(y, y) for y in ys.values())
    for u, have in us.items():
        mine = [(ys[i], c) for x, i, c in rows if x == u]
        left = gram + sum(c * np.outer(y, y) for y, c in mine) + 0.1 * len(mine) * np.eye(4)
        assert np.allclose(have, np.linalg.solve(left, sum((1 + c) * y for y, c in mine)), atol=1e-4)
    right = recommend.als_residuals(model, tp, 0.1).collect()
    assert len(right) == 30 and all(r.residual < 1e-4 * r.size for r in right)
    wrong = recommend.als_residuals(model, tp, 0.1, alpha=2.0).collect()
    assert all(r.residual > 1e-2 * r.size for r in wrong)
