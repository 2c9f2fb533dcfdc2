"""Ground truth, ranking metrics, cohort views and the diagnostics around them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import PAD
from clickloom.functions import cohort, dot, n_rows, unit
from clickloom.operators import vectors
from clickloom.operators.clean import high_intent
from clickloom.operators.recommend import pairs_per_user, rec_popular

POINTS = (0.1, 0.5, 0.9)  # percentiles of score spreads


# --------------------------------------------------------------------------- ground truth


def ground_truth(test: DataFrame, users: DataFrame, items: DataFrame | None = None, featured: DataFrame | None = None) -> DataFrame:
    """Distinct (user_idx, item) carted or bought by users of the vocabulary (and with features).

    With an item vocabulary the items are mapped and unmapped ones dropped; without, product ids stay.
    """
    hot = high_intent(test).select("user_id", "product_id").distinct().join(users.toDF("user_id", "user_idx"), "user_id")
    if featured is not None:
        hot = hot.join(featured.select("user_idx").distinct(), "user_idx", "left_semi")
    if items is not None:
        return hot.join(items.toDF("product_id", "item_idx"), "product_id").select("user_idx", "item_idx")
    return hot.select("user_idx", "product_id")


def user_coverage(test: DataFrame, users: DataFrame, featured: DataFrame) -> DataFrame:
    """How many test buyers remain after the vocabulary and after the feature table."""
    buyers = high_intent(test).select("user_id").distinct()
    mapped = buyers.join(users.toDF("user_id", "user_idx"), "user_id", "left")
    flagged = mapped.join(featured.select("user_idx", F.lit(1).alias("f")).distinct(), "user_idx", "left")
    out = flagged.agg(n_rows().alias("test_buyers"), F.count("user_idx").alias("in_vocab"), F.count("f").alias("with_features"))
    return out.withColumns(
        {
            "lost_no_vocab": F.col("test_buyers") - F.col("in_vocab"),
            "lost_no_features": F.col("in_vocab") - F.col("with_features"),
            "coverage_pct": F.round(F.try_divide(F.col("with_features") * 100, F.col("test_buyers")), 4),
        }
    )


# --------------------------------------------------------------------------- metrics


def per_user(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20), denominator: str = "min") -> DataFrame:
    """Hits, recall, precision and NDCG at each k for every user with ground truth.

    ``denominator`` is 'min' for min(|GT|, k) or 'gt' for |GT|. One ranked table serves all cutoffs,
    and a user without recommendations scores 0.
    """
    top = recs.where(F.col("rank") <= max(ks)).select("user_idx", "item_idx", "rank")
    hit = gt.select("user_idx", "item_idx").join(top, ["user_idx", "item_idx"], "left")
    gain = 1 / F.log2(F.col("rank") + 1)
    sums = hit.groupBy("user_idx").agg(
        n_rows().alias("n_gt"),
        *[F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hits_{k}") for k in ks],
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias(f"dcg_{k}") for k in ks],
    )
    out = sums
    for k in ks:
        size = F.least(F.col("n_gt"), F.lit(k))
        best = [sum(1 / math.log2(i + 2) for i in range(m)) for m in range(1, k + 1)]
        ideal = F.element_at(F.array(*map(F.lit, best)), size.cast("int"))
        out = out.withColumns(
            {
                f"recall_{k}": F.col(f"hits_{k}") / (size if denominator == "min" else F.col("n_gt")),
                f"precision_{k}": F.col(f"hits_{k}") / F.lit(k),
                f"ndcg_{k}": F.col(f"dcg_{k}") / ideal,
            }
        )
    return out.drop(*[f"dcg_{k}" for k in ks])


def recall_at_k(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20), denominator: str = "min") -> DataFrame:
    return per_user(recs, gt, ks, denominator).select("user_idx", *[f"recall_{k}" for k in ks])


def ndcg_at_k(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    return per_user(recs, gt, ks).select("user_idx", *[f"ndcg_{k}" for k in ks])


def precision_at_k(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    return per_user(recs, gt, ks).select("user_idx", *[f"precision_{k}" for k in ks])


def _averages(ks: Sequence[int]) -> list[Column]:
    return [
        n_rows().alias("n_users"),
        *[F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for m in ("recall", "ndcg") for k in ks],
        *[F.round(F.avg((F.col(f"hits_{k}") > 0).cast("int")), 6).alias(f"hit_rate_{k}") for k in ks],
    ]


def hit_rate(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    return evaluate(recs, gt, ks).select(*[f"hit_rate_{k}" for k in ks])


def evaluate(recs: DataFrame, gt: DataFrame, ks: Sequence[int] = (10, 20), denominator: str = "min") -> DataFrame:
    return per_user(recs, gt, ks, denominator).agg(*_averages(ks))


def compare(recs: dict[str, DataFrame], gt: DataFrame, ks: Sequence[int] = (10, 20), denominator: str = "gt") -> DataFrame:
    """One metric row per recommender."""
    rows = [evaluate(r, gt, ks, denominator).select(F.lit(name).alias("model"), "*") for name, r in recs.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def user_cohorts(tp: DataFrame) -> DataFrame:
    return pairs_per_user(tp).withColumn("cohort", cohort("n_seen"))


def evaluate_stratified(recs: DataFrame, gt: DataFrame, tp: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Metrics per cohort and overall; users below the first cohort count only overall."""
    users = per_user(recs, gt, ks).join(user_cohorts(tp), "user_idx", "left")
    both = users.withColumn("cohort", F.explode(F.array_compact(F.array("cohort", F.lit("overall")))))
    return both.groupBy("cohort").agg(*_averages(ks))


def evaluate_sessions(recs: DataFrame, targets: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """HR@k and NDCG@k with one target per session; recs and targets share ``session_idx``."""
    hit = targets.join(recs.select("session_idx", F.col("item_idx").alias("target"), "rank"), ["session_idx", "target"], "left")
    rank = F.col("rank")
    return hit.agg(
        n_rows().alias("n_sessions"),
        *[F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias(f"hr_{k}") for k in ks],
        *[F.round(F.avg(F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}") for k in ks],
    )


def session_popularity(train_seq: DataFrame, targets: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Every session is offered the most frequent items of the training sessions."""
    counts = train_seq.select(F.explode("item_seq").alias("item_idx")).where(F.col("item_idx") != PAD)
    top = counts.groupBy("item_idx").agg(n_rows().alias("freq")).orderBy(F.desc("freq"), "item_idx").limit(max(ks))
    # At most max(ks) rows.
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("neg"), "item_idx"))), lambda x: x["item_idx"])
    ranked = top.agg(listed.alias("l")).select(F.posexplode("l").alias("_at", "target"))
    hit = targets.join(F.broadcast(ranked.select("target", (F.col("_at") + 1).alias("rank"))), "target", "left")
    rank = F.col("rank")
    return hit.agg(
        n_rows().alias("n_sessions"),
        *[F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias(f"hr_{k}") for k in ks],
        *[F.round(F.avg(F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}") for k in ks],
    )


# --------------------------------------------------------------------------- diagnostics


def _gt_seen(gt: DataFrame, tp: DataFrame) -> DataFrame:
    seen = tp.select("user_idx", "item_idx", F.lit(1).alias("seen"))
    return gt.select("user_idx", "item_idx").join(seen, ["user_idx", "item_idx"], "left")


def seen_overlap(gt: DataFrame, tp: DataFrame, warn: float = 80.0) -> DataFrame:
    """How much ground truth the seen-item filter would remove."""
    out = _gt_seen(gt, tp).agg(n_rows().alias("gt_items"), F.count("seen").alias("gt_seen"))
    out = out.withColumn("seen_pct", F.round(F.try_divide(F.col("gt_seen") * 100, F.col("gt_items")), 4))
    return out.withColumn("warning", F.col("seen_pct") > warn)


def cold_warm(tp: DataFrame, gt: DataFrame, k: int = 10) -> DataFrame:
    """Per cohort and overall: ground truth size, the share already seen, popularity Recall@k."""
    people = user_cohorts(tp).where(F.col("cohort").isNotNull()).select("user_idx", "cohort")
    truth = gt.join(people, "user_idx", "left_semi")
    recall = per_user(rec_popular(tp, truth, k), truth, (k,)).select("user_idx", f"recall_{k}")
    seen = _gt_seen(truth, tp).groupBy("user_idx").agg(n_rows().alias("g"), F.count("seen").alias("s"))
    users = seen.join(recall, "user_idx").join(people, "user_idx")
    both = users.withColumn("cohort", F.explode(F.array("cohort", F.lit("overall"))))
    return both.groupBy("cohort").agg(
        n_rows().alias("n_users"), F.sum("g").alias("gt_items"), F.sum("s").alias("gt_seen"),
        F.round(F.sum("s") * 100 / F.greatest(F.sum("g"), F.lit(1)), 4).alias("filtered_pct"),
        F.round(F.avg(f"recall_{k}"), 6).alias(f"popularity_recall_{k}"),
    )


def user_diagnostics(recs: DataFrame, gt: DataFrame, tp: DataFrame, k: int = 10) -> DataFrame:
    """Ground-truth density, hit users, recall of hit users, and the profile of users without a hit.

    Users are merged to distinct (|GT|, recall, train count) rows before the percentiles.
    """
    users = per_user(recs, gt, (k,)).join(pairs_per_user(tp), "user_idx", "left").select(
        "n_gt", F.col(f"recall_{k}").alias("recall"), F.coalesce("n_seen", F.lit(0)).alias("n_seen")
    )
    n = F.col("n")
    rows = users.groupBy("n_gt", "recall", "n_seen").agg(n_rows().alias("n"))
    hit, zero = F.col("recall") > 0, F.col("recall") == 0

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    def mean(value: str, cond: Column) -> Column:
        return F.round(F.try_divide(F.sum(F.when(cond, F.col(value) * n)), total(cond)), 6)

    def point(value: str, p: float, cond: Column) -> Column:
        return F.round(F.percentile(F.when(cond, F.col(value)), F.lit(p), n), 6)

    always = F.lit(True)
    return rows.agg(
        F.sum(n).alias("n_users"), F.min("n_gt").alias("gt_min"), F.max("n_gt").alias("gt_max"), mean("n_gt", always).alias("gt_mean"),
        point("n_gt", 0.5, always).alias("gt_p50"), point("n_gt", 0.9, always).alias("gt_p90"),
        F.round(total(F.col("n_gt") == 1) * 100 / F.sum(n), 4).alias("pct_one_gt"),
        total(hit).alias("hit_users"), F.round(total(hit) * 100 / F.sum(n), 4).alias("hit_pct"),
        mean("recall", hit).alias("hit_recall_mean"), point("recall", 0.5, hit).alias("hit_recall_p50"),
        point("recall", 0.75, hit).alias("hit_recall_p75"),
        mean("n_gt", zero).alias("zero_gt_mean"), mean("n_seen", zero).alias("zero_train_mean"),
        point("n_seen", 0.5, zero).alias("zero_train_p50"),
        total(zero & (F.col("n_seen") <= 5)).alias("zero_cold"), total(zero & (F.col("n_seen") > 5)).alias("zero_warm"),
    )


COLLAPSE_STEPS = (1, 5, 10, 50, 100)


def popularity_collapse(recs: DataFrame, k: int = 10, warn: float = 20.0) -> DataFrame:
    """Share of recommendation slots taken by the most recommended items."""
    counts = recs.where(F.col("rank") <= k).groupBy("item_idx").agg(n_rows().alias("slots"))
    whole = counts.agg(F.sum("slots").alias("total_slots"), n_rows().alias("unique_items"))
    # At most 100 rows reach the final array.
    top = counts.orderBy(F.desc("slots"), "item_idx").limit(max(COLLAPSE_STEPS))
    sizes = top.agg(F.sort_array(F.collect_list("slots"), asc=False).alias("a")).scalar()
    out = whole.withColumn("_top", sizes)

    def first(m: int) -> Column:
        return F.aggregate(F.slice("_top", 1, m), F.lit(0).cast("long"), lambda s, x: s + x)

    out = out.withColumns({f"top_{m}_slots": first(m) for m in COLLAPSE_STEPS})
    out = out.withColumns({f"top_{m}_pct": F.round(F.col(f"top_{m}_slots") * 100 / F.col("total_slots"), 4) for m in COLLAPSE_STEPS})
    return out.withColumn("collapsed", F.col("top_50_pct") > warn).drop("_top")


def test_item_coverage(test: DataFrame, items: DataFrame, tp: DataFrame) -> DataFrame:
    """Mapped items bought in the test window: total, seen in training, never seen."""
    bought = test.where(F.col("event_type") == "purchase").select("product_id").distinct()
    gt = bought.join(items.toDF("product_id", "item_idx"), "product_id")
    trained = tp.select("item_idx", F.lit(1).alias("t")).distinct()
    out = gt.join(trained, "item_idx", "left").agg(n_rows().alias("gt_items"), F.count("t").alias("seen"))
    return out.withColumns(
        {"never_seen": F.col("gt_items") - F.col("seen"), "seen_pct": F.round(F.try_divide(F.col("seen") * 100, F.col("gt_items")), 4)}
    )


def gt_quality(test: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Purchases, buyers, rows of known users, items per user, and items inside the vocabulary."""
    bought = test.where(F.col("event_type") == "purchase").select("user_id", "product_id")
    flagged = bought.join(users.toDF("user_id", "user_idx"), "user_id", "left")
    row = flagged.agg(n_rows().alias("purchases"), F.count_distinct("user_id").alias("buyers"), F.count("user_idx").alias("known_rows"))
    mine = flagged.where(F.col("user_idx").isNotNull()).select("user_idx", "product_id").distinct()
    sizes = mine.groupBy("user_idx").agg(n_rows().alias("g")).agg(
        F.round(F.avg("g"), 6).alias("items_per_user"), F.count_if(F.col("g") == 1).alias("one_item"), F.count_if(F.col("g") >= 2).alias("two_or_more")
    )
    known = mine.select("product_id").distinct().join(items.toDF("product_id", "item_idx"), "product_id", "left").agg(
        n_rows().alias("gt_items"), F.count("item_idx").alias("in_vocab")
    )
    return scale.beside(scale.beside(row, sizes), known)


# --------------------------------------------------------------------------- vector diagnostics


def _spread(values: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """mean, population deviation, p10, p50 and p90 of a score column of any cardinality."""
    row = values.agg(F.round(F.avg(column), 6).alias(f"{prefix}mean"), F.round(F.stddev_pop(column), 6).alias(f"{prefix}std"))
    points = scale.percentiles(values, column, [0.1, 0.5, 0.9])
    return scale.beside(row, points.select(*[F.round(c, 6).alias(prefix + c) for c in points.columns]))


def _blocks_of(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows of each key (ids ``i`` and unit vectors ``v``) as lists, in blocks of about ``size``."""
    n = rows.groupBy(*keys).agg(n_rows().alias("_n"))
    dealt = rows.join(n, list(keys)).withColumn("block", F.pmod(F.xxhash64("i"), F.ceil(F.col("_n") / size)))
    return dealt.groupBy(*keys, "block").agg(F.collect_list("i").alias("ids"), F.collect_list("v").alias("vecs"))


def _spread_row(df: DataFrame, found: tuple, prefix: str) -> DataFrame:
    _, mean, deviation, points = found
    names = ["mean", "std", "p10", "p50", "p90"]
    values = [None if v != v else round(float(v), 6) for v in (mean, deviation, *points)]
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"{prefix}{n} double" for n in names))


def _products(same: bool | None):
    """Scores of two blocks of vectors a row; ``same``: only those of equal (or of different) ids."""

    def scores(part: pd.DataFrame) -> np.ndarray:
        out = [np.zeros(0)]
        for a, va, b, vb in zip(part["a_ids"], part["a_vecs"], part["b_ids"], part["b_vecs"]):
            s = np.round(np.stack(va) @ np.stack(vb).T, 9)
            equal = np.asarray(a)[:, None] == np.asarray(b)[None, :]
            out.append(s[equal if same else ~equal])
        return np.concatenate(out)

    return scores


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every block of ``a`` beside every block of ``b`` with the same keys; a row is one product of blocks."""
    left = a.select(*keys, F.col("ids").alias("a_ids"), F.col("vecs").alias("a_vecs"))
    right = b.select(*keys, F.col("ids").alias("b_ids"), F.col("vecs").alias("b_vecs"))
    met = left.join(right, list(keys))
    return scale.cut_lineage(met.repartition(met.sparkSession.sparkContext.defaultParallelism))


def pairwise_cosine(vecs: DataFrame, n: int = 1000, key: str = "item_idx", seed: int = 42, block: int = 256) -> DataFrame:
    """Spread of cosines between different vectors of an n-row sample (n bounds the n*n scores).

    Scores are made in products of blocks and counted; none is stored (:func:`vectors.score_spread`).
    """
    part = vecs.orderBy(scale.draw(seed, key), key).limit(n).select(F.lit(0).alias("all"), F.col(key).alias("i"), unit("vec").alias("v"))
    rows = scale.cut_lineage(_blocks_of(part, ["all"], block))
    return _spread_row(vecs, vectors.score_spread(_met(rows, rows, ["all"]), _products(False), POINTS), "")


def paired_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine of each (user_idx, item_idx) row, users and items given as vector tables."""
    l, r = left.select("user_idx", unit("vec").alias("vu")), right.select("item_idx", unit("vec").alias("vi"))
    return pairs.join(l, "user_idx").join(r, "item_idx").select("user_idx", "item_idx", dot("vu", "vi").alias("score"))


def paired_cosine_stats(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """mean, deviation, p10, p50 and p90 of the paired cosines."""
    return _spread(scale.cut_lineage(paired_cosine(pairs, left, right)), "score")


def batches(tp: DataFrame, size: int, n: int, seed: int = 42) -> DataFrame:
    """n random batches of ``size`` pairs: the first n*size pairs in hash order, cut in order."""
    picked = tp.withColumn("_h", scale.draw(seed, "user_idx", "item_idx")).orderBy("_h", "user_idx", "item_idx").limit(n * size)
    placed = scale.add_position(picked, [F.col("_h"), F.col("user_idx"), F.col("item_idx")], "_at", 0).drop("_h")
    return placed.withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def batch_scores(tp: DataFrame, uvec: DataFrame, ivec: DataFrame, size: int = 64, n: int = 4, seed: int = 42, block: int = 256) -> DataFrame:
    """Spread of positive and in-batch negative scores. A batch has ``size`` rows, so size^2 scores.

    A batch is cut into blocks on both sides; tasks multiply block by block and return counts, so the
    n x size^2 scores are neither stored nor sorted, and no side is sent to all tasks.
    """
    b = scale.cut_lineage(batches(tp, size, n, seed).withColumn("i", F.xxhash64("user_idx", "item_idx")))
    u = b.join(uvec.select("user_idx", unit("vec").alias("v")), "user_idx").select("batch", "i", "v")
    i = b.join(ivec.select("item_idx", unit("vec").alias("v")), "item_idx").select("batch", "i", "v")
    met = _met(_blocks_of(u, ["batch"], block), _blocks_of(i, ["batch"], block), ["batch"])
    pos, neg = (vectors.score_spread(met, _products(same), POINTS) for same in (True, False))
    row = tp.sparkSession.createDataFrame([(pos[0], neg[0])], "n_positive long, n_negative long")
    out = scale.beside(scale.beside(row, _spread_row(tp, pos, "pos_")), _spread_row(tp, neg, "neg_"))
    return out.withColumn("gap", F.round(F.col("pos_mean") - F.col("neg_mean"), 6))


def gt_vs_random(gt: DataFrame, tp: DataFrame, uvec: DataFrame, ivec: DataFrame, draws: int = 10, seed: int = 42) -> DataFrame:
    """Mean score of each user's ground truth against random trained items; spread and gap."""
    from clickloom.operators.sample import draw_from_pool

    pool = tp.join(ivec.select("item_idx"), "item_idx", "left_semi")
    random = draw_from_pool(gt.select("user_idx").distinct(), pool, "item_idx", draws, seed)
    def mean(pairs: DataFrame, name: str) -> DataFrame:
        return paired_cosine(pairs, uvec, ivec).groupBy("user_idx").agg(F.round(F.avg("score"), 9).alias(name))

    users = scale.cut_lineage(mean(gt, "g").join(mean(random, "r"), "user_idx"))
    out = scale.beside(_spread(users, "g", "gt_"), _spread(users, "r", "random_"))
    return scale.beside(out, users.agg(n_rows().alias("n_users"), F.round(F.avg(F.col("g") - F.col("r")), 6).alias("gap")))


def first_hit_rank(recs: DataFrame, gt: DataFrame, steps: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    """Rank of the first ground-truth item in each user's list, and whether it is within each step."""
    hit = gt.join(recs.select("user_idx", "item_idx", "rank"), ["user_idx", "item_idx"], "left")
    out = hit.groupBy("user_idx").agg(F.min("rank").alias("first_rank"))
    return out.withColumns({f"in_top_{s}": F.coalesce(F.col("first_rank") <= s, F.lit(False)) for s in steps})


def score_profile(scores: DataFrame) -> DataFrame:
    """Profile of one query's scores over all items (columns item_idx, score)."""
    row = scores.agg(
        n_rows().alias("n_items"), F.round(F.max("score"), 6).alias("max"), F.round(F.min("score"), 6).alias("min"),
        F.round(F.stddev_pop("score"), 6).alias("std"),
    )
    for k in (10, 100):
        top = scores.orderBy(F.desc("score"), "item_idx").limit(k)
        row = scale.beside(row, top.agg(F.round(F.avg("score"), 6).alias(f"top_{k}_mean")))
    points = scale.percentiles(scores, "score", [0.5])
    return scale.beside(row, points.select(F.round("p50", 6).alias("median")))


def best_run(metrics: DataFrame, metric: str = "recall_10", name: str = "model") -> DataFrame:
    """The row with the highest metric, ties to the smallest name."""
    return metrics.orderBy(F.desc(metric), F.asc(name)).limit(1)


def popularity_epoch(seen: DataFrame, held: DataFrame, n_items: int, weight: Column, k: int = 50) -> DataFrame:
    """(loss, recall): log loss and top-k recall of item shares learnt from ``seen`` on the pairs ``held``.

    Shares are smoothed by one for each of ``n_items`` items, so unseen items have a finite loss.
    """
    counts = seen.groupBy("item_idx").agg(F.sum(weight).cast("double").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("t")).scalar()
    top = counts.orderBy(F.desc("n"), F.asc("item_idx")).limit(k).select("item_idx", F.lit(1.0).alias("hit"))
    met = held.select("item_idx").join(counts, "item_idx", "left").join(F.broadcast(top), "item_idx", "left")
    share = (F.coalesce("n", F.lit(0.0)) + 1) / (total + n_items)
    return met.agg(F.round(-F.avg(F.ln(share)), 6).alias("loss"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def run_correlations(metrics: DataFrame) -> DataFrame:
    """Per run of a table of runs: correlation of loss and recall over its epochs, verdict and best epoch."""
    out = metrics.groupBy("run").agg(
        F.round(F.corr("loss", "recall"), 6).alias("pearson_r"), n_rows().alias("n_epochs"), F.max_by("epoch", F.struct("recall", (-F.col("epoch")).alias("first"))).alias("best_epoch")
    )
    return out.withColumn("verdict", _verdict(F.col("pearson_r")))


def _verdict(r: Column) -> Column:
    return F.when(r < -0.7, "strong negative").when(r < -0.3, "weak negative").otherwise("decoupled")


def loss_recall_corr(metrics: DataFrame, loss: str = "loss", recall: str = "recall") -> DataFrame:
    """Pearson correlation with its verdict band."""
    out = metrics.agg(F.round(F.corr(loss, recall), 6).alias("pearson_r"), n_rows().alias("n_points"))
    return out.withColumn("verdict", _verdict(F.col("pearson_r")))
