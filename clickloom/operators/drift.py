"""Item-popularity drift between a reference window and a later one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import Config
from clickloom.functions import n_rows

EPSILON = 1e-10  # fixed value: added to every share before renormalising


class DriftAlert(RuntimeError):
    """Raised by :func:`raise_on_alert`."""


def item_shares(window: DataFrame) -> DataFrame:
    """(item_id, n, share)."""
    counts = window.groupBy("item_id").agg(n_rows().alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def popularity(window: DataFrame) -> DataFrame:
    """Shares with their rank; equal counts rank by item id."""
    return scale.add_position(item_shares(window), [F.desc("n"), F.asc("item_id")], "rank")


def aligned(p: DataFrame, q: DataFrame) -> DataFrame:
    """Both windows over the union of their items, absent items 0."""
    a, b = p.select("item_id", F.col("share").alias("p")), q.select("item_id", F.col("share").alias("q"))
    both = a.join(b, "item_id", "full_outer")
    return both.select("item_id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def jsd(p: DataFrame, q: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Jensen-Shannon divergence in [0, 1], smoothed by ``eps`` over the union of items."""
    both = aligned(p, q)
    size = both.agg(n_rows().alias("c")).scalar()
    smooth = 1 + F.lit(eps) * F.col("_u")
    a, b = (F.col("p") + eps) / smooth, (F.col("q") + eps) / smooth
    m = (a + b) / 2
    value = (F.sum(a * F.ln(a / m)) + F.sum(b * F.ln(b / m))) / 2 / math.log(2)
    return both.withColumn("_u", size).agg(value.alias("jsd"))


def _top(p: DataFrame, n: int) -> DataFrame:
    return p.orderBy(F.desc("n"), F.asc("item_id")).limit(n)


def top_overlap(p: DataFrame, q: DataFrame, n: int = Config.drift_top_n) -> DataFrame:
    shared = _top(p, n).join(_top(q, n).select("item_id"), "item_id", "left_semi")
    return shared.agg((n_rows() * 100.0 / n).alias("overlap_pct"))


def coverage(p: DataFrame, q: DataFrame) -> DataFrame:
    """Percentage of test-window items that occur in the reference window."""
    hit = q.select("item_id").join(p.select("item_id", F.lit(1).alias("hit")), "item_id", "left")
    return hit.agg(F.coalesce(F.try_divide(F.count("hit") * 100.0, n_rows()), F.lit(0.0)).alias("coverage_pct"))


def drift_report(
    train: DataFrame, test: DataFrame, threshold: float = Config.drift_threshold, n: int = Config.drift_top_n, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """One record: divergence, overlap, coverage, sizes, verdict, narrative and both top-20 lists."""
    # One row per item each, read by every figure below: written once.
    p, q = scale.cut_lineage(item_shares(train)), scale.cut_lineage(item_shares(test))

    def top20(side: DataFrame, field: str) -> Column:
        packed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "item_id", "share")))
        return _top(side, 20).agg(F.transform(packed, lambda x: x[field]).alias("a")).scalar()

    row = jsd(p, q).withColumns(
        {
            "overlap": top_overlap(p, q, n).scalar(),
            "coverage": coverage(p, q).scalar(),
            "n_train_items": p.agg(n_rows().alias("c")).scalar(),
            "n_test_items": q.agg(n_rows().alias("c")).scalar(),
            "n_train_events": p.agg(F.sum("n").alias("c")).scalar(),
            "n_test_events": q.agg(F.sum("n").alias("c")).scalar(),
            "train_top20_items": top20(p, "item_id"),
            "train_top20_probs": top20(p, "share"),
            "test_top20_items": top20(q, "item_id"),
            "test_top20_probs": top20(q, "share"),
        }
    )
    alert = F.col("jsd") > threshold
    story = F.concat(
        F.lit("Divergence "), F.format_number("jsd", 3), F.when(alert, " is above").otherwise(" is within"),
        F.lit(f" the threshold {threshold:g}: "), F.when(alert, "the item distribution has shifted").otherwise("the item distribution is stable"),
    )
    return row.select(
        F.lit(names[0]).alias("train_window"), F.lit(names[1]).alias("test_window"), F.round("jsd", 4).alias("jsd_normalized"),
        F.round("overlap", 1).alias("top_item_overlap_pct"), F.round("coverage", 1).alias("test_item_coverage_pct"),
        "n_train_items", "n_test_items", "n_train_events", "n_test_events", alert.alias("alert"), F.lit(float(threshold)).alias("alert_threshold"),
        story.alias("narrative"), "train_top20_items", "train_top20_probs", "test_top20_items", "test_top20_probs",
    )


def raise_on_alert(report: DataFrame) -> DataFrame:
    """Fail the job when the one-row report carries an alert."""
    row = report.first()
    if row["alert"]:
        raise DriftAlert(row["narrative"])
    return report


def top_share_table(p: DataFrame, q: DataFrame, n: int = 20) -> DataFrame:
    """Reference top-n with its share in both windows (0 outside the other window's top n)."""
    a = _top(p, n).select("item_id", F.col("share").alias("train_share"))
    b = _top(q, n).select("item_id", F.col("share").alias("test_share"))
    return a.join(b, "item_id", "left").select("item_id", "train_share", F.coalesce("test_share", F.lit(0.0)).alias("test_share"))


def rank_shift(p: DataFrame, q: DataFrame, n: int = 20) -> DataFrame:
    """Ranks of the items that are in both top-n lists."""
    def ranks(side: DataFrame, name: str) -> DataFrame:
        packed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "item_id")))
        return _top(side, n).agg(packed.alias("l")).select(F.posexplode("l").alias("_at", "r")).select(
            F.col("r.item_id").alias("item_id"), (F.col("_at") + 1).alias(name)
        )

    both = ranks(p, "train_rank").join(ranks(q, "test_rank"), "item_id")
    return both.withColumn("shift", F.col("test_rank") - F.col("train_rank"))
