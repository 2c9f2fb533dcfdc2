"""Temporal splits, the interaction matrix, and the reports that gate them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.config import EVENT_WEIGHTS, Config
from clickloom.functions import count_type
from clickloom.sources.files import month_range

COUNT = F.count


def _moment(v) -> Column:
    return F.lit(datetime.fromisoformat(v) if isinstance(v, str) else v)


def temporal_split(ev: DataFrame, train_months: Sequence[str], test_month: str) -> tuple[DataFrame, DataFrame]:
    """Months as ranges on event_time rather than on a formatted string, so scans can be pruned."""
    time = F.col("event_time")
    inside = F.lit(False)
    for m in train_months:
        inside = inside | month_range(time, m)
    return ev.where(inside), ev.where(month_range(time, test_month))


def three_way_split(ev: DataFrame, val_start, test_start) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, v, s = F.col("event_time"), _moment(val_start), _moment(test_start)
    return ev.where(t < v), ev.where((t >= v) & (t < s)), ev.where(t >= s)


def leave_one_out(ev: DataFrame, min_purchases: int = 2) -> tuple[DataFrame, DataFrame]:
    """Hold out each user's last purchase where the user has enough of them."""
    bought = ev.where(F.col("event_type") == "purchase")
    order = F.struct("event_time", "event_id")
    last = (
        bought.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
        .where(F.col("n") >= min_purchases)
        .select("user_id", F.col("last.event_time").alias("event_time"), F.col("last.event_id").alias("event_id"))
    )
    mark = last.withColumn("event_type", F.lit("purchase"))
    keys = ["user_id", "event_time", "event_id", "event_type"]
    return ev.join(mark, keys, "left_anti").select(*ev.columns), ev.join(mark, keys, "left_semi").select(*ev.columns)


def interactions(ev: DataFrame, weights: dict | None = None) -> DataFrame:
    """Confidence-weighted (user, item) matrix; event types without a weight count zero."""
    weights = weights or EVENT_WEIGHTS
    score = sum((count_type(t) * w for t, w in weights.items()), F.lit(0))
    return ev.groupBy("user_id", "product_id").agg(
        score.cast("long").alias("confidence_score"),
        count_type("view").alias("n_views"),
        count_type("cart").alias("n_carts"),
        count_type("purchase").alias("n_purchases"),
        F.min("event_time").alias("first_interaction"),
        F.max("event_time").alias("last_interaction"),
    )


def split_report(train: DataFrame, test: DataFrame, low: float = 65.0, high: float = 85.0) -> DataFrame:
    """Rows and users per side and the share of test users already seen in training."""
    sides = train.select("user_id", F.lit(1).alias("tr"), F.lit(0).alias("te")).unionByName(
        test.select("user_id", F.lit(0).alias("tr"), F.lit(1).alias("te"))
    )
    per_user = sides.groupBy("user_id").agg(F.sum("tr").alias("tr"), F.sum("te").alias("te"))
    both = (F.col("tr") > 0) & (F.col("te") > 0)
    out = per_user.agg(
        F.sum("tr").alias("train_rows"),
        F.sum("te").alias("test_rows"),
        F.count_if(F.col("tr") > 0).alias("train_users"),
        F.count_if(F.col("te") > 0).alias("test_users"),
        F.count_if(both).alias("overlap_users"),
    ).withColumn("overlap_pct", F.round(F.try_divide("overlap_users", "test_users") * 100, 4))
    return out.withColumn("verdict", F.when(F.col("overlap_pct").between(low, high), "PASS").otherwise("FAIL"))


def interaction_report(im: DataFrame, min_sparsity: float = 99.0) -> DataFrame:
    n = F.count(F.lit(1))
    score = F.col("confidence_score")
    out = im.agg(
        n.alias("pairs"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("product_id").alias("items"),
        F.round(F.avg(score), 4).alias("avg_score"),
        F.max(score).alias("max_score"),
        F.round(F.count_if(score == 1) * 100 / n, 4).alias("pct_score_1"),
        F.round(F.count_if(score == 2) * 100 / n, 4).alias("pct_score_2"),
        F.round(F.count_if(score >= 4) * 100 / n, 4).alias("pct_score_4_up"),
    )
    cells = F.col("users").cast("double") * F.col("items")
    out = out.withColumn("sparsity_pct", F.round((1 - F.col("pairs") / cells) * 100, 6))
    return out.withColumn("verdict", F.when(F.col("sparsity_pct") > min_sparsity, "PASS").otherwise("FAIL"))


def load_sanity(ev: DataFrame) -> DataFrame:
    return ev.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("product_id").alias("products"),
        count_type("view").alias("views"),
        count_type("cart").alias("carts"),
        count_type("purchase").alias("purchases"),
        F.min("event_time").alias("min_time"),
        F.max("event_time").alias("max_time"),
    )


# The accepted sizes of the cleaned production table.
CLEAN_BOUNDS = {"total_rows": (270_000_000, 290_000_000), "unique_users": (7_000_000, 8_000_000),
                "unique_items": (260_000, 310_000)}


def validate_clean(ev: DataFrame, bounds: dict | None = None, bot_per_day: float = Config.bot_events_per_day) -> DataFrame:
    """Eight PASS/FAIL rows over the cleaned table, plus the informational counts as INFO rows."""
    bounds = bounds or CLEAN_BOUNDS
    base = ev.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("product_id").alias("unique_items"),
        F.count_if(F.col("price") < 1.0).alias("price_below_1"),
        F.count_if(F.col("user_session").isNull()).alias("null_user_session"),
        F.count_if(F.col("category_code").isNull()).alias("null_category_code"),
        F.count_if(F.col("brand").isNull()).alias("null_brand"),
        count_type("view").alias("views"),
        count_type("cart").alias("carts"),
        count_type("purchase").alias("purchases"),
        F.unix_seconds(F.min("event_time")).alias("min_event_second"),
        F.unix_seconds(F.max("event_time")).alias("max_event_second"),
    )
    from clickloom.operators.clean import bot_users

    base = base.withColumn("bot_user_count", bot_users(ev, bot_per_day).agg(F.count(F.lit(1)).alias("c")).scalar())
    zero = ("price_below_1", "null_user_session", "null_category_code", "null_brand", "bot_user_count")

    def row(name: str) -> Column:
        value = F.col(name).cast("long")
        if name in bounds:
            status = F.when(value.between(*bounds[name]), "PASS").otherwise("FAIL")
        elif name in zero:
            status = F.when(value == 0, "PASS").otherwise("FAIL")
        else:
            status = F.lit("INFO")
        return F.struct(F.lit(name).alias("check_name"), value.alias("actual"), status.alias("status"))

    return base.select(F.inline(F.array(*[row(c) for c in base.columns])))
