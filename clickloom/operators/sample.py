"""User and row samples. Every draw is a hash of the row's own key, so it can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.functions import count_type, is_type


def _users(ev: DataFrame) -> DataFrame:
    return ev.select("user_id").where(F.col("user_id").isNotNull()).distinct()


def _events_of(ev: DataFrame, users: DataFrame) -> DataFrame:
    return ev.join(users.select("user_id"), "user_id", "left_semi").select(*ev.columns)


def sample_users_random(ev: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All events of n random users."""
    return _events_of(ev, scale.first_rows(_users(ev), scale.draw(seed, "user_id"), n, [F.asc("user_id")]))


def hashed_users(ev: DataFrame, n: int) -> DataFrame:
    """The n users with the smallest fingerprint."""
    mark = F.md5(F.col("user_id").cast("string"))
    start = F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")
    return scale.first_rows(_users(ev), start, n, [mark, F.asc("user_id")])


def sample_users_hash(ev: DataFrame, n: int) -> DataFrame:
    return _events_of(ev, hashed_users(ev, n))


def eligible_users(ev: DataFrame, min_events: int = 5) -> DataFrame:
    counts = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("event_count"))
    return counts.where(F.col("event_count") >= min_events)


def sample_to_rows(ev: DataFrame, target_rows: int, seed: int = 42, min_events: int = 5) -> DataFrame:
    """About ``target_rows`` rows: int(target / mean events) random eligible users, all their events."""
    eligible = eligible_users(ev, min_events)
    mean = eligible.agg(F.avg("event_count")).first()[0]
    n = int(target_rows / mean) if mean else 0
    return _events_of(ev, scale.first_rows(eligible, scale.draw(seed, "user_id"), n, [F.asc("user_id")]))


def sample_quality(frames: dict[str, DataFrame]) -> DataFrame:
    """Side-by-side profile of the full table and its samples."""
    out = None
    for name, df in frames.items():
        n = F.count(F.lit(1))
        one = df.agg(
            n.alias("n_rows"),
            F.count_distinct("user_id").alias("users"),
            F.count_distinct("product_id").alias("products"),
            *[F.round(count_type(t) * 100 / n, 4).alias(f"{t}_pct") for t in ("view", "cart", "purchase")],
            F.round(F.count_if(F.col("category_code").isNull()) * 100 / n, 4).alias("null_category_pct"),
            F.round(F.count_if(F.col("brand").isNull()) * 100 / n, 4).alias("null_brand_pct"),
        ).select(F.lit(name).alias("sample"), "*", F.round(F.col("n_rows") / F.col("users"), 4).alias("events_per_user"))
        out = one if out is None else out.unionByName(one)
    return out


def sample_profile(ev: DataFrame) -> DataFrame:
    return ev.agg(
        F.count_distinct("user_id").alias("users"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("product_id").alias("items"),
        F.min("event_time").alias("min_time"),
        F.max("event_time").alias("max_time"),
    )


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows by hash order of their key columns."""
    return scale.first_rows(df, scale.draw(seed, *key), n, [F.asc(k) for k in key])


def cap_per_key(df: DataFrame, key: str, n: int, by: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows per key, in hash order of ``by``."""
    return scale.top_many_per_key(df, [key], [scale.draw(seed, *by), *[F.col(c) for c in by]], n, "_pick").drop("_pick")


def draw_from_pool(keys: DataFrame, pool: DataFrame, item: str, n: int, seed: int = 42) -> DataFrame:
    """n different pool members per key row, addressed by a dense index instead of a per-row pool.

    The draws of a key start at a hashed position and step through the pool in n equal strides, so
    they differ as long as the pool has n members.
    """
    indexed = scale.add_position(pool.select(item).distinct(), [F.col(item)], "_at", 0)
    size = indexed.agg(F.count(F.lit(1)).alias("c")).scalar()
    drawn = keys.withColumn("_size", size).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_size").cast("int")) - 1))
    )
    stride = F.floor(F.col("_size") / F.lit(n)) if n > 1 else F.lit(1)
    at = F.pmod(scale.draw(seed, *keys.columns) + F.col("_k") * F.greatest(stride, F.lit(1)), F.col("_size"))
    return drawn.withColumn("_at", at.cast("long")).join(indexed, "_at").select(*keys.columns, F.col("_k").alias("draw"), item)
