"""Two event logs derived from the warehouse tables, in the nine-column click schema.

``clicks`` is small and dirty: whole-table exact copies, one-second re-emissions, null categories,
brands and sessions, and event types the encoders do not know. ``baskets`` is large and clean. The
remainders below only decide which rows are additionally copied or blanked; every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and brand text per part, computed on the dimension before it meets the events."""
    second_word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("long").alias("category_id"),
        F.concat_ws(".", F.lower("p_type"), second_word).alias("category_code"),
        F.lower("p_brand").alias("brand"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    base = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
    )
    session = F.concat_ws(
        "-", F.col("user_id").cast("string"), F.date_trunc("week", "event_time").cast("date").cast("string")
    )
    rich = base.join(scale.as_whole(_catalog(spark, sf_dir)), "product_id").select(
        "event_id",
        "event_time",
        "event_type",
        "product_id",
        "category_id",
        F.when(F.col("product_id") % 6 != 0, F.col("category_code")).alias("category_code"),
        F.when(F.col("product_id") % 7 != 0, F.col("brand")).alias("brand"),
        "price",
        "user_id",
        F.when(F.col("event_id") % 997 != 0, session).alias("user_session"),
    )
    # Each row once, plus an exact copy and a copy one second later for some: one scan, no union.
    shifts = F.array_compact(
        F.array(F.lit(0), F.when(F.col("event_id") % 50 == 0, 0), F.when(F.col("event_id") % 70 == 0, 1))
    )
    shown = rich.withColumn("_shift", F.explode(shifts))
    return shown.withColumn("event_time", F.col("event_time") + F.make_dt_interval(secs=F.col("_shift"))).drop("_shift")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    kind = F.col("l_returnflag")
    return (
        lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(scale.as_whole(_catalog(spark, sf_dir)), F.col("product_id") == F.col("l_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_linenumber"))).alias("event_time"),
            F.when(kind == "N", "view").when(kind == "A", "cart").otherwise("purchase").alias("event_type"),
            "product_id",
            "category_id",
            "category_code",
            "brand",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").cast("string").alias("user_session"),
        )
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_idx, vec)`` from the embedding table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_idx"), F.col("embedding").alias("vec"))
