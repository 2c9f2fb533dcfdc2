"""The skew-safe helpers against plain windows and numpy, on skewed random data."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom import scale


@pytest.fixture(scope="module")
def log(spark):
    """A third of the rows belong to one key; times repeat and cross days."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 12)
        rows.append((i, key, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 400_000)), rng.randrange(5)))
    return spark.createDataFrame(rows, "id long, key long, at timestamp, v long").cache()


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_with_previous_equals_lag(log):
    got = scale.with_previous(log, ["key"], "at", ["id"], {"prev": "v"})
    want = log.withColumn("prev", F.lag("v").over(Window.partitionBy("key").orderBy("at", "id")))
    key = [(r.id, r.prev) for r in got.collect()]
    assert sorted(key, key=str) == sorted([(r.id, r.prev) for r in want.collect()], key=str)
    assert set(got.columns) == {*log.columns, "prev"}


def test_with_running_sum_equals_window(log):
    got = scale.with_running_sum(log, ["key"], "at", ["id"], F.col("v"), "total")
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(got, "id", "total") == rows_of(log.withColumn("total", F.sum("v").over(w)), "id", "total")


def hot_day(spark):
    """One key holds a third of the rows, all within one second of one day."""
    rows = [(i, i % 3 and i, datetime(2024, 1, 1, 12) + timedelta(microseconds=i % 7), i % 5) for i in range(9_000)]
    return spark.createDataFrame(rows, "id long, key long, at timestamp, v long")


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart, as ranges of a large table do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_and_day_spreads_over_all_ranges(spark, uncoalesced):
    blocks, _, _ = scale._scanned(hot_day(spark), ["key"], "at", ["id"])
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 9_000 / 8
    hot = [r["count"] for r in blocks.where("key = 0").groupBy("_block").count().collect()]
    assert sum(hot) == 3_000 and len(hot) >= 3


def test_scans_of_a_hot_key_and_day(spark, uncoalesced):
    df = hot_day(spark)
    w = Window.partitionBy("key").orderBy("at", "id")
    want = df.withColumns({"prev": F.lag("v").over(w), "total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    got = scale.with_running_sum(scale.with_previous(df, ["key"], "at", ["id"], {"prev": "v"}), ["key"], "at", ["id"], F.col("v"), "total")
    assert sorted(map(tuple, got.select("id", "prev", "total").collect()), key=str) == sorted(map(tuple, want.select("id", "prev", "total").collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 40, 41, 42, 999, 1_500, 1_501, 5_000])
@pytest.mark.parametrize("steps", [4, 4_096])
def test_first_rows_by_histogram(spark, n, steps):
    # Half of the values are one and the same.
    df = spark.range(1_500).withColumn("h", F.when(F.col("id") % 2 == 0, F.lit(123_456)).otherwise(scale.draw(3, "id")))
    got = [r.id for r in scale.first_rows(df, F.col("h"), n, [F.desc("id")], steps).collect()]
    want = [r.id for r in sorted(df.collect(), key=lambda r: (r.h, -r.id))[:n]]
    assert sorted(got) == sorted(want)


def test_first_rows_orders_the_last_step_only(spark):
    df = spark.range(200_000)
    plan = scale.first_rows(df, scale.draw(1, "id"), 100_000, [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan


def test_null_keys_stay_together(spark):
    df = spark.createDataFrame([(1, None, datetime(2024, 1, 1)), (2, None, datetime(2024, 1, 5))], "id long, key string, at timestamp")
    got = {r.id: r.prev for r in scale.with_previous(df, ["key"], "at", ["id"], {"prev": "id"}).collect()}
    assert got == {1: None, 2: 1}


def test_add_position_is_dense_and_ordered(log):
    got = scale.add_position(log.select("v", "id"), [F.desc("v"), F.asc("id")], "p").collect()
    ordered = sorted(got, key=lambda r: r.p)
    assert [r.p for r in ordered] == list(range(1, 601))
    assert [(r.v, r.id) for r in ordered] == sorted([(r.v, r.id) for r in got], key=lambda x: (-x[0], x[1]))


def test_add_running_total(log):
    got = sorted(scale.add_running_total(log.select("id", "v"), [F.col("id")], "v", "t", "p").collect(), key=lambda r: r.id)
    assert [r.t for r in got] == list(np.cumsum([r.v for r in got]))
    assert [r.p for r in got] == list(range(1, 601))


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_percentiles_equal_numpy(spark, n):
    rng = random.Random(n)
    values = [round(rng.uniform(-5, 5), 2) for _ in range(n)] + ([1.0] * (n // 2))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    row = scale.percentiles(df, "x", points).first()
    assert np.allclose([row[scale.percentile_name(p)] for p in points], np.percentile(values, [p * 100 for p in points]))


def test_top_per_key_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id"))
    got = scale.top_per_key(df, ["k"], [F.desc("id")], 1500)
    assert got.count() == 3000
    assert got.groupBy("k").agg(F.min("id").alias("m")).orderBy("k").collect()[0].m == 2000


def test_salted_join_equals_join(log):
    dim = log.select("key").distinct().where("key < 8").withColumn("name", F.concat(F.lit("n"), "key"))
    for how in ("left", "inner"):
        assert sorted(map(str, scale.salted_join(log, dim, ["key"], how).select("id", "name").collect())) == sorted(
            map(str, log.join(dim, "key", how).select("id", "name").collect())
        )


def test_draw_depends_only_on_the_key(log):
    a = {r.id: r.d for r in log.select("id", scale.draw(1, "id").alias("d")).collect()}
    b = {r.id: r.d for r in log.repartition(5).select("id", scale.draw(1, "id").alias("d")).collect()}
    assert a == b and len(set(a.values())) == 600


def test_checkpoints_use_the_configured_folder(spark, log):
    scale.cut_lineage(log.select("id"))
    assert spark.sparkContext.getCheckpointDir()


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_counts_the_copies_of_a_stored_table(spark, log):
    """Files of half a megabyte are four with their copies: they are shuffled, not sent through the driver."""
    big = spark.range(100).select(F.col("id").alias("key"))
    for rows, sent in ((60_000, False), (100, True)):
        small = scale.cut_lineage(spark.range(rows).select(F.col("id").alias("key"), F.xxhash64("id").alias("v")))
        joined = scale.salted_join(big, small, ["key"], "inner")
        assert ("BroadcastHashJoin" in joins(joined)) == sent
        assert joined.count() == 100


def test_a_large_table_is_not_sent_with_fewer_columns(spark):
    text = F.concat_ws("-", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(8)])
    whole = scale.cut_lineage(spark.range(60_000).select("id", *[text.alias(f"t{i}") for i in range(3)]))
    rows = spark.range(50)
    size, most = scale._estimated(whole)
    assert size > most > 0
    assert "BroadcastHashJoin" in joins(spark.range(50_000_000).join(scale.as_whole(rows), "id"))
    assert "BroadcastHashJoin" not in joins(spark.range(50_000_000).join(scale.as_whole(whole), "id").select("id"))
