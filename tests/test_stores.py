"""Bucketed tables, the table of runs, the tolerant load in one pass, catalog cents."""

import pytest
from pyspark.sql import functions as F

from clickloom import functions as fn
from clickloom import scale
from clickloom.sources import files


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(500).select((F.col("id") % 40).alias("user"), "id")
    right = spark.range(40).select(F.col("id").alias("user"), (F.col("id") * 2).alias("twice"))
    tables = [files.save_bucketed(df, f"clickloom_test_buckets_{k}", "user", 4, scale.scratch_path(spark, "buckets")) for k, df in enumerate((left, right))]
    joined = tables[0].join(tables[1].hint("merge"), "user").groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.user, r.n, r.twice) for r in joined.collect()) == [(u, 13 if u < 20 else 12, 2 * u) for u in range(40)]
    for k in range(2):
        spark.sql(f"DROP TABLE clickloom_test_buckets_{k}")


def test_runs_append_and_the_last_writing_counts(spark):
    path = scale.scratch_path(spark, "runs")
    for run, epoch, loss in (("a", 1, 3.0), ("a", 2, 2.0), ("b", 1, 5.0), ("a", 2, 1.0)):
        files.append_metrics(spark.createDataFrame([(run, epoch, loss, 0.5)], "run string, epoch int, loss double, recall double"), path)
    rows = sorted((r.run, r.epoch, r.loss) for r in files.read_metrics(spark, path).collect())
    assert rows == [("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, 5.0)]


def test_the_tolerant_load_parses_once(spark, tmp_path, monkeypatch):
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
    good = "2019-10-01 00:00:00 UTC,view,1,2,,,3.5,4,s"
    (tmp_path / "x.csv").write_text("\n".join([head, good, "no time,view,1,2,,,3.5,4,s", good, "2019-10-01 00:00:00 UTC,view,x,2,,,3.5,4,s"]) + "\n")
    events, rejects = files.load_with_rejects(spark, str(tmp_path / "x.csv"))
    assert events.count() == 2 and rejects.count() == 2
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (events, rejects)]
    assert all("csv" not in p.lower() for p in plans)
    with pytest.raises(ValueError, match="2 malformed rows"):
        files.load_with_rejects(spark, str(tmp_path / "x.csv"), max_bad=1)


def test_catalog_prices_round_half_a_cent_up(spark):
    rows = [(1, 2551.095), (2, 2551.0949999999998), (3, 1.004), (4, 2.675), (5, None)]
    items = spark.createDataFrame([(i, "a", "b", "lg", p, 1) for i, p in rows], "product_id long, cat_l1 string, cat_l2 string, brand string, avg_price double, item_total_confidence long")
    got = {int(r.item_id): r.price for r in files.build_catalog(items).collect()}
    assert got == {1: 2551.1, 2: 2551.1, 3: 1.0, 4: 2.68, 5: 0.0}


def test_vectors_and_sets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "g long, v array<float>")
    got = {r.g: (r.m, r.s) for r in df.groupBy("g").agg(fn.mean_vector("v").alias("m"), fn.sum_vector("v").alias("s")).collect()}
    assert got == {1: ([2.0, 3.0], [4.0, 6.0]), 2: ([5.0, 5.0], [5.0, 5.0])}
    many = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 70_001).alias("v"))
    want = {r.g: r.n for r in many.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert {r.g: r.n for r in fn.distinct_by_bitmap(many, ["g"], "v", "n").collect()} == want
