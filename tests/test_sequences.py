"""Sequences, features, files and drift on hand-made rows."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.functions import brand_title, left_pad, tail
from clickloom.operators import drift, features, sequences, verify
from clickloom.sources import files

T0 = datetime(2024, 1, 1, 23, 59, 0)
MAPPED = "event_id long, event_time timestamp, user_idx long, user_session string, item_idx long, event_idx long"


def mapped(spark, items, events, gap=30):
    rows = [(i, T0 + timedelta(seconds=gap * i), 1, "s", a, b) for i, (a, b) in enumerate(zip(items, events))]
    return spark.createDataFrame(rows, MAPPED)


def test_repeats_collapse_to_their_first(spark):
    seq = sequences.session_sequences(mapped(spark, [7, 7, 7, 8, 8, 9], [1, 1, 2, 1, 2, 1])).first()
    assert (seq.item_seq, seq.event_seq, seq.seq_len) == ([7, 8, 9], [1, 1, 1], 3)


def test_repeats_are_removed_before_the_cut_and_the_filter(spark):
    seq = sequences.session_sequences(mapped(spark, [1, 2, 3, 3, 3, 3], [1] * 6), max_len=3).first()
    assert seq.item_seq == [1, 2, 3]
    assert sequences.session_sequences(mapped(spark, [4, 4, 4], [1] * 3)).count() == 0


def test_prefix_target_has_one_position_less(spark):
    row = sequences.prefix_target(spark.createDataFrame([(1, [1, 2, 3], [1, 1, 2])], "user_idx long, item_seq array<long>, event_seq array<long>"), 5).first()
    assert (row.prefix_items, row.target) == ([0, 0, 1, 2], 3)


def test_shift_targets(spark):
    row = sequences.shift_targets(spark.createDataFrame([(1, [1, 2, 3], [1, 1, 2])], "user_idx long, item_seq array<long>, event_seq array<long>"), 5).first()
    assert (row.input_items, row.target_items, row.mask) == ([0, 0, 1, 2], [0, 1, 2, 3], [False, True, True, True])


def test_tail_and_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<long>")
    row = df.select(tail("a", 20).alias("long"), tail("a", 2).alias("short"), left_pad("a", 2).alias("cut"), left_pad("a", 5).alias("pad")).first()
    assert (row.long, row.short, row.cut, row.pad) == ([1, 2, 3], [2, 3], [2, 3], [0, 0, 1, 2, 3])


def test_user_sequences_continue_in_chunks(spark):
    rows = sequences.user_sequences(mapped(spark, list(range(1, 8)), [1] * 7), chunk=3).orderBy("chunk").collect()
    assert [r.item_seq for r in rows] == [[1, 2, 3], [4, 5, 6], [7]]
    assert {r.seq_len for r in rows} == {7}


def test_prefix_pairs(spark):
    seq = sequences.session_sequences(mapped(spark, [1, 2, 3], [1] * 3))
    assert sorted((r.prefix, r.target) for r in sequences.prefix_pairs(seq).collect()) == [([1], 2), ([1, 2], 3)]


def test_validate_sequences_counts_broken_rows(spark):
    rows = [(1, [1, 2], [1, 1]), (2, [1, 1], [1, 1]), (3, [1], [1]), (4, [1, 0], [1, 1])]
    row = sequences.validate_sequences(spark.createDataFrame(rows, "user_idx long, item_seq array<long>, event_seq array<long>"), 2, 20, 4).first()
    assert (row.adjacent_repeats, row.too_short, row.pad_last, row.rows_match) == (1, 1, 1, True)


def test_sessionize_by_gap(spark):
    times = [0, 100, 1900, 3700, 90_000]
    ev = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1) for i, s in enumerate(times)], "event_id long, event_time timestamp, user_id long")
    out = {r.event_id: r.session_no for r in sequences.sessionize(ev).collect()}
    assert out == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}


def test_sessions_survive_a_round_trip(spark, tmp_path):
    seq = sequences.session_sequences(mapped(spark, [1, 2, 3], [1] * 3))
    sequences.save_sessions({"train": seq, "val": seq, "test": seq}, str(tmp_path))
    back = files.load_sessions(spark, str(tmp_path))
    assert back["train_sessions"].first().item_seq == [1, 2, 3]
    assert back["metadata"].first().n_val == 1


def test_vocabularies(spark):
    df = spark.createDataFrame([(30, "b"), (10, "unknown"), (20, None), (10, "a")], "id long, c string")
    assert {tuple(r) for r in features.id_vocab(df, "id", 1).collect()} == {(10, 1), (20, 2), (30, 3)}
    assert {tuple(r) for r in features.str_vocab(df, "c").collect()} == {("unknown", 0), ("a", 1), ("b", 2)}


def test_scaling_uses_population_deviation_and_survives_constants(spark):
    out = features.standard_scale(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double"), {"zx": F.col("x"), "zy": F.col("y")})
    assert sorted((r.zx, r.zy) for r in out.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_centroid_of_strong_pairs_or_zero(spark):
    tp = spark.createDataFrame([(1, 1, 2), (1, 2, 4), (2, 1, 1)], "user_idx long, item_idx long, confidence_score long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_idx long, vec array<double>")
    out = {r.user_idx: (r.centroid, r.n_items) for r in features.user_centroid(tp, vecs, 2).collect()}
    assert out == {1: ([0.5, 0.5], 2), 2: ([0.0, 0.0], 0)}


def test_brand_title(spark):
    df = spark.createDataFrame([("lg electronics",), ("  usb hub ",), (None,), ("",)], "b string")
    assert [r[0] for r in df.select(brand_title("b")).collect()] == ["LG Electronics", "USB Hub", "Unknown", "Unknown"]


def test_pareto_counts_rows_inside_ties(spark):
    df = spark.createDataFrame([(n,) for n in (5, 1, 1, 1, 1, 1)], "n_purchases long")
    out = {r.threshold: r["rank"] for r in verify.pareto(df).collect()}
    assert out == {0.5: 1, 0.8: 4, 0.9: 5}


def shares(spark, ids):
    return drift.item_shares(spark.createDataFrame([(i,) for i in ids], "item_id long"))


def test_divergence_bounds(spark):
    a, b = shares(spark, [1, 1, 2]), shares(spark, [8, 9])
    assert drift.jsd(a, a).first().jsd == pytest.approx(0, abs=1e-12)
    assert drift.jsd(a, b).first().jsd == pytest.approx(1, abs=1e-6)
    assert math.isclose(drift.jsd(a, b).first().jsd, drift.jsd(b, a).first().jsd)


def test_drift_alert_raises(spark):
    one, two = (spark.createDataFrame([(i,) for i in ids], "item_id long") for ids in ([1, 1, 2], [8, 9]))
    assert drift.raise_on_alert(drift.drift_report(one, one)).first().alert is False
    with pytest.raises(drift.DriftAlert):
        drift.raise_on_alert(drift.drift_report(one, two))


CSV = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
GOOD = "2020-01-01 00:00:01 UTC,view,1,2,a.b,,3.5,4,s\n"


def test_tolerant_load_drops_bad_rows_within_the_budget(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(CSV + GOOD + "2020-01-01 00:00:02 UTC,view,x,2,a.b,,3.5,4,s\n" + "nonsense,view,1,2,a.b,,3.5,4,s\n" + "short,row\n")
    rows = files.load_events(spark, str(path), max_bad=3).collect()
    assert len(rows) == 1 and rows[0].brand is None and rows[0].price == 3.5
    with pytest.raises(ValueError):
        files.load_events(spark, str(path), max_bad=2)


def test_split_holdout():
    train, held = files.split_holdout(["/x/2019-Oct.csv", "/x/2020-Mar.csv", "/x/2020-Apr.csv.gz"])
    assert (train, held) == (["/x/2019-Oct.csv"], ["/x/2020-Mar.csv", "/x/2020-Apr.csv.gz"])


def test_window_accepts_either_item_column(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 31, 23)), (2, datetime(2020, 2, 1))], "item_id long, event_time timestamp")
    assert [r.item_id for r in files.load_window(df, "2020-01").collect()] == [1]
    assert [r.item_id for r in files.load_window(df.withColumnRenamed("item_id", "product_id"), "2020-02").collect()] == [2]
    with pytest.raises(ValueError):
        files.load_window(df.drop("item_id"), "2020-01")


def test_sorted_export_keeps_order(spark, tmp_path):
    files.export_sorted(spark.range(100).orderBy(F.desc("id")), str(tmp_path / "o"), "id")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 100


def test_prefix_of_a_history_longer_than_a_chunk(spark):
    long = mapped(spark, list(range(1, 10_002)), [1] * 10_001)
    users = long.select("user_idx").distinct()
    row = sequences.user_prefix(users, long, 5).first()
    assert row.prefix_items == [9997, 9998, 9999, 10000, 10001] and row.has_history


def test_chunks_are_not_taken_for_sequences(spark):
    chunked = sequences.user_sequences(mapped(spark, list(range(1, 8)), [1] * 7), chunk=3)
    for step in (sequences.shift_targets, sequences.prefix_target):
        with pytest.raises(ValueError):
            step(chunked, 5)


def test_rejected_rows_come_back_with_a_reason(spark, tmp_path):
    header = ",".join(f.name for f in files.RAW_EVENT_SCHEMA.fields)
    width = len(files.RAW_EVENT_SCHEMA.fields)
    good = ["2019-11-01 00:00:00 UTC", "view"] + ["1"] * (width - 2)
    (tmp_path / "a.csv").write_text("\n".join([header, ",".join(good), "not a time,view" + ",1" * (width - 2), ",".join(good + ["more", "fields"])]))
    events, rejects = files.load_with_rejects(spark, str(tmp_path / "a.csv"))
    assert events.count() == 1
    assert sorted(r.reason for r in rejects.collect()) == ["event_time is no time", "fields do not match the columns"]


def test_reports_keep_every_record(spark, tmp_path):
    files.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_table_size_is_read_from_the_catalog(spark, tmp_path):
    spark.range(100).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("sized")
    spark.sql("ANALYZE TABLE sized COMPUTE STATISTICS")
    assert files.table_size(spark, "sized") > 100
    spark.sql("DROP TABLE sized")
