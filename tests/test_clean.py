"""Hand-computed cases for filters, duplicates, bots and k-core."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import Config
from clickloom.operators import clean, tables

T0 = datetime(2024, 1, 1, 23, 59, 50)
SCHEMA = ("event_id long, event_time timestamp, event_type string, product_id long, category_id long, category_code string, "
          "brand string, price double, user_id long, user_session string")


def events(spark, rows):
    """(seconds after T0, type, product, user) rows with defaults for the rest."""
    full = [(i, T0 + timedelta(seconds=s), kind, p, 1, None, None, 10.0, u, "s") for i, (s, kind, p, u) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_near_dedup_compares_with_the_previous_raw_row(spark):
    ev = events(spark, [(0, "view", 1, 1), (1, "view", 1, 1), (2, "view", 1, 1), (5, "view", 1, 1)])
    assert ids(clean.near_dedup(ev)) == [0, 3]


def test_near_dedup_sees_across_midnight(spark):
    ev = events(spark, [(9, "view", 1, 1), (10, "view", 1, 1), (12, "view", 1, 1)])
    assert ids(clean.near_dedup(ev)) == [0, 2]


def test_near_dedup_keeps_first_of_a_second_and_other_keys(spark):
    ev = events(spark, [(0, "view", 1, 1), (0, "view", 1, 1), (0, "cart", 1, 1), (0, "view", 2, 1)])
    assert ids(clean.near_dedup(ev)) == [0, 2, 3]


def test_near_dup_counts(spark):
    ev = events(spark, [(0, "view", 1, 1), (0, "view", 1, 1), (1, "view", 1, 1), (5, "view", 1, 1), (40, "view", 1, 1)])
    row = clean.near_dup_counts(ev).first()
    assert (row.total_rows, row.near_dupe_within_1s, row.near_dupe_within_5s, row.near_dupe_within_30s) == (5, 2, 3, 3)


def test_exact_dedup_keeps_the_smallest_survivor(spark):
    ev = events(spark, [(0, "view", 1, 1)] * 3 + [(0, "view", 1, 2)])
    assert ids(clean.exact_dedup(ev)) == [0, 3]
    assert clean.exact_dedup(ev).columns == ev.columns


def test_exact_dedup_is_idempotent(spark):
    ev = events(spark, [(0, "view", 1, 1), (0, "view", 1, 1), (3, "cart", 1, 1)])
    once = clean.exact_dedup(ev)
    assert ids(clean.exact_dedup(once)) == ids(once)


def test_bots_average_over_active_days_only(spark):
    rows = [(i, "view", i, 1) for i in range(4)] + [(86_400 * 5, "view", 9, 1)] + [(i, "view", i, 2) for i in range(2)]
    ev = events(spark, rows)
    bots = {r.user_id: r.events_per_day for r in clean.bot_users(ev, 2.4).collect()}
    assert bots == {1: 2.5}
    assert {r.user_id for r in clean.remove_bots(ev, 2.4).select("user_id").distinct().collect()} == {2}


def test_k_core_cascades(spark):
    # Item 9 has two events; without it user 3 drops to two and must go in round two.
    rows = [(0, "view", 1, u) for u in (1, 2, 3)] + [(1, "view", 2, u) for u in (1, 2, 3)] + [(2, "view", 3, u) for u in (1, 2)]
    rows += [(3, "view", 3, 1), (4, "view", 9, 3), (5, "view", 9, 2)]
    ev = events(spark, rows)
    kept = clean.k_core(ev, 3)
    people = {r.user_id for r in kept.select("user_id").distinct().collect()}
    assert 3 not in people
    for key in ("user_id", "product_id"):
        assert kept.groupBy(key).count().where("count < 3").count() == 0


def test_k_core_may_end_empty(spark):
    ev = events(spark, [(0, "view", 1, 1), (1, "view", 2, 1)])
    assert clean.k_core(ev, 5).count() == 0
    assert clean.k_core_report(ev, 5).collect()[-1].events == 0


def test_price_floor_drops_null_prices(spark):
    ev = events(spark, [(0, "view", 1, 1), (1, "view", 1, 1), (2, "view", 1, 1)])
    ev = ev.withColumn("price", F.when(F.col("event_id") == 0, None).when(F.col("event_id") == 1, 0.5).otherwise(1.0))
    assert ids(clean.price_floor(ev)) == [2]


def test_interactions_weigh_and_ignore_unknown_types(spark):
    ev = events(spark, [(0, "view", 1, 1), (1, "view", 1, 1), (2, "cart", 1, 1), (3, "purchase", 1, 1), (4, "signup", 1, 1)])
    row = tables.interactions(ev).first()
    assert (row.confidence_score, row.n_views, row.n_carts, row.n_purchases) == (8, 2, 1, 1)


def test_cleaning_report_matches_the_steps(spark):
    rows = [(0, "view", 1, 1), (0, "view", 1, 1), (1, "view", 1, 1), (50, "cart", 2, 1), (60, "view", 3, 2)]
    ev = events(spark, rows)
    cfg = Config(bot_events_per_day=1.5)
    steps = {k: df.count() for k, df in clean.clean_steps(ev, cfg).items()}
    report = {r.step_name: r.rows_left for r in clean.cleaning_report(ev, cfg).collect()}
    assert report == steps


def test_leave_one_out_needs_two_purchases(spark):
    ev = events(spark, [(0, "purchase", 1, 1), (5, "purchase", 2, 1), (9, "view", 3, 1), (0, "purchase", 1, 2)])
    train, held = tables.leave_one_out(ev)
    assert ids(held) == [1]
    assert ids(train) == [0, 2, 3]


def _chain(spark, links):
    """Users and items in a row, each user between two items: its 2-core is empty, one round at a time."""
    rows = [(u, i) for u in range(links) for i in (u, u + 1)]
    return spark.createDataFrame(rows, "user_id long, product_id long")


def test_k_core_goes_on_to_the_fixed_point(spark):
    chain = _chain(spark, 30)
    assert clean.k_core(chain, 2).count() == 0
    with pytest.raises(clean.NotConverged):
        clean.k_core(chain, 2, max_rounds=5)


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ")


def test_rounds_are_stored(spark):
    few = spark.createDataFrame([(u, i) for u in range(9) for i in range(9)], "user_id long, product_id long")
    assert _scans(clean.core_simulation(few, 2, 3)) <= 16


def plain_rounds(rows, k):
    """(round, events, users, items, removed) by filtering all events again and again."""
    out, before = [], len(rows)
    for i in range(1, 1_000):
        users, items = Counter(u for u, _ in rows), Counter(p for _, p in rows)
        rows = [(u, p) for u, p in rows if users[u] >= k and items[p] >= k]
        out.append((i, len(rows), len({u for u, _ in rows}), len({p for _, p in rows}), before - len(rows)))
        if len(rows) == before:
            return out
        before = len(rows)


@pytest.mark.parametrize("k", [2, 4, 7])
def test_k_core_rounds_equal_filtering_again(spark, monkeypatch, k):
    monkeypatch.setattr(clean, "FOLD", 3)
    rng = random.Random(k)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(40), int(rng.paretovariate(0.7)) % 60) for _ in range(400)]
    rows += [(100 + j, 100 + j + d) for j in range(8) for d in (0, 1)]
    ev = spark.createDataFrame(rows, "user_id long, product_id long")
    assert [tuple(r) for r in clean.k_core_report(ev, k).collect()] == plain_rounds(rows, k)


def test_a_round_sends_only_what_it_removes(spark):
    """The last rounds of a large table with a short tail neither shuffle nor write its pairs."""
    wide = spark.range(60_000).select((F.col("id") % 300).alias("user_id"), (F.col("id") % 199).alias("product_id"))
    tail = spark.createDataFrame([(1_000 + j, 1_000 + j + d) for j in range(6) for d in (0, 1)], "user_id long, product_id long")
    written = []
    cut = scale.cut_lineage
    scale.cut_lineage = lambda df: (written.append(cut(df)), written[-1])[1]
    try:
        _, rounds = clean.k_core_rounds(wide.union(tail), 2)
    finally:
        scale.cut_lineage = cut
    assert len(rounds) > 3
    assert all(df.count() <= 4 for df in written[2:])
