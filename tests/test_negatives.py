"""Session-negative overlaps: uncatalogued pairs by hand, and the registered query on the whole catalog."""

import random

from clickloom.operators import negatives
from clickloom.plans import QUERIES
from clickloom.plans.registry import Tables
from tests.test_registry import SF


def test_uncatalogued_pairs(spark):
    rows = [("a", 1, "cart"), ("a", 2, "view"), ("a", 3, "view"), ("a", 4, "view"), ("a", 9, "view"), ("b", 9, "purchase"), ("b", 1, "view"), ("c", 1, "view")]
    ev = spark.createDataFrame(rows, "user_session string, product_id long, event_type string")
    items = spark.createDataFrame([(1, "x", "x1"), (2, "x", "x1"), (3, "x", "x2"), (4, "y", "y1")], "product_id long, cat_l1 string, cat_l2 string")
    row = negatives.session_negative_overlap(ev, items).first()
    # Product 9 is not in the catalog: lost as a negative of session a and as the positive of session b.
    assert (row.sessions, row.pairs, row.same_l2, row.same_l1_only, row.different_l1, row.uncatalogued) == (2, 3, 1, 1, 1, 1)


def test_registered_overlap_reads_the_whole_catalog(spark):
    t = Tables(spark, SF)
    out = QUERIES["neg_08_session_negative_overlap"].plan(t).first()
    assert out == negatives.session_negative_overlap(t.click_splits[0], t.click_items).first()
    assert out.uncatalogued == 0


def test_free_ranks_skip_own_positions(spark):
    """A hot user owns most of a large pool; directories of small cells, large cells and plain counting agree."""
    rng = random.Random(4)
    own = sorted(rng.sample(range(1_000), 700))
    rows = [(1, "c:x", 50 + p, 50) for p in own] + [(2, "c:x", 50, 50), (2, "c:y", 9, 7)]
    free = [p for p in range(1_000) if p not in set(own)]
    draws = [(1, "c:x", 50, v) for v in range(300)] + [(2, "c:x", 50, v) for v in (0, 5, 998)] + [(2, "c:y", 7, v) for v in (0, 1, 2)] + [(3, "c:y", 7, 1)]
    want = sorted([(1, v, 50 + free[v]) for v in range(300)] + [(2, v, 51 + v) for v in (0, 5, 998)] + [(2, 0, 7), (2, 1, 8), (2, 2, 10), (3, 1, 8)])
    own_df = spark.createDataFrame(rows, "user_idx long, pool string, position long, start long")
    draw_df = spark.createDataFrame(draws, "user_idx long, pool string, start long, value long")
    for width in (1, 16, 512, 4_096):
        got = negatives._past_own(draw_df, own_df, 1_000, width)
        assert sorted((r.user_idx, r.value, r.position) for r in got.collect()) == want, width


def test_a_cell_holds_no_more_marks_than_ranks(spark):
    rows = [(1, "c:x", p, 0) for p in range(2_000) if p % 10]
    own = spark.createDataFrame(rows, "user_idx long, pool string, position long, start long")
    asked = spark.createDataFrame([(1, "c:x", c) for c in range(13)], "user_idx long, pool string, cell long")
    cells = negatives.own_directory(own, asked, 2_000, 16).collect()
    assert len(cells) == 13 and max(len(r.marks) for r in cells) <= 16
    assert sum(m.n for r in cells for m in r.marks) == 1_800


def test_routes_count_pairs_that_end_in_the_whole_catalog(spark):
    # Category a has two items, both the user's; bucket 1 holds item 4 alone, of unknown category.
    items = spark.createDataFrame([(1, "z", "a", "b", 0), (2, "z", "a", "b", 0), (3, "z", "c", "b", 0), (4, "z", "unknown", "b", 1)], "item_idx long, cat_l1 string, cat_l2 string, brand string, price_bucket long")
    tp = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 4, 1), (2, 3, 1), (3, 1, 1)], "user_idx long, item_idx long, confidence_score long")
    row = negatives.hard_negative_routes(tp, items, 1, warm=99).first()
    mined = negatives.hard_negatives(tp, items, 1, warm=99)
    assert row.any_pairs == mined.where("route = 'any'").select("user_idx", "item_idx").distinct().count() == 4
