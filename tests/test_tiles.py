"""Item pairs in tiles beside plain counting, with one user holding a third of the pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.operators import recommend, tiles


def pairs(seed=3, items=60):
    """(user, item, confidence): user 0 has every item, the others a handful."""
    rng = random.Random(seed)
    rows = [(0, i, rng.randint(0, 9)) for i in range(items)]
    for u in range(1, 25):
        rows += [(u, i, rng.randint(0, 5)) for i in rng.sample(range(items), rng.randint(1, 9))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_idx long, item_idx long, confidence_score long")


def test_tiles_hold_at_most_their_size_and_meet_once(spark):
    df = frame(spark, pairs())
    tiled = tiles.cut(df, tile=7).cache()
    sizes = [r["count"] for r in tiled.groupBy("user_idx", "tile").count().collect()]
    assert max(sizes) == 7
    met = tiles.meetings(tiled)
    made = tiles.pairs_in(tiled, met, [])
    per_meeting = [r["count"] for r in made.groupBy("user_idx", "a", "b").count().collect()]
    assert max(per_meeting) <= 7 * 7
    got = Counter((r.user_idx, *sorted((r.a_item_idx, r.b_item_idx))) for r in made.collect())
    own = {}
    for u, i, _ in pairs():
        own.setdefault(u, []).append(i)
    assert got == Counter((u, x, y) for u, mine in own.items() for x in mine for y in mine if x < y)


@pytest.mark.parametrize("tile", [7, 1_000])
def test_co_counts(spark, tile):
    rows = pairs()
    df = frame(spark, rows)
    reps = df.select(F.col("item_idx").alias("rep")).where("rep % 3 = 0").distinct()
    got = {(r.rep, r.item_idx): r.n for r in recommend.co_counts(df, reps, cap=None, tile=tile).collect()}
    own = {}
    for u, i, _ in rows:
        own.setdefault(u, set()).add(i)
    want = Counter((x, y) for mine in own.values() for x in mine for y in mine if x != y and x % 3 == 0)
    assert got == dict(want)


def plain_knn(rows, k):
    vectors = {}
    for u, i, c in rows:
        vectors.setdefault(i, {})[u] = c
    norm = {i: math.sqrt(sum(c * c for c in v.values())) for i, v in vectors.items()}
    out = []
    for i, v in vectors.items():
        near = []
        for j, w in vectors.items():
            if i != j and norm[i] and norm[j] and v.keys() & w.keys():
                near.append((-round(sum(v[u] * w[u] for u in v.keys() & w.keys()) / (norm[i] * norm[j]), 12), j))
        out += [(i, rank, j) for rank, (_, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("low", [0, -3])
@pytest.mark.parametrize("tile", [7, 1_000])
def test_item_knn(spark, tile, low):
    rows = [(u, i, c + low) for u, i, c in pairs(5)]
    got = sorted((r.item_idx, r.rank, r.neighbour) for r in recommend.item_knn(frame(spark, rows), 4, tile).collect())
    assert got == plain_knn(rows, 4)


def test_meetings_that_reach_no_list_are_skipped(spark):
    """Items that only the heavy user has lie at another angle than items with close neighbours elsewhere."""
    rows = [(u, i, 5) for u in range(1, 9) for i in range(10)] + [(0, i, 1) for i in range(60)]
    df = frame(spark, rows)
    norms = df.groupBy("item_idx").agg(F.sqrt(F.sum(F.col("confidence_score") ** 2)).alias("norm"))
    about = norms.withColumn("angle", F.when(F.col("item_idx") < 10, F.asin(1 / F.col("norm"))).otherwise(math.pi / 2))
    tiled = tiles.cut(df.where("user_idx = 0").join(about, "item_idx").withColumn("least", F.when(F.col("item_idx") < 10, 0.99).otherwise(0.9)), [F.col("angle")], 10).cache()
    met = {(r.a, r.b) for r in tiles._needed_meetings(tiled).collect()}
    assert (0, 0) in met and not any((0, b) in met for b in range(1, 6))
    got = sorted((r.item_idx, r.rank, r.neighbour) for r in recommend.item_knn(df, 3, 10).collect())
    assert got == plain_knn(rows, 3)
