"""The registered queries work on the reference's sizes."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluate, negatives
from clickloom.plans import QUERIES, q_recommend


def test_catalog_lists_two_thousand_items(spark):
    items = spark.range(1, 2501).select(
        F.col("id").alias("product_id"), F.lit("x").alias("cat_l1"), F.lit("y").alias("cat_l2"), F.lit("b").alias("brand"),
        F.lit(1.5).alias("avg_price"), F.col("id").alias("item_total_confidence"),
    )
    t = SimpleNamespace(item_features=items)
    ids = {int(r.item_id) for r in QUERIES["snk_07_build_catalog"].plan(t).collect()}
    assert ids == {3, 5, 8} | set(range(501, 2501))
    assert QUERIES["snk_07_catalog_counts"].plan(t).first()["items"] == 2003


@pytest.mark.parametrize(
    "key, module, name, sizes",
    [
        ("ev_19_batch_scores", evaluate, "batch_scores", (2048, 5)),
        ("neg_10_popularity_risk", negatives, "popularity_risk", (2000,)),
        ("neg_11_popularity_profile", negatives, "popularity_profile", (1000,)),
        ("neg_12_batch_popularity", negatives, "batch_popularity", (2048, 10, 1000)),
        ("neg_13_batch_same_category", negatives, "batch_same_category", (2048, 10)),
    ],
)
def test_sizes_of_the_reference(monkeypatch, key, module, name, sizes):
    monkeypatch.setattr(module, name, lambda *args: tuple(a for a in args if isinstance(a, int)))
    monkeypatch.setattr(q_recommend, "user_vectors", lambda t: None)
    t = SimpleNamespace(pairs=None, items=None, click_pairs=None, vectors=None)
    assert QUERIES[key].plan(t)[: len(sizes)] == sizes
