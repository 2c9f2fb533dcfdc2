"""Recommenders side by side: what is read several times is stored, and stored lists don't go through the driver."""

import random
import re
from types import SimpleNamespace

import pytest

from clickloom import scale
from clickloom.operators import recommend, tiles
from clickloom.plans import QUERIES


@pytest.fixture(scope="module")
def tp(spark):
    rng = random.Random(8)
    rows = [(u, i, rng.randint(1, 9)) for u in range(20) for i in rng.sample(range(1, 31), rng.randint(2, 12))]
    return scale.cut_lineage(spark.createDataFrame(rows, "user_idx long, item_idx long, confidence_score long"))


@pytest.fixture(scope="module")
def items(spark):
    return scale.cut_lineage(spark.createDataFrame([(i, f"c{i % 4}") for i in range(1, 31)], "item_idx long, cat_l2 string"))


@pytest.mark.parametrize("model", ["category", "cooccurrence"])
def test_users_are_read_once_and_no_table_is_sent_by_its_file_size(spark, tp, items, tmp_path, monkeypatch, model):
    monkeypatch.setattr(scale, "FEW_BYTES", 0, raising=False)  # every stored table counts as large
    tp.select("user_idx").distinct().write.parquet(str(tmp_path / "people"))
    users = spark.read.parquet(str(tmp_path / "people"))
    recs = recommend.rec_category(tp, items, users, 5) if model == "category" else recommend.rec_cooccurrence(tp, users, 5)
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "people")[:40] not in plan and "/people" not in plan
    assert not re.search(r"BroadcastHashJoin[^\n]*LeftAnti", plan)
    assert recs.count() == 100


def test_meetings_of_stored_tiles_are_shuffled(tp, monkeypatch):
    monkeypatch.setattr(scale, "FEW_BYTES", 0, raising=False)
    met = tiles.meetings(scale.cut_lineage(tiles.cut(tp, tile=4)))
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["rec_10_compare", "ev_23_best_run"])
def test_the_ground_truth_is_stored_once(spark, tp, items, key):
    truth = spark.createDataFrame([(u, 1 + u % 30) for u in range(25)], "user_idx long, item_idx long")
    rows = QUERIES[key].plan(SimpleNamespace(pairs=tp, items=items, stored_truth=truth)).collect()
    assert len(rows) == (3 if key == "rec_10_compare" else 1) and all(r.n_users == 25 for r in rows)
