"""Query registry: key -> (Spark plan over a :class:`Tables`, equivalent SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.operators import clean, features, sequences, tables
from clickloom.sources import views

TRAIN_END, TEST_START = "2024-01-20", "2024-01-25"
BASKET_VAL, BASKET_TEST = "2000-01-01", "2001-01-01"


class Tables:
    """The event logs of one data folder and the tables every later step starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def clicks(self) -> DataFrame:
        return views.clicks(self.spark, self.sf_dir)

    @cached_property
    def baskets(self) -> DataFrame:
        return views.baskets(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return views.item_vectors(self.spark, self.sf_dir)

    @cached_property
    def click_splits(self):
        return tables.three_way_split(self.clicks, TRAIN_END, TEST_START)

    @cached_property
    def basket_splits(self):
        return tables.three_way_split(self.baskets, BASKET_VAL, BASKET_TEST)

    @cached_property
    def train(self) -> DataFrame:
        return self.basket_splits[0]

    @cached_property
    def test(self) -> DataFrame:
        return self.basket_splits[2]

    @cached_property
    def im(self) -> DataFrame:
        return tables.interactions(self.train)

    @cached_property
    def item_features(self) -> DataFrame:
        return features.item_features(self.baskets, self.im)

    @cached_property
    def user_features(self) -> DataFrame:
        return features.user_features(self.train, self.item_features)

    # Tables that a query reads several times are written once, as the stored tables they stand for.

    @cached_property
    def stored_item_features(self) -> DataFrame:
        return scale.cut_lineage(self.item_features)

    @cached_property
    def stored_user_features(self) -> DataFrame:
        return scale.cut_lineage(features.user_features(self.train, self.stored_item_features))

    @cached_property
    def pairs_once(self) -> DataFrame:
        """Train pairs keyed by the raw ids; item ids move up by one because 0 is the pad."""
        return pairs_of(self.im)

    @cached_property
    def pairs(self) -> DataFrame:
        return scale.cut_lineage(self.pairs_once)

    @cached_property
    def items(self) -> DataFrame:
        return items_of(self.stored_item_features)

    @cached_property
    def click_pairs(self) -> DataFrame:
        return scale.cut_lineage(pairs_of(tables.interactions(self.click_splits[0])))

    @cached_property
    def click_items(self) -> DataFrame:
        ev = self.clicks
        return scale.cut_lineage(items_of(features.item_features(ev, tables.interactions(self.click_splits[0]))))

    @cached_property
    def click_vocabs(self) -> tuple[DataFrame, DataFrame]:
        """User numbers from 0 and item numbers from 1, both from the training clicks."""
        train = self.click_splits[0]
        return features.id_vocab(train, "user_id"), features.id_vocab(train, "product_id", 1)

    @cached_property
    def mapped(self) -> DataFrame:
        """Clicks without exact copies, with user_idx, item_idx and event_idx."""
        return scale.cut_lineage(features.drop_oov(clean.exact_dedup(self.clicks), *self.click_vocabs))

    @cached_property
    def sessions(self) -> dict[str, DataFrame]:
        """Session sequences per split."""
        parts = tables.three_way_split(self.mapped, TRAIN_END, TEST_START)
        return {n: sequences.session_sequences(df) for n, df in zip(("train", "val", "test"), parts)}

    @cached_property
    def truth(self) -> DataFrame:
        """(user_idx, item_idx) carted or bought in the test year."""
        hot = clean.high_intent(self.test)
        return hot.select(F.col("user_id").alias("user_idx"), (F.col("product_id") + 1).alias("item_idx")).distinct()

    @cached_property
    def stored_truth(self) -> DataFrame:
        return scale.cut_lineage(self.truth)


def pairs_of(im: DataFrame) -> DataFrame:
    return im.select(
        F.col("user_id").alias("user_idx"), (F.col("product_id") + 1).alias("item_idx"), "confidence_score"
    )


def items_of(item_features: DataFrame) -> DataFrame:
    return item_features.select(
        "product_id", (F.col("product_id") + 1).alias("item_idx"), "cat_l1", "cat_l2", "brand", "price_bucket",
        "avg_price",
    )


class Query(NamedTuple):
    plan: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

# Common table expressions of the comparison SQL, by name.
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def query(key: str, sql: str | None = None):
    """Register a plan under ``key``; ``sql`` may use any name in CTES as a table."""

    def add(plan: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = Query(plan, sql)
        return plan

    return add


def expand(body: str) -> str:
    """Prefix a query with the table expressions it names, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    body = body.strip()
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
