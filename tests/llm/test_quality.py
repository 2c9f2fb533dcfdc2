import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import quality
from tests.llm import fixtures


def plain_buckets(text):
    tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15
    one = [zlib.crc32(t.encode()) << 32 | zlib.crc32(t.encode(), 0x5BD1E995) for t in tokens]
    two = [((a * mix + b) & mask) * mix & mask for a, b in zip(one, one[1:])]
    return [x >> 50 for x in [a * mix & mask for a in one] + two]


@pytest.fixture(scope="module")
def corpus(spark):
    good = [f"a calm sentence about the {x} and the {y}" for x in ("sea", "hill", "road") for y in ("sun", "moon", "wind", "rain")]
    bad = [f"buy!! now!! {x} $$$ {x} $$$" for x in ("pills", "chips", "links", "codes")]
    rows = [(i, good[i % 12] if i % 3 else bad[i % 4], "e") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, importance string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_importance_matches_plain_counting(spark, corpus):
    docs, labels = corpus
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    counts = lambda ids: np.bincount([b for i in ids for b in plain_buckets(texts[i])], minlength=quality.BUCKETS)
    smooth = lambda c: (c + 1) / (c.sum() + quality.BUCKETS)
    ratio = np.log(smooth(counts(good))) - np.log(smooth(counts(texts)))
    for r in quality.resample(docs, labels).collect():
        assert r.importance == pytest.approx(ratio[plain_buckets(texts[r.doc_id])].sum(), rel=1e-9)
        assert abs(r.gumbel_key - r.importance) < 40


def test_sample_is_the_top_of_the_keys(spark, corpus):
    docs, labels = corpus
    rows = sorted(quality.resample(docs, labels, keep=0.3).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 301)) and sum(r.selected for r in rows) == 90
    keys = [r.gumbel_key for r in rows]
    assert keys == sorted(keys, reverse=True)
    bad = [r.selected for r in rows if r.doc_id % 3 == 0]
    assert sum(bad) < 0.15 * len(bad)
    again = quality.resample(docs.repartition(7), labels, keep=0.3).where("selected").select("doc_id")
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in rows if r.selected}


def test_keys_are_gumbel_variables_beside_the_ratio(spark):
    """Equal texts differ by the variable alone; its mean and deviation are those of the Gumbel law."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    keys = np.array([r.gumbel_key - r.importance for r in quality.resample(docs, labels).collect()])
    assert abs(keys.mean() - 0.5772) < 0.04 and abs(keys.std() - np.pi / np.sqrt(6)) < 0.04


def test_awkward_rows(spark):
    docs, labels = fixtures.awkward(spark), fixtures.labels(spark)
    rows = quality.resample(docs, labels).collect()
    assert len(rows) == len(fixtures.TEXTS)
    assert {r.doc_id for r in rows if r.importance == quality.NOTHING} == {3, 4, 5}
    none = quality.resample(docs, labels.where("quality = 0"))
    assert {r.importance for r in none.where(F.col("doc_id") == 1).collect()} == {0.0}
    assert quality.resample(fixtures.empty(spark), labels).count() == 0
