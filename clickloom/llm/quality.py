"""Quality by importance resampling: hashed n-gram models of good and of raw text, and Gumbel top-k.

Words, numbers and runs of signs and their neighbouring pairs are hashed into ``BUCKETS`` buckets.
Two bag-of-n-grams models count them: the target over a bounded sample of documents labelled good,
the raw one over all documents. A document's importance is the logarithm of its probability in the
target model over that in the raw one: the sum over its n-grams. Adding it to a Gumbel variable
drawn from a hash of the id and taking the k largest sums samples k documents without replacement,
in proportion to target over raw probability. Long texts bring more evidence either way.

Counts leave each task as one row per bucket; documents are never shuffled. Places in the sample
come from a range sort of (id, sum) pairs, not from one task.

Defined cases: a null text, or one without n-grams, has importance ``NOTHING`` (last of all);
labels with a null id or quality are left out, of contradicting labels of an id the worse counts;
without good examples all importances are 0; ties go to the smaller doc_id; rows that repeat a
doc_id draw the same variable; a null doc_id stays null; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.llm import work

BUCKETS = 1 << 14
TARGET = 20_000  # good documents that the target model reads, about
NOTHING = -1e12  # importance of a text without n-grams
KEEP = 0.5  # share of the documents that the sample takes
SMOOTHING = 1.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 400_000


class Hasher:
    """Bucket numbers of a text's n-grams; remembers the hashes of the tokens it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall((text or "").lower())
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        for t in [t for t in set(tokens) if t not in known]:
            raw = t.encode("utf-8", "surrogatepass")
            known[t] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)
        one = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        two = (one[:-1] * _MIX + one[1:]) * _MIX
        return (np.concatenate([one * _MIX, two]) >> np.uint64(64 - 14)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """n-grams of all rows of ``docs`` in each bucket."""
    schema, arrow = work.schemas("bucket int, n long")

    def run(batches: Iterator) -> Iterator:
        hasher, counts = Hasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                for text in batch.column(0).slice(at, work.SLICE).to_pylist():
                    counts += np.bincount(hasher(text), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        yield work.record_batch(list(zip(full.tolist(), counts[full].tolist())), arrow)

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"]] = rows["n"]
    return counts


def good_documents(docs: DataFrame, labels: DataFrame, limit: int = TARGET) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = work.store(work.bounded(known.where("quality > 0"), ["quality"], limit, "quality"), "good")
    # Bounded by limit, so it can go to every task.
    return docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")


def ratios(docs: DataFrame, labels: DataFrame, limit: int = TARGET) -> np.ndarray:
    """Logarithm of target over raw probability of every bucket."""
    target, raw = bucket_counts(good_documents(docs, labels, limit)), bucket_counts(docs)
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(smooth(target)) - np.log(smooth(raw))


def importance(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, importance) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make() -> Callable[[list], list]:
        hasher, values = Hasher(), shared.value

        def run(texts: list) -> list:
            found = [hasher(t) for t in texts]
            return [[float(values[x].sum()) if x.size else NOTHING for x in found]]

        return run

    return work.per_text(docs, make, "importance double")


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, limit: int = TARGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, importance, gumbel_key, place (from 1), selected."""
    scored = importance(docs, ratios(docs, labels, limit))
    gumbel = -F.log(-F.log(work.fraction("doc_id", salt="gumbel")))
    keyed = work.store(scored.withColumn("gumbel_key", F.col("importance") + gumbel), "keys")
    k = math.floor(keyed.count() * keep + 0.5)
    placed = scale.add_position(keyed, [F.desc("gumbel_key"), F.asc("doc_id")], "place")
    return placed.withColumn("selected", F.col("place") <= k)
