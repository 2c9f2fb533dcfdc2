"""SimHash near-duplicates, found with BK-trees over the distinct fingerprints.

A fingerprint has bit i set if bit i is set in over half of the text's 3-word shingle hashes (XXH64,
seed 42). Two fingerprints link if they differ in at most ``RADIUS`` bits.

Trees are sharded so that a query only meets trees that can hold a link: two fingerprints within
radius r agree on at least one of r + 1 blocks of their bits, so every fingerprint joins one tree
per block, that of the block's value. Where a value is shared by more than ``TREE`` fingerprints,
its remaining bits are cut into r + 1 blocks again and so on, which keeps every link and bounds
trees without pairing everything in a crowded one. A shard is a forest of such trees as plain
arrays, with children keyed by their integer distance to the parent; its own members are the
queries, and a query follows only edges within the radius of its distance. A forest is built in the
task where its queries are; the driver never holds a fingerprint. Each task joins what its
trees link and returns one link per fingerprint, and rounds of joins merge those into components.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other;
texts with fewer than three words have one shingle, all their words; equal fingerprints are one node
whatever their number; a null doc_id gets its component's id but never names one, so a component
without any id has a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work
from clickloom.llm.components import components

RADIUS = 3
TREE = 2_000  # fingerprints of one tree before its block is cut again
SHARD = 50_000  # fingerprints of one task's forest, about
_CUTS = 4  # times that a block can be cut
_PART = 1 << 18  # shingles counted at once
_PAIRS = 1 << 20  # (query, node) pairs followed at once


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = max(1, len(words) - 2)
    for at in range(0, n, _PART):
        some = words[at : at + _PART + 2]
        shingles = map(b" ".join, zip(some, some[1:], some[2:])) if len(words) > 2 else [b" ".join(words)]
        hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp (a signed long) of every row."""
    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return work.per_text(docs, make, "fp long", keep)


# --------------------------------------------------------------------------- trees


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of one shard. ``tree`` tells the tree of each value; the first of a tree is its root."""

    def __init__(self, tree: np.ndarray, values: np.ndarray):
        self.values = values
        _, self.root, member = np.unique(tree, return_index=True, return_inverse=True)
        at = self.root[member]
        waiting = np.flatnonzero(at != np.arange(len(values)))
        edges, children = [], []
        at = at[waiting]
        while waiting.size:
            # The first to arrive at a free (parent, distance) edge becomes that child.
            edge = at * 65 + _distance(values[waiting], values[at])
            taken, first, place = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(waiting[first])
            child = waiting[first][place]
            later = child != waiting
            waiting, at = waiting[later], child[later]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], (np.concatenate(children) if children else edge)[order]
        self.first = self.root[member]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, both as places in ``values``."""
        stack = [(queries, self.first[queries])]
        while stack:
            query, node = stack.pop()
            if query.size > _PAIRS:
                half = query.size // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = _distance(self.values[query], self.values[node])
            near = d <= radius
            yield query[near], node[near]
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            if n.sum():
                starts = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                stack.append((np.repeat(query, n), self.child[starts + np.arange(n.sum())]))


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place linked to each of n places."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def _shard_links(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mask", "bits", "fp"])
        values = rows["fp"].to_numpy(np.int64).view(np.uint64)
        change = (np.diff(rows["mask"].to_numpy()) != 0) | (np.diff(rows["bits"].to_numpy()) != 0)
        tree = np.concatenate(([0], np.cumsum(change))) if len(rows) else np.zeros(0, np.int64)
        forest = Forest(tree, values)
        root = _roots(len(values), forest.within(np.arange(len(values)), radius))
        out = np.flatnonzero(root != np.arange(len(values)))
        fps = rows["fp"].to_numpy(np.int64)
        return pd.DataFrame({"a": fps[out], "b": fps[root[out]]})

    return run


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` runs, each added to the mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(fps: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """One row per fingerprint and block: (mask, bits, fp), from rows with the masks so far."""
    steps = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(b)).cast("long") for b in _blocks(m, radius + 1)]))])
    return fps.select("fp", F.explode(steps[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join every two distinct values of ``fp`` within the radius, not all pairs of them."""
    rows, masks, ready = fps.withColumn("mask", F.lit(0).cast("long")), [0], []
    for depth in range(_CUTS):
        rows = _cut(rows, masks, radius)
        # From the second cut on, two ways can lead to the same bits.
        rows = rows.distinct() if depth else rows
        masks = sorted({b for m in masks for b in _blocks(m, radius + 1)})
        rows = work.store(rows, "blocks")
        if depth == _CUTS - 1:
            break
        crowded = work.store(rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE).drop("n"), "crowded")
        if crowded.isEmpty():
            break
        ready.append(rows.join(crowded, ["mask", "bits"], "left_anti"))
        rows = rows.join(crowded, ["mask", "bits"]).select("mask", "fp").distinct()
    for more in ready:
        rows = rows.unionByName(more)
    rows = work.store(rows, "trees") if ready else rows
    shards = max(1, -(-rows.count() // SHARD))
    # A crowded value is spread by its bits, so a shard holds whole trees and about SHARD values.
    shard = F.pmod(F.xxhash64("mask", "bits"), F.lit(max(shards, fps.sparkSession.sparkContext.defaultParallelism)))
    return rows.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")


def _roots_of(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint, root being one fingerprint of its component."""
    distinct = work.store(marked.select("fp").distinct(), "distinct")
    roots = components(work.store(links(distinct, radius), "tree_links"))
    found = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return work.store(found, "roots")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id."""
    marked = work.store(fingerprints(docs), "fingerprints")
    named = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_roots_of(marked, radius), "fp")
    named = work.store(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = work.store(named.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(of_fp, "fp").select("doc_id", "fp", hex_digits("fp").alias("fingerprint"), "component_id")


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, then the smallest key.

    A row's key is two hashes of its doc_id and text, so rows that share a doc_id, or have none, are
    decided one by one. Rows without doc_id come after all others; of rows that repeat both, one stays.
    Only keys are shuffled to decide. Texts that may go, by a bit table of fixed size, meet the keys that
    do; all others stay in place, and only repeated rows are brought together.
    """
    one, two = work.free_name(docs, "row_key"), work.free_name(docs, "row_key_2")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({one: F.xxhash64("doc_id", text), two: F.xxhash64(text, F.lit(2), "doc_id")})
    plain = keyed.select("doc_id", "text", F.col(one).alias("one"), F.col(two).alias("two"))
    marked = work.store(fingerprints(plain, ("doc_id", "one", "two")), "fingerprints")
    rooted = work.store(marked.join(_roots_of(marked, radius), "fp").select("doc_id", "one", "two", "root"), "rooted")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("one").alias("one"), F.col("two").alias("two"))
    best = rooted.groupBy("root").agg(F.min(rank).alias("best")).select("root", F.col("best.one").alias("best_one"), F.col("best.two").alias("best_two"))
    stays = (F.col("one") == F.col("best_one")) & (F.col("two") == F.col("best_two"))
    fates = rooted.groupBy("root", "one", "two").agg(F.count(F.lit(1)).alias("n")).join(best, "root").select("one", "two", stays.alias("stays"), "n")
    # Keys that go, and keys that stay once of several rows; all others aren't listed.
    fates = work.store(fates.where("NOT stays OR n > 1").select(F.col("one").alias(one), F.col("two").alias(two), F.col("stays").alias(work.free_name(docs, "stays"))), "fates")
    repeated = fates.where(F.col(fates.columns[2])).select(one, two)
    # Most rows have no fate and stay where they are; the others meet their keys.
    listed = work.may_be_in(fates, one)
    met = keyed.where(listed).join(fates.select(one, two), [one, two], "left_anti")
    kept = keyed.where(~listed).unionByName(met).select(*docs.columns)
    if repeated.isEmpty():
        return kept
    again = keyed.where(work.may_be_in(repeated, one)).join(repeated, [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)
    return kept.unionByName(again)
