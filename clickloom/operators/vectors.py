"""Exact top-k over stored blocks of vectors, and exact spreads of very many scores without storing them.

Item vectors are written once, in blocks of neighbours in direction and length, with each block's
centre, radius and greatest length. Tasks read blocks from there, the most promising first, and pass
over a block when no query of theirs can still gain from it. Nothing goes through the driver, and the
plan is the same for any number of items.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale

QUERIES = 2_048  # queries that a task follows through the blocks together
SHELF = 20_000  # rows of whole blocks that are stored and read together
PIECE = 4_096  # rows that are multiplied together
HELD = 64 << 20  # bytes of blocks that a task keeps
TASKS = 4  # of queries, for each core
_SLACK = 1e-9  # what rounding may add to a bound
_SINGLE = 2.0**-23  # what single precision may take from a score for each component, as a share of both lengths


def matrix(vectors: pd.Series, normalize: bool) -> np.ndarray:
    rows = np.stack(vectors.to_list()).astype("float64")
    if normalize:
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = rows / np.where(length > 0, length, 1.0)
    return rows


# --------------------------------------------------------------------------- blocks


def _direction(vec: Column) -> Column:
    """The place of a vector's largest component by size, signed: neighbours share it."""
    sizes = F.transform(vec, lambda x: F.abs(x))
    at = F.array_position(sizes, F.array_max(sizes))
    return F.when(F.get(vec, (at - 1).cast("int")) < 0, -at).otherwise(at)


def store_blocks(items: DataFrame, size: int, normalize: bool) -> str:
    """Write (item_idx, vec) in blocks of ``size`` rows below a fresh folder and return its address.

    ``items/shelf=n`` holds the rows of neighbouring blocks, ``index`` one row per block: shelf, centre, radius, longest.
    """
    where = scale.scratch_path(items.sparkSession, "vectors")
    vec = F.transform("vec", lambda x: x.cast("double"))
    if normalize:
        length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
        vec = F.when(length > 0, F.transform(vec, lambda x: x / length)).otherwise(vec)
    rows = items.select(F.col("item_idx").cast("long"), vec.alias("vec"))
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    placed = scale.add_position(rows, [_direction(F.col("vec")), F.desc(top), F.asc("item_idx")], "_at", 0)
    placed = placed.withColumn("block", F.floor(F.col("_at") / size)).withColumn("shelf", F.floor(F.col("block") / max(1, SHELF // size))).drop("_at")
    placed.repartition("shelf").write.partitionBy("shelf").parquet(f"{where}/items")

    def about(block: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(part["vec"].to_list())
        centre = m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())
        longest = float(np.sqrt((m * m).sum(axis=1)).max())
        return pd.DataFrame({"block": [block[0]], "shelf": [part["shelf"].iloc[0]], "centre": [centre], "radius": [radius], "longest": [longest]})

    stored = items.sparkSession.read.schema("item_idx long, vec array<double>, block long, shelf long").parquet(f"{where}/items")
    stored.groupBy("block").applyInPandas(about, "block long, shelf long, centre array<double>, radius double, longest double").write.parquet(f"{where}/index")
    return where


class Blocks:
    """Stored blocks as a task reads them; the last ones used stay in memory up to ``HELD`` bytes."""

    def __init__(self, where: str):
        from pyarrow import fs
        from pyarrow import parquet as pq

        self.read = lambda path: pq.read_table(path, filesystem=self.store, partitioning=None)
        self.store, self.path = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where.removeprefix("file:"))
        index = self.read(f"{self.path}/index").to_pandas().sort_values("block")
        self.numbers, self.shelf = index["block"].to_numpy(), index["shelf"].to_numpy()
        self.centres = np.stack(index["centre"].to_list()) if len(index) else np.zeros((0, 1))
        self.radius, self.longest = index["radius"].to_numpy(), index["longest"].to_numpy()
        self.held: OrderedDict[int, tuple[np.ndarray, ...]] = OrderedDict()
        self.loads = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Greatest score of each query with anything in each block."""
        if not len(self.numbers):
            return np.zeros((len(queries), 0))
        length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        return np.minimum(queries @ self.centres.T + length * self.radius, length * self.longest) + _SLACK

    def load(self, shelf: int) -> tuple[np.ndarray, ...]:
        """A shelf's block numbers, ids, vectors, and these in single precision, by block."""
        if shelf not in self.held:
            table = self.read(f"{self.path}/items/shelf={shelf}")
            of, ids, vec = table.column("block").to_numpy(), table.column("item_idx").to_numpy(), table.column("vec").combine_chunks()
            order = np.lexsort((ids, of))
            rows = vec.flatten().to_numpy().reshape(len(ids), -1)[order]
            self.held[shelf] = of[order], ids[order], rows, single(rows)
            self.loads += 1
            while len(self.held) > 1 and sum(x.nbytes for some in self.held.values() for x in some) > HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(shelf)
        return self.held[shelf]


def single(rows: np.ndarray) -> np.ndarray:
    """In single precision, unless products would leave its range."""
    return rows.astype(np.float32) if rows.size and np.abs(rows).max() < 1e15 else rows


class _Best:
    """The k best (score, then smaller id) of some queries so far."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores, self.k = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n, k
        self.floor = np.full(n, -np.inf)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = np.isfinite(scores) & (scores >= self.floor[q])
        if hit.sum() > self.k:
            hit &= scores >= np.partition(scores[hit], -self.k)[-self.k]
        if not hit.any():
            return
        ids, scores = np.concatenate([self.ids[q], ids[hit]]), np.concatenate([self.scores[q], scores[hit]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[best], scores[best]
        if len(best) == self.k:
            self.floor[q] = self.scores[q][-1]


def best_of(blocks: Blocks, names: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool) -> _Best:
    """The k best of every query, by shelves, the most promising first.

    Whole pieces of a shelf are multiplied in single precision; what comes near enough to a query's k best
    to be one of them is scored again in full, for that query alone.
    """
    best = _Best(len(names), k)
    bounds = blocks.bounds(queries)
    quick, length = single(queries), np.sqrt((queries * queries).sum(axis=1))
    most = bounds.max(axis=0) if bounds.size else np.zeros(0)
    shelves = sorted(np.unique(blocks.shelf), key=lambda x: -most[blocks.shelf == x].max()) if bounds.size else []
    for shelf in shelves:
        mine = np.flatnonzero(blocks.shelf == shelf)
        open_ = bounds[:, mine] >= best.floor[:, None]
        asking = np.flatnonzero(open_.any(axis=1))
        if not asking.size:
            continue  # later shelves may still serve queries of other bounds
        of, ids, rows, low = blocks.load(int(shelf))
        wanted = np.flatnonzero(np.isin(of, blocks.numbers[mine[open_.any(axis=0)]]))
        longest = blocks.longest[mine].max()
        for start in range(0, wanted.size, PIECE):
            piece = wanted[start : start + PIECE]
            names_, full, right = ids[piece], rows[piece], low[piece].T
            for at in range(0, asking.size, 256):
                some = asking[at : at + 256]
                near = quick[some] @ right
                slack = _SINGLE * (queries.shape[1] + 4) * length[some] * longest + _SLACK
                least = np.nextafter((best.floor[some] - slack).astype(near.dtype), -np.inf)
                hit = ~(near < least[:, None])
                for r in np.flatnonzero(hit.any(axis=1)):
                    found, q = np.flatnonzero(hit[r]), some[r]
                    if exclude_self:
                        found = found[names_[found] != names[q]]
                    if found.size > 4 * k:  # only the k best of the piece, and what can't be told from them
                        score = near[r][found]
                        found = found[~(score < np.partition(score, -k)[-k] - 2 * slack[r])]
                    # Sums come in another order in pieces of another shape; ties must not depend on it.
                    best.offer(q, names_[found], np.round(full[found] @ queries[q], 12))
    return best


def topk(queries: DataFrame, items: DataFrame, k: int, normalize: bool = True, exclude_self: bool = False, block: int = 20_000) -> DataFrame:
    """Exact top-k by inner product (cosine when normalised): (query_id, rank, item_idx, score).

    ``query_id`` is a key. Queries are dealt out over all cores, however few files they come in, and a
    query's list is finished in its task.
    """
    where = store_blocks(items, block, normalize)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(where)
        for part in parts:
            for at in range(0, len(part), QUERIES):
                some = part.iloc[at : at + QUERIES]
                names = some["query_id"].to_numpy()
                best = best_of(blocks, names, matrix(some["vec"], normalize), k, exclude_self)
                n = [len(x) for x in best.ids]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(names, n),
                        "rank": np.concatenate([np.arange(1, x + 1) for x in n]),
                        "item_idx": np.concatenate(best.ids),
                        "score": np.concatenate(best.scores),
                    }
                )

    tasks = TASKS * queries.sparkSession.sparkContext.defaultParallelism
    source = queries.select(F.col("query_id").cast("long"), "vec").repartition(tasks, "query_id")
    return source.mapInPandas(run, "query_id long, rank long, item_idx long, score double")


# --------------------------------------------------------------------------- spreads


def score_spread(
    source: DataFrame, scores: Callable[[pd.DataFrame], np.ndarray], points: Sequence[float], steps: int = 65_536
) -> tuple[int, float, float, list[float]]:
    """(count, mean, population deviation, exact interpolated percentiles) of all scores that tasks compute.

    ``scores`` gives the scores of some rows of ``source``, between -1 and 1. No score is stored or
    sorted: tasks return the counts of ``steps`` equal steps, merged by Spark; the steps that hold the
    wanted ranks are then counted by value, as often as needed in ever smaller steps.
    """

    def counted(low: float, width: float) -> pd.DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, moments = np.zeros(steps, np.int64), np.zeros(3)
            for part in parts:
                s = scores(part)
                moments += [len(s), s.sum(), (s * s).sum()]
                at = np.floor((s - low) / width)
                at = at[(at >= 0) & (at < steps)].astype(np.int64)
                total += np.bincount(at, minlength=steps)
            found = np.flatnonzero(total)
            yield pd.DataFrame({"step": np.append(found, -1), "n": np.append(total[found], 0), "a": np.append(np.zeros(len(found)), moments[1]), "b": np.append(np.zeros(len(found)), moments[2])})

        made = source.mapInPandas(run, "step long, n long, a double, b double")
        # At most ``steps`` rows and one of moments.
        return made.groupBy("step").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("step").toPandas()

    def values(low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                s = scores(part)
                inside = s[np.floor((s - low) / width) == 0]
                v, n = np.unique(inside, return_counts=True)
                yield pd.DataFrame({"v": v, "n": n})

        found = source.mapInPandas(run, "v double, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").toPandas()
        return found["v"].to_numpy(), found["n"].to_numpy()

    first = counted(-1.0 - 1e-6, (2 + 2e-6) / steps)
    sums = first[first["step"] < 0]
    first = first[first["step"] >= 0]
    n = int(first["n"].sum())
    if not n:
        return 0, float("nan"), float("nan"), [float("nan")] * len(points)
    mean = float(sums["a"].iloc[0]) / n
    deviation = float(np.sqrt(max(0.0, float(sums["b"].iloc[0]) / n - mean * mean)))
    ranks = sorted({int(f(p * (n - 1))) for p in points for f in (np.floor, np.ceil)})
    at_rank: dict[int, float] = {}

    def look(table: pd.DataFrame, before: int, low: float, width: float, wanted: list[int]) -> None:
        upto = before + np.cumsum(table["n"].to_numpy())
        place = np.searchsorted(upto, wanted, side="right")
        for s in np.unique(place):
            mine = [r for r, p in zip(wanted, place) if p == s]
            start, size = int(upto[s] - table["n"].iloc[s]), int(table["n"].iloc[s])
            left = low + int(table["step"].iloc[s]) * width
            if size > steps and width > 1e-12:
                smaller = counted(left, width / steps)
                look(smaller[smaller["step"] >= 0], start, left, width / steps, mine)
                continue
            v, c = values(left, width)
            ends = start + np.cumsum(c)
            at_rank.update((r, float(v[np.searchsorted(ends, r, side="right")])) for r in mine)

    look(first, 0, -1.0 - 1e-6, (2 + 2e-6) / steps, ranks)
    out = []
    for p in points:
        at = p * (n - 1)
        a, b = at_rank[int(np.floor(at))], at_rank[int(np.ceil(at))]
        out.append(a + (b - a) * (at - np.floor(at)))
    return n, mean, deviation, out
