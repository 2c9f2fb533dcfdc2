"""Building blocks that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(user)`` sends a hot user's whole history to one task, and an
unpartitioned window sends the whole table there. The helpers below give the same answers from
bounded pieces: keyed windows are cut into time slices and stitched with one small row per slice,
global ranks come from a range-partitioned sort plus one row per partition, and exact percentiles
come from those ranks.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 8
DAY = 86_400
FEW_BYTES = 2 << 20  # of files, of a table that may be sent to all tasks
# The row number inside a partition takes the low 33 bits of monotonically_increasing_id().
_ROW_BITS = 33


_scratch: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``; only a local master may fall back to /tmp."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        # One machine only: its temporary folder is shared by all tasks, and goes with the process.
        folder = tempfile.mkdtemp(prefix="clickloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back; survives lost executors."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return register_scratch(f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}-{name}")


def register_scratch(path: str) -> str:
    """Have :func:`remove_scratch` delete a folder too; returns its address."""
    _scratch.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The address with its file system, as Spark resolves a bare path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def remove_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder of this process. Frames that were stored in them end with that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def epoch_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970, rounded down."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(col.cast("timestamp"))


def _estimated(df: DataFrame) -> tuple[int, int]:
    """What Spark takes a frame's bytes for before it runs, and up to what it sends one side of a join to all tasks."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)), df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def by_size(df: DataFrame, copies: int = 1) -> DataFrame:
    """One side of a join, kept from going through the driver to all tasks if it is more than a small table.

    Before a query runs, Spark judges a stored table by the bytes of its files, and rows take ten to forty
    times as much in memory as compressed columns of short texts and near keys: 5 MB of files are 140 MB in
    the driver. From ``FEW_BYTES`` of files on, with ``copies`` of each row, both sides are shuffled.
    Frames that Spark would not send out by that estimate keep the choice made from their true size.
    """
    size, most = _estimated(df)
    return df.hint("merge") if FEW_BYTES / copies < size <= most else df


def as_whole(df: DataFrame) -> DataFrame:
    """A table that is too large to be sent to all tasks is not sent with fewer columns either: its rows stay as many."""
    size, most = _estimated(df)
    return df.hint("merge") if 0 <= most < size else df


def beside(row: DataFrame, other: DataFrame) -> DataFrame:
    """Put the columns of one one-row frame next to another's, through a scalar subquery."""
    packed = other.select(F.struct(*other.columns).alias("_row")).scalar()
    return row.withColumn("_other", packed).select(*row.columns, "_other.*")


# --------------------------------------------------------------------------- global order


def _ordered_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # The range bounds come from a sample, so the placement is fixed once, before it is read twice.
    placed = cut_lineage(placed)
    return placed.withColumn("_block", F.shiftright("_mid", _ROW_BITS))


def _before_block(blocks: DataFrame, amount: Column) -> DataFrame:
    """One row per partition: the total of ``amount`` in all earlier partitions."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("_block").agg(amount.alias("_amount"))
    offsets = sizes.select("_block", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before"))
    # As many rows as the sort has partitions, whatever the table holds.
    return F.broadcast(offsets)


def add_position(df: DataFrame, order: Sequence[Column], name: str = "position", start: int = 1) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in ``order`` without a one-partition window."""
    blocks = _ordered_blocks(df, order)
    offsets = _before_block(blocks, F.count(F.lit(1)))
    within = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        blocks.join(offsets, "_block")
        .withColumn(name, within + F.col("_before") + F.lit(start))
        .drop("_block", "_mid", "_before")
    )


def first_rows(df: DataFrame, hashed: Column, n: int, tie: Sequence[Column] = (), steps: int = 4_096) -> DataFrame:
    """The ``n`` rows with the smallest ``hashed`` (0 to 2^60, as :func:`draw` gives it), then by ``tie``.

    The table is neither sorted nor stored. The n-th smallest value is found by histograms: a round
    counts the values between two bounds in ``steps`` equal steps and the next one looks inside the
    step that holds it, until that holds few rows or a single value. Rows below are kept by a filter;
    only the rows of the last step are ordered.
    """
    rows = df.withColumn("_h", hashed)
    low, high, below = 0, 1 << 60, 0
    while n > 0:
        width = max(1, (high - low) // steps)
        inside = rows.where((F.col("_h") >= low) & (F.col("_h") < high))
        # At most ``steps`` rows.
        counts = inside.groupBy(F.floor((F.col("_h") - low) / width).alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy("s").collect()
        for s, size in counts:
            if below + size >= n:
                break
            below += size
        else:
            return rows.drop("_h")  # no more than n rows
        low, high = low + s * width, min(high, low + (s + 1) * width)
        if size <= steps or width == 1:
            break
    if n <= 0:
        return df.limit(0)
    last = first_of(rows.where((F.col("_h") >= low) & (F.col("_h") < high)), [F.col("_h"), *tie], n - below)
    return rows.where(F.col("_h") < low).unionByName(last).drop("_h")


def first_of(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, cut at a global position: n may be large, no task holds them all."""
    return add_position(df, order, "_position").where(F.col("_position") <= n).drop("_position")


def add_running_total(
    df: DataFrame,
    order: Sequence[Column],
    value: str,
    total: str = "running",
    position: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` (this row included) over the whole table in ``order``."""
    blocks = _ordered_blocks(df, order)
    offsets = _before_block(blocks, F.sum(value))
    so_far = Window.partitionBy("_block").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(offsets, "_block").withColumn(total, F.sum(value).over(so_far) + F.col("_before"))
    if position:
        counts = _before_block(blocks, F.count(F.lit(1))).withColumnRenamed("_before", "_rows_before")
        within = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
        out = out.join(F.broadcast(counts), "_block").withColumn(
            position, within + F.col("_rows_before") + F.lit(1)
        )
    return out.drop("_block", "_mid", "_before", "_rows_before")


# --------------------------------------------------------------------------- percentiles


def percentile_name(p: float) -> str:
    return f"p{round(p * 100):d}"


def percentiles(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """One row with the exact interpolated percentiles of a column of any cardinality.

    Equal values are first merged into counts, the counts are summed in value order, and each
    percentile reads the one or two values that cover its rank.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # The ranked counts come from checkpoint files, so the total costs one pass over those.
    ranked = add_running_total(counts, [F.col("_v")], "_n", "_upto")
    size = ranked.agg(F.sum("_n")).first()[0] or 0
    start = F.col("_upto") - F.col("_n")

    def covering(rank: int) -> Column:
        return F.max(F.when((start <= rank) & (F.col("_upto") > rank), F.col("_v").cast("double")))

    out = []
    for p in points:
        at = float(p) * max(size - 1, 0)
        low, high = covering(math.floor(at)), covering(math.ceil(at))
        out.append((low + (high - low) * (at - math.floor(at))).alias(percentile_name(p)))
    return ranked.agg(*out)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Merge equal values of ``column`` into ``(v, n)``; the input of :func:`percentile_of_counts`."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )


def percentile_of_counts(p: float) -> Column:
    """Exact percentile over :func:`value_counts` rows.

    Meant for columns that are themselves row counts per key (or minutes in a fixed time span):
    d distinct counts need at least d(d+1)/2 rows, so even 10^12 rows give under 1.5 million
    distinct values for the final merge.
    """
    return F.percentile("v", F.lit(float(p)), F.col("n"))


# --------------------------------------------------------------------------- keyed order


def _scanned(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """The rows in ranges of (keys, time, tie), stored; the key of a row as one value; a window inside a range.

    A range may begin and end anywhere, also inside a key's day or among equal times, so a key of any
    weight spreads over as many tasks as its rows fill ranges.
    """
    order = [F.col(c) for c in (*keys, time, *tie)]
    blocks = _ordered_blocks(df, order)
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return blocks, key, Window.partitionBy("_block").orderBy("_mid")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    columns: dict[str, str],
) -> DataFrame:
    """``lag`` per key as a scan: add ``columns`` (new name -> source) of the key's previous row.

    Every range looks back inside itself. Its first row takes what the last row of the range before
    holds, carried over as one row per range, if that row has the same key.
    """
    blocks, key, inside = _scanned(df, keys, time, tie)
    packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    both = F.struct(key.alias("key"), packed.alias("row"))
    lasts = blocks.groupBy("_block").agg(F.max_by(both, F.col("_mid")).alias("_last"))
    # As many rows as there are ranges.
    carried = lasts.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_carried"))
    out = blocks.withColumn("_here", F.lag(both).over(inside)).join(F.broadcast(carried), "_block")
    before = F.coalesce("_here", "_carried")
    for new in columns:
        out = out.withColumn(new, F.when(before["key"].eqNullSafe(key), before["row"][new]))
    return out.drop("_block", "_mid", "_here", "_carried")


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    value: Column,
    name: str,
) -> DataFrame:
    """Running sum per key (this row included) as a scan, from ranges as in :func:`with_previous`.

    A key that is open at a range's end hands on its sum so far: sums of ranges that end in the same
    key add up in their order, and a range begins with what the one before hands on, if the key goes on.
    """
    blocks, key, _ = _scanned(df.withColumn("_value", value), keys, time, tie)
    of_key = Window.partitionBy("_block", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("_here", F.sum("_value").over(of_key))
    ends = summed.groupBy("_block").agg(F.max_by(F.struct(key.alias("key"), F.col("_here").alias("sum")), F.col("_mid")).alias("_end"))
    so_far = Window.partitionBy("_end.key").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    handed = ends.select("_block", F.struct(F.col("_end.key").alias("key"), F.sum("_end.sum").over(so_far).alias("sum")).alias("_open"))
    carried = handed.select("_block", F.lag("_open").over(Window.orderBy("_block")).alias("_carried"))
    goes_on = F.col("_carried.key").eqNullSafe(key)
    return (
        summed.join(F.broadcast(carried), "_block")
        .withColumn(name, F.col("_here") + F.when(goes_on, F.col("_carried.sum")).otherwise(F.lit(0)))
        .drop("_block", "_mid", "_value", "_here", "_carried")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    For small ``n`` the optimizer's group limit drops surplus rows before the shuffle. A large
    ``n`` is beyond its threshold, so callers that need one use :func:`top_many_per_key`.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final).cast("long")).where(F.col(rank) <= n)


def top_many_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """:func:`top_per_key` for large ``n``: a salted first pass cuts what a hot key sends to its last task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop("_salt", rank)
    return top_per_key(kept, keys, order, n, rank)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join where a key of ``big`` may be hot and ``small`` has few rows per key.

    ``big`` rows spread over ``salts`` partitions per key; ``small`` is repeated once per salt. It may have
    many keys, and Spark doesn't count the repeats before they are made, so :func:`by_size` does.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = by_size(small, salts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def draw(seed: int, *parts: Column | str) -> Column:
    """A repeatable 60-bit random number from the row's own key, the same in any partitioning."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
