"""Reading event files and writing tables, exports, reports and vocabularies."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom import scale
from clickloom.functions import brand_title, known

# The event schema as it arrives, with the time still text, and its time pattern.
RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)
EVENT_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss z"
HOLDOUT_STEMS = ("2020-Mar", "2020-Apr")


# --------------------------------------------------------------------------- sources


def read_events_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scan headed CSV files with the fixed schema; no inference pass over the data."""
    return spark.read.option("header", True).schema(RAW_EVENT_SCHEMA).csv(paths)


def parse_event_time(df: DataFrame, column: str = "event_time") -> DataFrame:
    return df.withColumn(column, F.to_timestamp(F.col(column), EVENT_TIME_PATTERN))


def bad_event_times(df: DataFrame, column: str = "event_time") -> DataFrame:
    """One row: rows and how many non-null times do not follow the pattern."""
    parsed = F.try_to_timestamp(F.col(column), F.lit(EVENT_TIME_PATTERN))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("bad_times"),
    )


def load_with_rejects(spark: SparkSession, paths: str | Sequence[str], max_bad: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Tolerant load: (events, rejects). Empty text is null, malformed or jagged rows are rejected.

    ``rejects`` has the raw fields of every rejected row and the reason. The files are parsed once:
    rejected rows are observed while all rows are written as Parquet, and above ``max_bad`` the load
    fails before it returns anything. The header is checked against the schema, so unknown columns
    are refused.
    """
    corrupt = "_corrupt"
    schema = T.StructType([*RAW_EVENT_SCHEMA.fields, T.StructField(corrupt, T.StringType())])
    raw = (
        spark.read.option("header", True)
        .option("nullValue", "")
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", corrupt)
        # A pruned parser judges only the fields that a query reads; a row must be good or bad in all.
        .option("columnPruning", False)
        .schema(schema)
        .csv(paths)
    )
    when = F.try_to_timestamp(F.col("event_time"), F.lit(EVENT_TIME_PATTERN))
    malformed = F.col(corrupt).isNotNull() | (F.col("event_time").isNotNull() & when.isNull())
    seen = Observation()
    marked = raw.withColumn("_bad", malformed).observe(seen, F.count_if("_bad").alias("bad"))
    # One pass parses, writes and counts; what follows reads the written rows.
    marked = scale.cut_lineage(marked)
    if seen.get["bad"] > max_bad:
        raise ValueError(f"{seen.get['bad']} malformed rows, more than the {max_bad} allowed")
    reason = F.when(F.col(corrupt).isNotNull(), "fields do not match the columns").otherwise("event_time is no time")
    fields = [f.name for f in RAW_EVENT_SCHEMA.fields]
    rejects = marked.where("_bad").select(*fields, F.col(corrupt).alias("raw_row"), reason.alias("reason"))
    return marked.where(~F.col("_bad")).withColumn("event_time", when).drop(corrupt, "_bad"), rejects


def load_events(spark: SparkSession, paths: str | Sequence[str], max_bad: int = 1000) -> DataFrame:
    """The events of :func:`load_with_rejects`."""
    return load_with_rejects(spark, paths, max_bad)[0]


def split_holdout(paths: Iterable[str], stems: Sequence[str] = HOLDOUT_STEMS) -> tuple[list[str], list[str]]:
    """Split input files into (train, holdout) by file stem."""
    train, held = [], []
    for path in paths:
        stem = os.path.basename(path).split(".")[0]
        (held if stem in stems else train).append(path)
    return train, held


def scan_split(spark: SparkSession, path: str, held: Column) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) of a folder partitioned by file stem; each scan opens its own partitions only."""
    table = spark.read.parquet(path)
    return table.where(~held), table.where(held)


def table_size(spark: SparkSession, name: str) -> int | None:
    """Bytes of a catalog table as last analysed, or None."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Statistics'").collect()
    return int(rows[0]["data_type"].split()[0]) if rows else None


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet folder, only the named columns."""
    return spark.read.parquet(path).select(*columns)


def month_range(column: Column, month: str) -> Column:
    """``YYYY-MM`` as a range predicate on the raw column, so file statistics can skip data."""
    start = datetime.strptime(month, "%Y-%m")
    end = datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    return (column >= F.lit(start)) & (column < F.lit(end))


def load_window(df: DataFrame, month: str) -> DataFrame:
    """Item ids of one month; the item column may be called item_id or product_id."""
    names = [c for c in ("item_id", "product_id") if c in df.columns]
    if not names or "event_time" not in df.columns:
        raise ValueError("a window needs event_time and item_id or product_id")
    inside = month_range(F.col("event_time").cast("timestamp"), month)
    return df.where(inside).select(F.col(names[0]).alias("item_id"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, nullability, null count and the row count."""
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in df.schema]
    )
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("is_nullable"),
            F.col(f.name).alias("null_count"),
            F.col("_rows").alias("row_count"),
        )
        for i, f in enumerate(df.schema, 1)
    ]
    return stats.select(F.inline(F.array(*rows)))


def load_sessions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three sequence tables and their metadata record."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in ("train_sessions", "val_sessions", "test_sessions")}
    out["metadata"] = spark.read.json(f"{folder}/metadata")
    return out


# --------------------------------------------------------------------------- sinks


def write_events(df: DataFrame, path: str, n_files: int = 200) -> None:
    df.repartition(n_files).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a catalog table; with ``path`` the files live outside the warehouse folder."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Overwrite a catalog table whose files are dealt out and sorted by ``key``, and return it.

    Tables with equal buckets meet on the key without a shuffle, and a group by it needs none either.
    Rows are first brought together by bucket, so there is one file a bucket.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def append_metrics(df: DataFrame, path: str) -> None:
    """Add rows (run, epoch and figures) to a table of runs; rows of earlier runs stay."""
    df.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The table of runs; a run and epoch that was written again counts as last written."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("_at"))
    rest = [c for c in rows.columns if c not in ("run", "epoch", "_at")]
    last = rows.groupBy("run", "epoch").agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
    return last.select("run", "epoch", "_row.*")


def ctas(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a table from a query and return the stored table; rerunning is harmless."""
    save_table(df, name, path)
    return df.sparkSession.table(name)


def export_parquet(df: DataFrame, path: str, ts_cols: Sequence[str] = ("event_time",)) -> None:
    """Sharded export with the time columns forced to TIMESTAMP."""
    typed = df.withColumns({c: F.col(c).cast("timestamp") for c in ts_cols})
    typed.write.mode("overwrite").parquet(path)


def export_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Export ordered by key: range partitions, sorted inside, files in key order."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report as a JSON folder, every record of it, in as many files as its rows have partitions."""
    df.write.mode("overwrite").json(path)


def write_vocab(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write, then continue from the files: a barrier in front of iterative work."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_round(df: DataFrame) -> DataFrame:
    return scale.cut_lineage(df)


# --------------------------------------------------------------------------- catalog


def build_catalog(item_features: DataFrame, n: int = 2000, presets: Sequence[int] = ()) -> DataFrame:
    """Top-n items by confidence plus forced ids, as a compact lookup."""
    compact = item_features.select(
        F.col("product_id").cast("string").alias("item_id"),
        known("cat_l1").alias("c1"),
        known("cat_l2").alias("c2"),
        brand_title("brand").alias("brand"),
        # Half a cent counts up. The order of summing moves a mean by less than the slack, so it can't move the cent.
        F.coalesce(F.floor(F.col("avg_price").cast("double") * 100 + 0.500001) / 100, F.lit(0.0)).alias("price"),
        F.col("item_total_confidence").cast("long").alias("interactions"),
        "product_id",
    )
    order = [F.desc("interactions"), F.asc("product_id")]
    top = compact.orderBy(*order).limit(n)
    forced = compact.where(F.col("product_id").isin(*presets)) if presets else compact.where(F.lit(False))
    return top.unionByName(forced).dropDuplicates(["product_id"]).drop("product_id", "interactions")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("c1").agg(F.count(F.lit(1)).alias("items"))


def catalog_search(catalog: DataFrame, text: str = "", category: str | None = None, n: int = 20) -> DataFrame:
    """First n catalog items of a category whose brand, level-2 category or id contains ``text``."""
    hits = catalog if category is None else catalog.where(F.col("c1") == category)
    q = text.lower()
    if q:
        hits = hits.where(
            F.lower("brand").contains(q) | F.lower("c2").contains(q) | F.col("item_id").contains(q)
        )
    return hits.orderBy(F.col("item_id").cast("long")).limit(n)
