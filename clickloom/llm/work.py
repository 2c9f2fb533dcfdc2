"""Shared helpers: work folders that every executor sees, files in them, and stable fractions."""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from clickloom import scale

#: A word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _class_of(*categories: str) -> str:
    """The characters of some Unicode categories, as ranges for a character class."""
    places = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in categories]
    starts = [c for k, c in enumerate(places) if not k or places[k - 1] != c - 1]
    ends = [c for k, c in enumerate(places) if k + 1 == len(places) or places[k + 1] != c + 1]
    return "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in zip(starts, ends))


#: Marks that belong to the letter before them (vowel signs, accents), for a character class.
MARKS = _class_of("Mn", "Mc")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder address below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return scale.scratch_path(spark, name)
    # A bare path means the default file system, to tasks as to Spark.
    base = base if ":" in base else scale.qualified(spark, base)
    return scale.register_scratch(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}-{name}")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a work folder and read it back: short lineage that outlives executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(address: str):
    """(file system, path) of a folder address, for file access inside tasks."""
    from pyarrow import fs

    if address.startswith("/"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def fraction(*cols: Column | str, salt: str = "") -> Column:
    """A number in (0, 1) that depends on the columns' values alone."""
    return (F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def may_be_in(keys: DataFrame, column: str) -> Column:
    """False only for values of the long ``column`` that ``keys`` lacks: a bit for each hash, in 2^23 bits whatever the table holds."""
    words = 1 << 17
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(64 * words))
    bits = keys.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(words).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("t")).scalar()
    return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % modulus


def bounded(rows: DataFrame, groups: Sequence[str], limit: int, salt: str) -> DataFrame:
    """About ``limit`` rows of each group, chosen by a hash of ``doc_id``; all of a smaller group.

    The groups are few (classes, languages); their counts come back as a table, not to the driver.
    """
    totals = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_total"))
    return (
        rows.join(F.broadcast(totals), list(groups))
        .where(fraction("doc_id", salt=salt) * F.col("_total") < limit)
        .drop("_total")
    )


def schemas(columns: str) -> tuple[StructType, pa.Schema]:
    """A "name type, ..." list as Spark's and as Arrow's schema."""
    schema = StructType.fromDDL(columns)
    return schema, to_arrow_schema(schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


#: Rows whose texts are Python objects at the same time.
SLICE = 256


def per_text(docs: DataFrame, make: Callable[[], Callable[[list], list[Sequence]]], columns: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and new ``columns`` ("name type, ...") for every row, computed from whole texts in tasks.

    ``make`` runs once in each task and returns a function from a list of texts (None for null) to
    one sequence per new column. Kept columns pass through as they are, nulls and large ids included.
    """
    new = StructType.fromDDL(columns)
    schema = StructType([*(docs.schema[c] for c in keep), *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = function(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), *(pa.array(x, kind) for x, kind in zip(made, kinds))], names=schema.names
                )

    return docs.select(*[F.col(c) for c in keep], F.col(text).cast("string")).mapInArrow(run, schema)


def text_column(function: Callable[[], Callable[[list], Sequence]], kind: str) -> Callable:
    """A column function of whole texts: ``function()`` runs once in a task, then on lists of texts."""

    @F.pandas_udf(kind)
    def column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = function()
        for part in parts:
            yield pd.Series([x for at in range(0, len(part), SLICE) for x in run(part.iloc[at : at + SLICE].tolist())], index=part.index)

    return column
