"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, sid string, fp string, target string, score string, label string, place string"
EXTRA = ("size", "x", "y", "z", "v", "w", "u")

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n\x0b\x0c\r ", "en", None),
    (None, "a text without an id, Straße İstanbul ÀÉ 123", "de", "c"),
    (6, "one two", "en", "c"),
    (7, LONG, "en", "a"),
    (8, "x" * 50_000, None, "b"),
    (9, "über die Straße läuft ein Hund und noch ein Hund", "de", "b"),
    (10, "emoji 😀 and \x00 control   separators 　 wide", "en", "c"),
    (11, "!!! ??? ...", "en", "a"),
    (12, "1234 5678", "en", "a"),
]


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (9, 1, 1), (10, 0, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df: DataFrame) -> list[dict]:
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))
