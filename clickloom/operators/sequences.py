"""Session and user sequences as arrays, model-ready rows, and their invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import EVENT_CODES, PAD, Config
from clickloom.functions import init, left_pad, n_rows

SESSION = ("user_idx", "user_session")


def drop_repeats(mapped: DataFrame, keys: Sequence[str] = SESSION, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Drop an event whose item equals the previous item of its session, whatever its type."""
    marked = scale.with_previous(mapped, keys, "event_time", tie, {"_previous": "item_idx"})
    return marked.where(F.col("_previous").isNull() | (F.col("_previous") != F.col("item_idx"))).drop("_previous")


def last_per_key(df: DataFrame, keys: Sequence[str], n: int, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """The n most recent rows of each key."""
    newest = [F.desc("event_time"), *[F.desc(c) for c in tie]]
    return scale.top_per_key(df, list(keys), newest, n, "_age").drop("_age")


def collect_sequences(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """One row per key with item_seq and event_seq in time order. The caller bounds rows per key."""
    packed = F.sort_array(F.collect_list(F.struct("event_time", *tie, "item_idx", "event_idx")))
    rows = df.groupBy(*keys).agg(packed.alias("_rows"))
    return rows.select(
        *keys,
        F.col("_rows.item_idx").alias("item_seq"),
        F.col("_rows.event_idx").alias("event_seq"),
        F.size("_rows").cast("long").alias("seq_len"),
    )


def session_sequences(mapped: DataFrame, min_len: int = Config.session_min_len, max_len: int = Config.session_max_len) -> DataFrame:
    """Repeat removal, then the last ``max_len`` events, then sessions of at least ``min_len``."""
    kept = last_per_key(drop_repeats(mapped), SESSION, max_len)
    return collect_sequences(kept, SESSION).where(F.col("seq_len") >= min_len)


def add_contiguous_id(seq: DataFrame, name: str = "session_idx", order: Sequence[str] = SESSION, start: int = 0) -> DataFrame:
    return scale.add_position(seq, [F.col(c) for c in order], name, start)


def user_sequences(mapped: DataFrame, end=None, min_len: int = 2, chunk: int = 10_000) -> DataFrame:
    """Every event of a user before ``end`` in order, without repeat removal or truncation.

    A history longer than ``chunk`` continues in further rows (chunk 1, 2, ...), so no user, however
    busy, becomes one giant array; ``seq_len`` is the length of the whole history.
    """
    ev = mapped if end is None else mapped.where(F.col("event_time") < F.lit(end).cast("timestamp"))
    totals = ev.groupBy("user_idx").agg(n_rows().alias("seq_len")).where(F.col("seq_len") >= min_len)
    placed = scale.with_running_sum(ev, ["user_idx"], "event_time", ["event_id"], F.lit(1).cast("long"), "_at")
    cut = placed.withColumn("chunk", F.floor((F.col("_at") - 1) / chunk))
    arrays = collect_sequences(cut, ["user_idx", "chunk"]).drop("seq_len")
    return arrays.join(totals, "user_idx").select("user_idx", "chunk", "item_seq", "event_seq", "seq_len")


def val_targets(mapped: DataFrame, low, high) -> DataFrame:
    """First cart or purchase of each (user, item) inside the half-open window."""
    time = F.col("event_time")
    hot = mapped.where(
        (time >= F.lit(low).cast("timestamp")) & (time < F.lit(high).cast("timestamp"))
        & F.col("event_type").isin("cart", "purchase")
    )
    first = F.min(F.struct("event_time", "event_id", "event_type", "product_id", "user_id"))
    return hot.groupBy("user_idx", "item_idx").agg(first.alias("f")).select(
        "user_idx", "item_idx", "f.event_type", "f.product_id", "f.event_time", "f.user_id"
    )


def sequence_profile(seq: DataFrame, max_len: int = Config.session_max_len) -> DataFrame:
    """Length distribution, users, sequences per user, and the share longer than ``max_len``."""
    v, n = F.col("v"), F.col("n")
    lengths = scale.value_counts(seq, "seq_len").agg(
        F.sum(n).alias("sequences"), F.min(v).alias("min_len"), F.max(v).alias("max_len"),
        F.round(F.sum(v * n) / F.sum(n), 6).alias("mean_len"),
        *[F.round(scale.percentile_of_counts(p), 6).alias(f"{scale.percentile_name(p)}_len") for p in (0.5, 0.9, 0.99)],
        F.round(F.coalesce(F.sum(F.when(v > max_len, n)), F.lit(0)) * 100 / F.sum(n), 4).alias("pct_over_max"),
    )
    users = seq.agg(F.count_distinct("user_idx").alias("c")).scalar()
    return lengths.withColumn("users", users).withColumn("per_user", F.round(F.col("sequences") / F.col("users"), 6))


def _whole(seq: DataFrame) -> DataFrame:
    if "chunk" in seq.columns:
        raise ValueError("rows of chunked histories are not sequences of their own; cut them to length first")
    return seq


def shift_targets(seq: DataFrame, n: int) -> DataFrame:
    """Padded training rows of length n-1: input, next-item target, and the mask of real targets."""
    seq = _whole(seq)
    items, events = left_pad("item_seq", n), left_pad("event_seq", n)
    target = F.slice(items, 2, n - 1)
    return seq.withColumns(
        {
            "input_items": F.slice(items, 1, n - 1),
            "input_events": F.slice(events, 1, n - 1),
            "target_items": target,
            "mask": F.transform(target, lambda x: x != PAD),
        }
    ).drop("item_seq", "event_seq")


def prefix_target(seq: DataFrame, n: int) -> DataFrame:
    """Evaluation rows: the last item is the target, the rest is left-padded to n-1."""
    seq = _whole(seq)
    return seq.withColumns(
        {
            "target": F.element_at("item_seq", -1),
            "prefix_items": left_pad(init("item_seq"), n - 1),
            "prefix_events": left_pad(init("event_seq"), n - 1),
        }
    ).drop("item_seq", "event_seq")


def user_prefix(users: DataFrame, mapped: DataFrame, n: int, end=None, min_len: int = 2) -> DataFrame:
    """The last n events before ``end`` of every user, padded; zeros and has_history = false without.

    Histories of fewer than ``min_len`` events count as none. Only the last events of a user are
    ever collected, however long the history.
    """
    ev = mapped if end is None else mapped.where(F.col("event_time") < F.lit(end).cast("timestamp"))
    recent = collect_sequences(last_per_key(ev, ["user_idx"], max(n, min_len)), ["user_idx"]).where(F.col("seq_len") >= min_len)
    newest = recent.select("user_idx", F.struct("item_seq", "event_seq").alias("s"))
    zeros = F.array_repeat(F.lit(0).cast("long"), n)
    return users.select("user_idx").join(newest, "user_idx", "left").select(
        "user_idx",
        F.coalesce(left_pad("s.item_seq", n), zeros).alias("prefix_items"),
        F.coalesce(left_pad("s.event_seq", n), zeros).alias("prefix_events"),
        F.col("s").isNotNull().alias("has_history"),
    )


def prefix_pairs(seq: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """All (prefix, next item) pairs of each sequence; sequences are already cut to the maximum length."""
    cuts = seq.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("seq_len").cast("int") - 1)))
    return cuts.select(
        *keys, "t", F.slice("item_seq", F.lit(1), F.col("t")).alias("prefix"), F.element_at("item_seq", F.col("t") + 1).alias("target")
    )


def user_history(tp: DataFrame, n: int = 20, time: str = "last_interaction") -> DataFrame:
    """The last n items of each user by interaction time, oldest first, left-padded."""
    newest = scale.top_per_key(tp, ["user_idx"], [F.desc(time), F.desc("item_idx")], n, "_age")
    rows = newest.groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct(time, "item_idx"))).alias("_rows"))
    return rows.select("user_idx", left_pad("_rows.item_idx", n).alias("history"))


def validate_sequences(seq: DataFrame, min_len: int = 2, max_len: int = 20, expected_rows: Column | int | None = None) -> DataFrame:
    """Counts of broken rows per rule, and whether the row count equals the metadata."""
    items = F.col("item_seq")
    repeats = F.exists(F.sequence(F.lit(2), F.greatest(F.size(items), F.lit(2))), lambda i: F.get(items, i - 1) == F.get(items, i - 2))
    out = seq.agg(
        n_rows().alias("n_rows"),
        F.count_if(F.size(items) > max_len).alias("too_long"),
        F.count_if(F.size(items) < min_len).alias("too_short"),
        F.count_if(F.element_at(items, -1) == PAD).alias("pad_last"),
        F.count_if(repeats).alias("adjacent_repeats"),
        F.count_if(F.size(items) != F.size("event_seq")).alias("uneven"),
    )
    if expected_rows is not None:
        want = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
        out = out.withColumn("rows_match", F.col("n_rows") == want)
    return out


def sessionize(ev: DataFrame, gap_seconds: int = 1800, user: str = "user_id", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Number sessions per user: a new one starts after ``gap_seconds`` without events."""
    timed = scale.with_previous(ev, [user], "event_time", tie, {"_before": "event_time"})
    idle = scale.epoch_seconds("event_time") - scale.epoch_seconds("_before")
    starts = timed.withColumn("_start", F.when(F.col("_before").isNull() | (idle >= gap_seconds), 1).otherwise(0).cast("long"))
    return scale.with_running_sum(starts, [user], "event_time", tie, F.col("_start"), "session_no").drop("_before", "_start")


def session_metadata(sets: dict[str, DataFrame], max_len: int = Config.session_max_len) -> DataFrame:
    """One record: rows per split, limits and the event code map."""
    spark = next(iter(sets.values())).sparkSession
    counts = {f"n_{name}": df.agg(n_rows().alias("c")).scalar() for name, df in sets.items()}
    codes = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    return spark.range(1).select(
        *[c.alias(n) for n, c in counts.items()], F.lit(max_len).alias("max_seq_len"), F.lit(PAD).alias("pad"),
        codes.alias("event_type_map"),
    )


def save_sessions(sets: dict[str, DataFrame], folder: str, max_len: int = Config.session_max_len) -> None:
    """Write one table per split and the metadata record beside them."""
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}_sessions")
    stored = {n: df.sparkSession.read.parquet(f"{folder}/{n}_sessions") for n, df in sets.items()}
    session_metadata(stored, max_len).write.mode("overwrite").json(f"{folder}/metadata")
