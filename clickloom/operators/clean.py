"""Filters, duplicate and bot removal, k-core, and the cleaning report."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import UNKNOWN, Config
from clickloom.functions import part_of

DUP_KEYS = ("event_time", "event_type", "product_id", "user_id", "user_session")
NEAR_KEYS = ("user_id", "product_id", "event_type")


# --------------------------------------------------------------------------- predicates


def fill_unknown(ev: DataFrame, columns: Sequence[str] = ("category_code", "brand")) -> DataFrame:
    return ev.fillna(UNKNOWN, subset=list(columns))


def drop_null_session(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("user_session").isNotNull())


def price_floor(ev: DataFrame, floor: float = Config.price_floor) -> DataFrame:
    return ev.where(F.col("price") >= floor)


def high_intent(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type").isin("cart", "purchase"))


def min_confidence(tp: DataFrame, c: float = 2.0) -> DataFrame:
    """Pairs with score >= c. Two views reach 2 as well, so this is not 'cart or purchase only'."""
    return tp.where(F.col("confidence_score") >= c)


def min_confidence_report(tp: DataFrame, c: float = 2.0) -> DataFrame:
    kept = F.col("confidence_score") >= c
    return tp.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(kept).alias("kept"),
        F.round(F.count_if(kept) * 100 / F.count(F.lit(1)), 4).alias("kept_pct"),
        F.count_distinct(F.when(kept, F.col("user_idx"))).alias("users"),
        F.count_distinct(F.when(kept, F.col("item_idx"))).alias("items"),
    )


def in_category(ev: DataFrame, level1: str) -> DataFrame:
    return ev.where(part_of("category_code", 0) == level1)


# --------------------------------------------------------------------------- duplicates


def exact_dedup(ev: DataFrame, keys: Sequence[str] = DUP_KEYS) -> DataFrame:
    """One row per key. The survivor is the smallest of the remaining columns, so reruns agree.

    A min aggregate merges copies before the shuffle, whatever their number.
    """
    rest = [c for c in ev.columns if c not in keys]
    kept = ev.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*ev.columns)


def _gaps(seconds: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Add the gap to the previous ``_second`` of the key, exact for gaps up to ``reach``.

    The window runs inside (key, day). A second near the end of a day is also shown to the next day, so
    gaps across midnight are seen and no key gathers in one task.
    """
    day = F.floor(F.col("_second") / scale.DAY)
    late = F.pmod(F.col("_second"), F.lit(scale.DAY)) >= scale.DAY - reach
    shown = seconds.withColumn("_day", day).withColumn(
        "_shown", F.explode(F.when(late, F.array("_day", F.col("_day") + 1)).otherwise(F.array("_day")))
    )
    w = Window.partitionBy(*keys, "_shown").orderBy("_second")
    marked = shown.withColumn("_gap", F.col("_second") - F.lag("_second").over(w))
    return marked.where(F.col("_shown") == F.col("_day"))


def near_dedup(
    ev: DataFrame, seconds: int = Config.near_dup_seconds, keys: Sequence[str] = NEAR_KEYS, tie: str = "event_id"
) -> DataFrame:
    """Drop a row whose whole-second gap to the previous row of its (user, item, type) is too small.

    Rows of one second collapse to their first before the shuffle; what is left to compare are the
    seconds of a key.
    """
    rest = [c for c in ev.columns if c not in keys]
    by_time = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(["event_time", *([tie] if tie in rest else [])])])
    packed = F.struct(by_time.alias("order"), F.struct(*rest).alias("row"))
    first = ev.groupBy(*keys, scale.epoch_seconds("event_time").alias("_second")).agg(F.min(packed).alias("_first"))
    keep = F.col("_gap").isNull() | (F.col("_gap") > seconds)
    return _gaps(first, keys, seconds).where(keep).select(*keys, "_first.row.*").select(*ev.columns)


def near_dup_counts(ev: DataFrame, windows: Sequence[int] = (1, 5, 30), keys: Sequence[str] = NEAR_KEYS) -> DataFrame:
    """Rows that follow another row of the same key within each window."""
    per_second = ev.groupBy(*keys, scale.epoch_seconds("event_time").alias("_second")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    gaps = _gaps(per_second, keys, max(windows))

    def close(w: int) -> Column:
        return F.sum(F.col("_n") - 1 + F.when(F.col("_gap") <= w, 1).otherwise(0)).cast("long")

    return gaps.agg(
        F.sum("_n").alias("total_rows"),
        *[close(w).alias(f"near_dupe_within_{w}s") for w in windows],
        F.round(close(windows[0]) / F.sum("_n") * 100, 4).alias(f"pct_near_dupe_{windows[0]}s"),
    )


# --------------------------------------------------------------------------- bots


def bot_users(ev: DataFrame, per_day: float = Config.bot_events_per_day) -> DataFrame:
    """Users whose mean daily event count over their active days is above the threshold."""
    daily = ev.groupBy("user_id", F.to_date("event_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("user_id").agg(F.avg("n").alias("events_per_day")).where(F.col("events_per_day") > per_day)


def remove_bots(ev: DataFrame, per_day: float = Config.bot_events_per_day) -> DataFrame:
    return ev.join(bot_users(ev, per_day).select("user_id"), "user_id", "left_anti").select(*ev.columns)


# --------------------------------------------------------------------------- k-core


def _pairs(ev: DataFrame) -> DataFrame:
    return ev.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))


def _survivors(pairs: DataFrame, key: str, k: int) -> DataFrame:
    return pairs.groupBy(key).agg(F.sum("n").alias("total")).where(F.col("total") >= k).select(key)


FOLD = 16  # rounds of the k-core between two fresh sums


class NotConverged(RuntimeError):
    """Raised when the allowed rounds end before the k-core stands still."""


def _sides(pairs: DataFrame) -> DataFrame:
    """(is_user, key, n): every pair seen from its user and from its item."""
    users = pairs.select(F.lit(True).alias("is_user"), F.col("user_id").alias("key"), "n")
    return users.union(pairs.select(F.lit(False), "product_id", "n"))


def _degrees(pairs: DataFrame) -> DataFrame:
    return scale.cut_lineage(_sides(pairs).groupBy("is_user", "key").agg(F.sum("n").alias("total")))


def _keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("is_user").select(F.col("key").alias("user_id")), rows.where("NOT is_user").select(F.col("key").alias("product_id"))


def _without(pairs: DataFrame, dead: DataFrame | None) -> DataFrame:
    if dead is None:
        return pairs
    users, items = _keys(dead)
    return pairs.join(users, "user_id", "left_anti").join(items, "product_id", "left_anti")


def k_core_rounds(ev: DataFrame, k: int = Config.core_k, max_rounds: int | None = Config.core_rounds, report: bool = False):
    """Peel (user, item, count) pairs; return the surviving pairs and one record per round.

    Degrees are summed once and stored. From then on only what a round removes moves: the pairs of the
    keys that fell below k are taken out of the stored pairs (a filter where these keys are few, else a
    join), and their counts are subtracted from the degrees of the keys on their other side. Only keys
    touched in this way can fall next. When half of the stored pairs are gone, or after ``FOLD`` rounds,
    the rest is written anew, so plans stay short.
    The loop goes on until a round removes nothing; with ``max_rounds`` it fails if that takes longer.
    """
    every = scale.cut_lineage(_pairs(ev))
    before = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # Events without a user or item count for no key; they go with the first round.
    pairs = every.where("user_id IS NOT NULL AND product_id IS NOT NULL")
    base = _degrees(pairs)
    sizes = base.agg(F.count_if("is_user").alias("users"), F.count_if(~F.col("is_user")).alias("items"), F.coalesce(F.sum(F.when(F.col("is_user"), F.col("total"))), F.lit(0)).alias("events")).first()
    users, items, events = sizes
    stored, weak, dead, history, rounds = events, base.where(F.col("total") < k), None, None, []
    for i in itertools.count(1):
        if max_rounds is not None and i > max_rounds:
            raise NotConverged(f"the {k}-core still shrank in round {max_rounds}")
        weak_users, weak_items = _keys(weak)
        of_items = pairs.join(weak_items, "product_id", "left_semi").join(weak_users, "user_id", "left_anti")
        fallen = pairs.join(weak_users, "user_id", "left_semi").unionByName(of_items)
        removed = scale.cut_lineage(_without(fallen, dead))
        n = removed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if n:
            history = removed if history is None else history.unionByName(removed)
            touched = _sides(removed).select("is_user", "key").distinct()
            gone = _sides(history).join(touched, ["is_user", "key"], "left_semi").groupBy("is_user", "key").agg(F.sum("n").alias("gone"))
            state = scale.cut_lineage(base.join(gone, ["is_user", "key"]).select("is_user", "key", (F.col("total") - F.col("gone")).alias("total")))
            if report:
                empty = state.where("total = 0").agg(F.count_if("is_user").alias("users"), F.count_if(~F.col("is_user")).alias("items")).first()
                users, items = users - empty["users"], items - empty["items"]
        events -= n
        rounds.append((i, events, *((users, items) if report else ()), before - events))
        if before == events:
            return _without(pairs, dead), rounds
        before = events
        dead = weak if dead is None else dead.unionByName(weak)
        weak = state.where((F.col("total") > 0) & (F.col("total") < k)) if n else base.limit(0)
        if 2 * events < stored or i % FOLD == 0:
            pairs, dead, history, stored = scale.cut_lineage(_without(pairs, dead)), None, None, events
            base = _degrees(pairs)


def k_core(ev: DataFrame, k: int = Config.core_k, max_rounds: int | None = Config.core_rounds) -> DataFrame:
    """Events whose user and item both keep at least k events."""
    pairs, _ = k_core_rounds(ev, k, max_rounds)
    return ev.join(pairs.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi").select(*ev.columns)


def k_core_report(ev: DataFrame, k: int = Config.core_k, max_rounds: int | None = Config.core_rounds) -> DataFrame:
    _, rounds = k_core_rounds(ev, k, max_rounds, report=True)
    return ev.sparkSession.createDataFrame(rounds, "round int, events long, users long, items long, removed long")


def core_simulation(ev: DataFrame, k: int = 5, rounds: int = 3) -> DataFrame:
    """Sizes after each of a fixed number of rounds; pairs and survivors are stored once a round.

    The last row counts surviving keys rather than the keys left in the events, as the report does.
    """
    def sized(pairs: DataFrame, stage: str, users: DataFrame | None = None, items: DataFrame | None = None):
        one = pairs.agg(
            F.count_distinct("user_id").alias("users"),
            F.count_distinct("product_id").alias("items"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        )
        if users is not None:
            one = one.withColumns(
                {
                    "users": users.agg(F.count(F.lit(1)).alias("c")).scalar(),
                    "items": items.agg(F.count(F.lit(1)).alias("c")).scalar(),
                }
            )
        return one.select(F.lit(stage).alias("stage"), "users", "items", "events")

    pairs = scale.cut_lineage(_pairs(ev))
    out = sized(pairs, "raw")
    for i in range(1, rounds + 1):
        users, items = (scale.cut_lineage(_survivors(pairs, key, k)) for key in ("user_id", "product_id"))
        pairs = scale.cut_lineage(pairs.join(users, "user_id", "left_semi").join(items, "product_id", "left_semi"))
        last = i == rounds
        out = out.unionByName(
            sized(pairs, f"after_round_{i}", users if last else None, items if last else None)
        )
    return out


# --------------------------------------------------------------------------- composition

STEPS = ("raw", "null_session", "exact_dedup", "near_dedup", "price_floor", "bots")


def clean_steps(ev: DataFrame, cfg: Config = Config(), upto: str = STEPS[-1]) -> dict[str, DataFrame]:
    """The table after every cleaning step up to ``upto``, in the fixed order.

    Removing bots reads its input twice, so the floored table is written once before it.
    """
    actions = (
        lambda df: df,
        lambda df: drop_null_session(fill_unknown(df)),
        exact_dedup,
        lambda df: near_dedup(df, cfg.near_dup_seconds),
        lambda df: price_floor(df, cfg.price_floor),
        lambda df: remove_bots(scale.cut_lineage(df), cfg.bot_events_per_day),
    )
    steps = {}
    for name, action in zip(STEPS, actions):
        ev = action(ev)
        steps[name] = ev
        if name == upto:
            break
    return steps


def clean(ev: DataFrame, cfg: Config = Config(), core: bool = True) -> DataFrame:
    out = clean_steps(ev, cfg)["bots"]
    if not core:
        return out
    # The k-core reads its input twice (pairs, then the final semi join): write it once.
    return k_core(scale.cut_lineage(out), cfg.core_k, cfg.core_rounds)


def cleaning_report(ev: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows after each step, rows removed by it, the share of raw rows removed so far, and bot users.

    The two duplicate steps are written once each, so no step is computed again for the next count.
    """
    count = F.count(F.lit(1))
    start = ev.agg(count.alias("raw"), F.count_if(F.col("user_session").isNotNull()).alias("null_session"))
    exact = scale.cut_lineage(exact_dedup(drop_null_session(fill_unknown(ev))))
    near = scale.cut_lineage(near_dedup(exact, cfg.near_dup_seconds))
    daily = (
        price_floor(near, cfg.price_floor)
        .groupBy("user_id", F.to_date("event_time").alias("day"))
        .agg(count.alias("n"))
        .groupBy("user_id")
        .agg(F.sum("n").alias("rows"), F.avg("n").alias("per_day"))
    )
    human = F.col("per_day") <= cfg.bot_events_per_day
    end = daily.agg(
        F.sum("rows").alias("price_floor"),
        F.sum(F.when(human, F.col("rows"))).alias("bots"),
        F.count_if(~human).alias("bot_users"),
    )
    sizes = start.withColumns(
        {
            "exact_dedup": exact.agg(count.alias("c")).scalar(),
            "near_dedup": near.agg(count.alias("c")).scalar(),
            "price_floor": F.coalesce(end.select("price_floor").scalar(), F.lit(0)),
            "bots": F.coalesce(end.select("bots").scalar(), F.lit(0)),
            "bot_users": end.select("bot_users").scalar(),
        }
    )
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("step_name"),
            F.col(name).alias("rows_left"),
            (F.col(STEPS[max(i - 1, 0)]) - F.col(name)).alias("removed"),
            F.round((F.col("raw") - F.col(name)) * 100 / F.col("raw"), 4).alias("removed_pct"),
            (F.col("bot_users") if name == "bots" else F.lit(None).cast("long")).alias("bot_users"),
        )
        for i, name in enumerate(STEPS)
    ]
    return sizes.select(F.inline(F.array(*rows)))
