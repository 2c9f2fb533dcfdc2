"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. The balanced rates are those with the smallest relative entropy to
that start whose words, summed per source, equal the source's target, with no rate above the cap.
Their form is ``min(cap, exp(lambda_s * x))`` with ``x`` the document's size over its source's mean
size, and ``lambda_s`` is where the convex dual of the source has its minimum. All sources take
their Newton steps together, one aggregation over (source, size, documents) a step; a step that
leaves the bracket around the root is replaced by its middle.

Rates become copies: every document gets the whole part of its rate, and the parts left over
compete by a hash of the id until the source's target is reached. The threshold is found by
narrowing a histogram of the competing keys, so no source is ever sorted or gathered in one task,
and one last document is added where it brings the source closer to its target.

Only DataFrame functions are used. Defined cases: a null or empty text has size 0 and rate 1 unless
its source's target fixes the rate; a null source is a source of its own, last in order; rows that
repeat a doc_id share its decision; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.llm import work

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
CAP = 2
_BITS, _ROUNDS = 10, 3
_TOLERANCE, _MAX_STEPS = 1e-9, 400


def size_of(text: Column | str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(work.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``sid`` (place by source, null last, from 0), ``weight`` and ``target`` to (source, source_size).

    The targets share ``share`` of all words by weight, none above ``cap`` times its source. Giving
    the excess to the others by weight ends at one level per weight unit; each round recomputes it
    from two exact sums over the sources, until no further source is capped.
    """
    placed = scale.add_position(sources, [F.col("source").asc_nulls_last()], "sid", start=0)
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = work.store(placed.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int"))), "sources")
    wide = lambda c: c.cast("decimal(38,0)")
    limit = F.col("source_size") * cap
    capped, before = F.lit(False), -1
    level = F.lit(0.0)
    while True:
        n, taken, free, total = placed.agg(
            F.count_if(capped),
            F.sum(F.when(capped, limit).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
            F.sum("source_size"),
        ).first()
        if not total or not free:
            break
        # The level is up / down words a unit of weight, both whole numbers.
        up, down = share[0] * total - share[1] * taken, share[1] * free
        level = F.col("weight").cast("double") * float(up) / float(down)
        if n == before:
            break
        before = n
        capped = wide(F.col("weight")) * wide(F.lit(up)) >= wide(limit) * wide(F.lit(down))
    return placed.withColumn("target", F.when(capped, limit.cast("double")).otherwise(level))


def _tilt(lam: Column, x: Column, cap: int) -> Column:
    """min(cap, exp(lam * x)) without overflow."""
    return F.exp(F.least(lam * x, F.lit(math.log(cap)))) if cap != 1 else F.exp(F.least(lam * x, F.lit(0.0)))


def _multipliers(sizes: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """(sid, lam) of every source whose target lies between nothing and its cap."""
    open_ = F.col("target").between(F.lit(0.0), F.col("source_size") * float(cap)) & (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(cap))
    hist = work.store(
        sizes.where("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n"))
        .join(plan.where(open_).select("sid", "target", "mean"), "sid"),
        "histogram",
    )
    x = F.col("size") / F.col("mean")
    state = hist.groupBy("sid").agg(
        F.first("target").alias("target"), F.first("mean").alias("mean"), F.min(x).alias("least"),
        F.lit(0.0).alias("lam"),
    ).select(
        "sid", "lam", (F.lit(-745.0) / F.col("least")).alias("lo"), (F.lit(math.log(cap)) / F.col("least")).alias("hi"), F.lit(1.0).alias("gap"),
    )
    state = work.store(state, "multipliers")
    for _ in range(_MAX_STEPS):
        rate = _tilt(F.col("lam"), x, cap)
        words = F.col("n") * F.col("size") * rate
        sums = hist.join(state, "sid").groupBy("sid").agg(
            (F.sum(words) / F.max("target") - 1.0).alias("miss"),
            (F.sum(F.when(rate < cap * (1 - 1e-12), words * x).otherwise(0.0)) / F.max("target")).alias("slope"),
        )
        low, high = F.col("miss") < 0, F.col("miss") > 0
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(high, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("miss") / F.col("slope"))
        state = work.store(
            state.join(sums, "sid").select("sid", "lam", lo.alias("lo"), hi.alias("hi"), step.alias("step"), F.abs("miss").alias("gap")).select(
                "sid",
                F.when(F.col("gap") <= _TOLERANCE, F.col("lam"))
                .when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step"))
                .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
                "lo", "hi", "gap",
            ),
            "multipliers",
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= _TOLERANCE:
            return state.select("sid", "lam")
    raise RuntimeError(f"entropy balancing did not converge; largest relative gap {worst}")


def _with_rates(rows: DataFrame, cap: int) -> DataFrame:
    """Rows beside their source's plan, with whole copies, the part left over and its competing key."""
    full = F.col("target") >= F.col("source_size") * float(cap)
    rate = (
        F.when(F.col("source_size") == 0, F.lit(1.0))
        .when(F.col("target") <= 0, F.lit(0.0))
        .when(full, F.lit(float(cap)))
        .otherwise(_tilt(F.col("lam"), F.col("size") / F.col("mean"), cap))
    )
    out = rows.withColumn("rate", rate)
    out = out.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("rest", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    odds = work.fraction("doc_id", salt="mix") / F.col("rest")
    key = F.when(F.col("rest") > 0, F.floor(odds / (1 + odds) * float(1 << (_BITS * _ROUNDS))))
    return out.withColumn("key", key)


def _thresholds(rated: DataFrame) -> DataFrame:
    """(sid, cut, left): keys below ``cut`` fit in the source's target; ``left`` words stay open."""
    top = 1 << (_BITS * _ROUNDS)
    state = rated.groupBy("sid").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("left")).select(
        "sid", "left", F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("cut"),
    )
    state = work.store(state, "thresholds")
    for r in range(1, _ROUNDS + 1):
        shift = _BITS * (_ROUNDS - r)
        bins = (
            rated.where("key is not null").join(state.where("cut is null"), "sid")
            .where(F.shiftright("key", shift + _BITS) == F.col("prefix"))
            .groupBy("sid", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        )
        # At most 2^10 bins of one source meet in a task.
        so_far = Window.partitionBy("sid").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(so_far))
        fits = F.col("upto") <= F.col("left")
        found = bins.groupBy("sid").agg(
            F.min(F.when(~fits, F.col("bin"))).alias("bin"),
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"),
        )
        state = work.store(
            state.join(found, "sid", "left").select(
                "sid",
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                F.coalesce("bin", "prefix").alias("prefix"),
                # Without a bin that overflows, everything below the next prefix fits.
                F.coalesce("cut", F.when(F.col("bin").isNull(), (F.col("prefix") + 1) * (1 << (shift + _BITS)) if r > 1 else F.lit(top + 1))).cast("long").alias("cut"),
            ),
            "thresholds",
        )
    return state.select("sid", F.coalesce("cut", "prefix").alias("cut"), "left")


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sizes, one row per source with all that a document's copies depend on)."""
    sizes = work.store(docs.select("doc_id", "source", size_of("text").alias("size")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("filled"))
    aims = work.store(
        targets(sources, weights, share, cap).withColumn("mean", F.col("source_size") / F.greatest("filled", F.lit(1))).drop("filled", "weight"),
        "targets",
    )
    placed = sizes.join(aims.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "sid", "size")
    placed = work.store(placed, "placed")
    tilts = work.store(aims.join(_multipliers(placed, aims, cap), "sid", "left"), "tilts")
    rated = _with_rates(placed.join(tilts, "sid"), cap)
    cuts = _thresholds(rated)
    spare = rated.join(cuts, "sid").where(
        (F.col("whole") < cap) & (F.col("size") > 0) & (F.col("key").isNull() | (F.col("key") >= F.col("cut"))) & (F.abs(F.col("size") - F.col("left")) < F.col("left"))
    )
    closest = spare.groupBy("sid").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("gap"), "doc_id")).alias("best")).select("sid", F.col("best.doc_id").alias("filler"))
    return sizes, work.store(tilts.join(cuts.drop("left"), "sid", "left").join(closest, "sid", "left"), "plan")


def with_copies(sized: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add sid, source_size, target, rate and copies to rows with doc_id, source and size."""
    keyed = sources.withColumnRenamed("source", "_source")
    rated = _with_rates(sized.join(keyed, F.col("source").eqNullSafe(F.col("_source"))), cap)
    extra = (F.col("key") < F.col("cut")) | F.col("doc_id").eqNullSafe(F.col("filler")) & F.col("filler").isNotNull()
    return rated.withColumn("copies", (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken (words)."""
    sizes, sources = plan(docs, weights, share, cap)
    return with_copies(sizes, sources, cap).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """The documents of the mix, every row as often as its copies, columns as in ``docs``."""
    _, sources = plan(docs, weights, share, cap)
    body = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", size_of("text").alias("size"))
    repeated = with_copies(body, sources, cap).where("copies > 0")
    return repeated.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
