"""Negative sampling by hashed addresses, and the analyses of negative pools.

``items`` has one row per item: item_idx, cat_l1, cat_l2, brand, price_bucket. No user ever gets a
candidate list of its own: a pool is a contiguous range of one global item numbering, and a draw is
a position in it, shifted past the few positions the user must not get.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import UNKNOWN, Config
from clickloom.functions import dot, n_rows, unit
from clickloom.operators.evaluate import _spread, batches


CELL = 512  # free ranks of a pool that one directory row covers


# --------------------------------------------------------------------------- uniform


def uniform_negatives(seq: DataFrame, k: int, n_items: Column | int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """k draws from [1, n_items) for every position of every sequence: array of arrays."""
    size = F.lit(n_items) if isinstance(n_items, int) else n_items
    out = seq.withColumn("_size", size)

    def one(at: Column, i: Column) -> Column:
        return 1 + F.pmod(scale.draw(seed, *keys, at, i), F.col("_size") - 1)

    slots = F.sequence(F.lit(1), F.lit(k))
    negatives = F.transform(F.sequence(F.lit(1), F.size("item_seq")), lambda at: F.transform(slots, lambda i: one(at, i)))
    return out.withColumn("negatives", negatives).drop("_size")


# --------------------------------------------------------------------------- hard negatives


def _skip(rank: Column, taken: Column) -> Column:
    """The rank-th (from 0) position that is not in the sorted array ``taken``."""
    shifted = F.transform(taken, lambda p, j: p - j.cast("long"))
    return rank + F.size(F.filter(shifted, lambda x: x <= rank)).cast("long")


def _counted_before(cells: DataFrame, key: Sequence[str], n: Column) -> DataFrame:
    """Add ``base``: the sum of ``n`` over the key's earlier cells; a scan over cells, not over rows."""
    return scale.with_running_sum(cells, key, "cell", [], n.cast("long"), "_upto").withColumn("base", F.col("_upto") - n).drop("_upto")


def own_directory(own: DataFrame, asked: DataFrame, largest: int, width: int = CELL) -> DataFrame:
    """(user_idx, pool, cell, base, marks): how many own positions stand before each free rank of a cell.

    The j-th own position p of a user and pool stands before every free rank from p - start - j on: that
    is its mark. A cell covers ``width`` ranks, so it has at most as many different marks, kept with
    their counts; ``base`` counts the marks of earlier cells. Cells that ``asked`` names (user_idx, pool,
    cell) are there even without marks. Pools of up to ``width`` items have a single cell.
    """
    key = ["user_idx", "pool"]
    at = (F.col("position") - F.col("start")).cast("long")
    blocks = own.groupBy(*key, F.floor(at / width).alias("cell")).agg(F.sort_array(F.collect_list(at)).alias("at"))
    if largest <= width:
        marks = F.transform("at", lambda p, i: F.struct((p - i).alias("mark"), F.lit(1).cast("long").alias("n")))
        return blocks.select(*key, "cell", F.lit(0).cast("long").alias("base"), marks.alias("marks"))
    blocks = _counted_before(blocks, key, F.size("at"))
    each = blocks.select(*key, "base", F.posexplode("at").alias("i", "p")).select(*key, (F.col("p") - F.col("base") - F.col("i")).alias("mark"))
    merged = each.groupBy(*key, "mark").agg(n_rows().alias("n"))
    cells = merged.groupBy(*key, F.floor(F.col("mark") / width).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("mark", "n"))).alias("marks"), F.sum("n").alias("n"))
    bare = asked.select(*key, "cell", F.array().cast("array<struct<mark: bigint, n: bigint>>").alias("marks"), F.lit(0).cast("long").alias("n"))
    cells = cells.unionByName(bare.join(cells, [*key, "cell"], "left_anti"))
    return _counted_before(cells, key, F.col("n")).select(*key, "cell", "base", "marks")


def _past_own(draws: DataFrame, own: DataFrame, largest: int, width: int = CELL) -> DataFrame:
    """Turn the free ranks (``value``) of draws into positions that skip the user's own.

    A draw meets its own cell of the directory in a join and counts marks inside it, so nothing is
    sorted or counted per user; a hot user's cells and draws spread over many keys.
    """
    placed = draws.withColumn("cell", F.floor(F.col("value") / width) if largest > width else F.lit(0).cast("long"))
    directory = own_directory(own, placed.select("user_idx", "pool", "cell").distinct(), largest, width)
    met = placed.join(directory, ["user_idx", "pool", "cell"], "left")
    before = F.aggregate(F.filter("marks", lambda m: m["mark"] <= F.col("value")), F.lit(0).cast("long"), lambda total, m: total + m["n"])
    shift = F.coalesce(F.col("base") + before, F.lit(0))
    return met.withColumn("position", F.col("start") + F.col("value") + shift).drop("cell", "base", "marks")


def _pools(items: DataFrame) -> DataFrame:
    """(pool, item_idx, position): category, price and whole-catalog pools in one numbering.

    A pool's members hold consecutive positions because the numbering sorts by pool first.
    """
    names = F.array_compact(
        F.array(
            F.when(F.col("cat_l2") != UNKNOWN, F.concat(F.lit("c:"), "cat_l2")),
            F.concat(F.lit("b:"), F.col("price_bucket").cast("string")),
            F.lit("a"),
        )
    )
    rows = items.select("item_idx", "cat_l2", "price_bucket").dropDuplicates(["item_idx"]).select("item_idx", F.explode(names).alias("pool"))
    return scale.add_position(rows, [F.col("pool"), F.col("item_idx")], "position", 0)


def hard_negatives(
    tp: DataFrame, items: DataFrame, n: int = Config.hard_negatives, warm: int = Config.warm_pairs, seed: int = 42, cell: int = CELL
) -> DataFrame:
    """(user_idx, item_idx, route, draw, negative): n hard negatives per training pair.

    Routes: 'category' (the positive's level-2 category without the user's positives), 'anti' (warm
    users: one item from each of n categories the user never touched), 'warm_category' (warm user with
    too few such items), 'bucket' (unknown category: same price level), 'any' (nothing left).
    Draws are with replacement only where fewer than n items are free, and across 'anti' categories.
    """
    pools = _pools(items)
    spans = pools.groupBy("pool").agg(F.min("position").alias("start"), n_rows().alias("size"))
    cats = scale.add_position(spans.where(F.col("pool").startswith("c:")), [F.col("pool")], "cat_at", 0)
    placed = items.select(
        "item_idx",
        F.when(F.col("cat_l2") != UNKNOWN, F.concat(F.lit("c:"), "cat_l2")).alias("cat_pool"),
        F.concat(F.lit("b:"), F.col("price_bucket").cast("string")).alias("bucket_pool"),
    )
    pairs = tp.select("user_idx", "item_idx").join(placed, "item_idx")

    # Per user: number of pairs and the touched categories (at most one entry per category).
    touched = pairs.select("user_idx", "cat_pool").where(F.col("cat_pool").isNotNull()).distinct()
    touched = scale.salted_join(touched, cats.select(F.col("pool").alias("cat_pool"), "cat_at", F.col("size").alias("cat_size")), ["cat_pool"], "inner")
    touched = touched.groupBy("user_idx").agg(F.sort_array(F.collect_list("cat_at")).alias("touched"), F.sum("cat_size").alias("touched_items"))
    people = pairs.groupBy("user_idx").agg(n_rows().alias("n_pairs")).join(touched, "user_idx", "left")
    whole = cats.agg(F.struct(n_rows().alias("n"), F.sum("size").alias("items")).alias("w")).scalar()
    people = people.withColumn("_w", whole).select(
        "user_idx", (F.col("n_pairs") >= warm).alias("is_warm"),
        F.coalesce("touched", F.array().cast("array<long>")).alias("touched"),
        (F.col("_w.n") - F.coalesce(F.size("touched"), F.lit(0))).alias("anti_cats"),
        (F.col("_w.items") - F.coalesce("touched_items", F.lit(0))).alias("anti_items"),
    )
    known = F.col("cat_pool").isNotNull()
    anti = known & F.col("is_warm") & (F.col("anti_cats") > 0) & (F.col("anti_items") >= n)
    routed = pairs.join(people, "user_idx").withColumn(
        "route",
        F.when(anti, "anti").when(known & F.col("is_warm"), "warm_category").when(known, "category").otherwise("bucket"),
    )

    # Warm users: draw categories by rank among the untouched, then an item inside each.
    by_cat = routed.where(F.col("route") == "anti").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cat_rank = F.pmod(scale.draw(seed, "user_idx", "item_idx", "draw", F.lit("cat")), F.col("anti_cats"))
    by_cat = by_cat.withColumn("cat_at", _skip(cat_rank, F.col("touched"))).select("user_idx", "item_idx", "route", "draw", "cat_at")
    by_cat = scale.salted_join(by_cat, cats.select("cat_at", "start", "size"), ["cat_at"], "inner")
    inside = F.pmod(scale.draw(seed, "user_idx", "item_idx", "draw", F.lit("item")), F.col("size"))
    by_cat = by_cat.withColumn("position", F.col("start") + inside)

    # Everyone else: draw free ranks inside one pool, then move past the user's own positives in it.
    own = tp.select("user_idx", "item_idx").join(pools.where(F.col("pool") != "a"), "item_idx").select("user_idx", "pool", "position")
    n_own = own.groupBy("user_idx", "pool").agg(n_rows().alias("n_own"))
    rest = routed.where(F.col("route") != "anti").withColumn("pool", F.coalesce("cat_pool", "bucket_pool"))
    rest = rest.select("user_idx", "item_idx", "route", "pool").join(spans, "pool").join(n_own, ["user_idx", "pool"], "left")
    catalog = spans.where(F.col("pool") == "a").select(F.struct("start", "size").alias("s")).scalar()
    me = pools.where(F.col("pool") == "a").select("item_idx", F.col("position").alias("me"))
    taken = F.coalesce("n_own", F.lit(0))
    empty = F.col("size") - taken <= 0
    rest = rest.join(me, "item_idx").withColumn("_a", catalog).select(
        "user_idx", "item_idx", F.when(empty, "any").otherwise(F.col("route")).alias("route"),
        F.when(empty, "a").otherwise(F.col("pool")).alias("pool"),
        F.when(empty, F.col("_a.start")).otherwise(F.col("start")).alias("start"),
        F.when(empty, F.col("_a.size") - 1).otherwise(F.col("size") - taken).alias("free"),
        (F.col("me") - F.col("_a.start")).alias("me"),
    )
    ranks: list[str] = []
    for i in range(n):
        # Sampling without replacement: the i-th draw comes from the first free-n+i+1 ranks, and a
        # rank drawn before is exchanged for the newest one.
        newest = F.col("free") - n + i
        hit = F.pmod(scale.draw(seed, "user_idx", "item_idx", F.lit(i)), F.greatest(newest + 1, F.lit(1)))
        if ranks:
            hit = F.when(F.array_contains(F.array(*ranks), hit), newest).otherwise(hit)
        again = F.pmod(scale.draw(seed, "user_idx", "item_idx", F.lit(i)), F.greatest(F.col("free"), F.lit(1)))
        rest = rest.withColumn(f"_r{i}", F.when(F.col("free") < n, again).otherwise(hit))
        ranks.append(f"_r{i}")
    rest = rest.select("user_idx", "item_idx", "route", "pool", "start", "me", F.posexplode(F.array(*ranks)).alias("draw", "value"))
    # In the whole catalog only the positive itself is passed over.
    anywhere = rest.where(F.col("route") == "any").withColumn(
        "position", F.col("start") + F.col("value") + F.when(F.col("me") <= F.col("value"), 1).otherwise(0)
    )
    largest = spans.where(F.col("pool") != "a").agg(F.max("size")).first()[0] or 0
    inside_pool = _past_own(rest.where(F.col("route") != "any").drop("me"), own.join(spans.select("pool", "start"), "pool"), largest, cell)

    columns = ["user_idx", "item_idx", "route", "draw", "position"]
    drawn = by_cat.select(*columns).unionByName(anywhere.select(*columns)).unionByName(inside_pool.select(*columns))
    # Positions are unique, and the draws spread over them.
    found = drawn.join(pools.select("position", F.col("item_idx").alias("negative")), "position")
    return found.select("user_idx", "item_idx", "route", "draw", "negative")


def hard_negative_routes(tp: DataFrame, items: DataFrame, n: int = Config.hard_negatives, warm: int = Config.warm_pairs) -> DataFrame:
    """Pairs per mining route, warm and cold users, and the share of pairs without a category pool.

    Pairs count for the route they start on; ``any_pairs`` are those among them that find their pool
    used up by the user and end in the whole catalog.
    """
    known_items = items.select("item_idx", (F.col("cat_l2") != UNKNOWN).alias("known"), "cat_l2", "price_bucket")
    pairs = tp.select("user_idx", "item_idx").join(known_items, "item_idx")
    sizes = items.where(F.col("cat_l2") != UNKNOWN).groupBy("cat_l2").agg(n_rows().alias("size"))
    touched = scale.salted_join(pairs.where("known").select("user_idx", "cat_l2").distinct(), sizes, ["cat_l2"], "inner")
    touched = touched.groupBy("user_idx").agg(n_rows().alias("m"), F.sum("size").alias("touched"))
    whole = sizes.agg(F.struct(n_rows().alias("n"), F.sum("size").alias("items")).alias("w")).scalar()
    people = pairs.groupBy("user_idx").agg(n_rows().alias("n_pairs"), F.count_if("known").alias("n_known"))
    # Pools that hold nothing but the user's own items send their pairs to the whole catalog.
    in_cat = pairs.where("known").groupBy("user_idx", "cat_l2").agg(n_rows().alias("own"))
    used_cat = scale.salted_join(in_cat, sizes, ["cat_l2"], "inner").where("own >= size").groupBy("user_idx").agg(F.sum("own").alias("used_known"))
    levels = items.groupBy("price_bucket").agg(n_rows().alias("size"))
    in_level = pairs.groupBy("user_idx", "price_bucket").agg(n_rows().alias("own"), F.count_if(~F.col("known")).alias("unknown"))
    used_level = scale.salted_join(in_level, levels, ["price_bucket"], "inner").where("own >= size").groupBy("user_idx").agg(F.sum("unknown").alias("used_unknown"))
    people = people.join(touched, "user_idx", "left").join(used_cat, "user_idx", "left").join(used_level, "user_idx", "left").withColumn("_w", whole)
    is_warm = F.col("n_pairs") >= warm
    has_anti = (F.col("_w.n") > F.coalesce("m", F.lit(0))) & (F.col("_w.items") - F.coalesce("touched", F.lit(0)) >= n)

    def total(value: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))

    out = people.agg(
        F.sum("n_pairs").alias("pairs"), total("n_known", F.lit(True)).alias("known_pairs"),
        total("n_known", is_warm & has_anti).alias("anti_pairs"), total("n_known", is_warm & ~has_anti).alias("warm_fallback_pairs"),
        total("n_known", ~is_warm).alias("cold_pairs"), (total("used_known", ~(is_warm & has_anti)) + total("used_unknown", F.lit(True))).alias("any_pairs"), F.count_if(is_warm).alias("warm_users"), F.count_if(~is_warm).alias("cold_users"),
    )
    return out.withColumn("bucket_pairs", F.col("pairs") - F.col("known_pairs")).withColumn(
        "bucket_pct", F.round(F.col("bucket_pairs") * 100 / F.col("pairs"), 4)
    )


# --------------------------------------------------------------------------- pool sizes


def pool_sizes(tp: DataFrame, items: DataFrame, safe: int = 50) -> DataFrame:
    """Same-category candidates per positive pair at both levels, with the verdict on level 2.

    Pairs merge to one row per item, items to one row per pool size, before any percentile.
    """
    per_item = tp.groupBy("item_idx").agg(n_rows().alias("n"))
    out = None
    for level in ("cat_l1", "cat_l2"):
        sizes = items.groupBy(level).agg((n_rows() - 1).alias("v"))
        pooled = per_item.join(items.select("item_idx", level), "item_idx").groupBy(level).agg(F.sum("n").alias("n")).join(sizes, level)
        v, n = F.col("v"), F.col("n")
        row = pooled.agg(
            F.sum(n).alias("pairs"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.sum(v * n) / F.sum(n), 6).alias("mean"),
            F.round(scale.percentile_of_counts(0.5), 6).alias("median"), F.round(scale.percentile_of_counts(0.1), 6).alias("p10"),
        ).select(F.lit(level).alias("level"), "*", F.when(F.col("p10") >= safe, "OK").otherwise("CAUTION").alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out


def _session_items(ev: DataFrame) -> DataFrame:
    """(session, product): was it viewed, was it carted or bought. One row per pair, merged map-side."""
    kind = F.col("event_type")
    return ev.where(F.col("user_session").isNotNull()).groupBy("user_session", "product_id").agg(
        F.max((kind == "view").cast("int")).alias("viewed"), F.max(kind.isin("cart", "purchase").cast("int")).alias("positive")
    )


def session_negatives(ev: DataFrame) -> DataFrame:
    """(session, product) viewed but not carted or bought, in sessions that have both kinds."""
    flags = _session_items(ev)
    both = flags.groupBy("user_session").agg(F.max("viewed").alias("v"), F.max("positive").alias("p")).where("v = 1 AND p = 1")
    return flags.where("viewed = 1 AND positive = 0").join(both.select("user_session"), "user_session", "left_semi").select("user_session", "product_id")


def session_negative_report(ev: DataFrame) -> DataFrame:
    """Qualifying and usable sessions and the distribution of view-only pool sizes."""
    per_session = _session_items(ev).groupBy("user_session").agg(
        F.sum("viewed").alias("v"), F.sum("positive").alias("p"), F.count_if((F.col("viewed") == 1) & (F.col("positive") == 0)).alias("neg")
    )
    q = (F.col("v") > 0) & (F.col("p") > 0)
    pool = F.when(q & (F.col("neg") > 0), F.col("neg"))
    rows = per_session.select(q.cast("int").alias("q"), pool.alias("v")).groupBy("q", "v").agg(n_rows().alias("n"))
    v, n = F.col("v"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    out = rows.agg(
        F.sum(n).alias("sessions"), total(F.col("q") == 1).alias("qualifying"), total(v.isNotNull()).alias("usable"), total(v >= 3).alias("with_3_up"),
        F.round(F.sum(v * n) / total(v.isNotNull()), 6).alias("mean"),
        *[F.round(F.percentile(v, F.lit(p), n), 6).alias(scale.percentile_name(p)) for p in (0.1, 0.25, 0.5, 0.75, 0.9)],
    )
    share = F.col("with_3_up") * 100 / F.col("qualifying")
    return out.withColumn("pct_3_up", F.round(share, 4)).withColumn(
        "verdict", F.when(share >= 50, "OK").when(share >= 20, "PARTIAL").otherwise("CAUTION")
    )


def session_negative_overlap(ev: DataFrame, items: DataFrame) -> DataFrame:
    """Category relation of every (positive, session negative) pair, from counts per category.

    Same-category pairs of a session are the product of two counts, so no pair is ever built.
    """
    flags = _session_items(ev).join(items.select("product_id", "cat_l1", "cat_l2", F.lit(1).alias("listed")), "product_id", "left")
    pos, neg = F.col("positive") == 1, (F.col("viewed") == 1) & (F.col("positive") == 0)
    listed = F.col("listed").isNotNull()
    l2 = flags.groupBy("user_session", "cat_l1", "cat_l2", "listed").agg(F.count_if(pos).alias("p"), F.count_if(neg).alias("g"), F.sum("viewed").alias("viewed"))
    l1 = l2.groupBy("user_session", "cat_l1", "listed").agg(
        F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum("viewed").alias("viewed"), F.sum(F.col("p") * F.col("g")).alias("same2")
    )
    per_session = l1.groupBy("user_session").agg(
        F.sum("p").alias("all_p"), F.sum("g").alias("all_g"), F.sum("viewed").alias("viewed"),
        F.coalesce(F.sum(F.when(listed, F.col("p"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(listed, F.col("g"))), F.lit(0)).alias("g"),
        F.coalesce(F.sum(F.when(listed, F.col("same2"))), F.lit(0)).alias("same2"),
        F.coalesce(F.sum(F.when(listed, F.col("p") * F.col("g"))), F.lit(0)).alias("same1"),
    ).where((F.col("all_p") > 0) & (F.col("viewed") > 0) & (F.col("all_g") > 0))
    total = F.col("p") * F.col("g")
    out = per_session.agg(
        n_rows().alias("sessions"), F.sum(total).alias("pairs"), F.sum("same2").alias("same_l2"),
        F.sum(F.col("same1") - F.col("same2")).alias("same_l1_only"), F.sum(total - F.col("same1")).alias("different_l1"),
        F.sum(F.col("p") * (F.col("all_g") - F.col("g"))).alias("uncatalogued"), F.count_if(total > F.col("same2")).alias("sessions_any_different"),
    )
    return out.withColumn("same_l2_pct", F.round(F.try_divide(F.col("same_l2") * 100, F.col("pairs")), 4)).withColumn(
        "any_different_pct", F.round(F.col("sessions_any_different") * 100 / F.col("sessions"), 4)
    )


# --------------------------------------------------------------------------- false negatives


def user_risk(tp: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: size of the same-category pools of all positives, and how much of it shares a brand.

    Positives first merge to (user, category) counts; brand counts meet them per category.
    """
    detail = items.select("item_idx", "cat_l2", "brand")
    pairs = tp.select("user_idx", "item_idx").join(detail, "item_idx")
    named = F.col("brand") != UNKNOWN
    by_cat = pairs.groupBy("user_idx", "cat_l2").agg(n_rows().alias("n"), F.count_if(named).alias("n_named"))
    brand_counts = detail.where(named).groupBy("cat_l2", "brand").agg(n_rows().alias("c"))
    user_brands = pairs.where(named).select("user_idx", "brand").distinct()
    shared = (
        scale.salted_join(by_cat.select("user_idx", "cat_l2"), brand_counts, ["cat_l2"], "inner")
        .join(user_brands, ["user_idx", "brand"], "left_semi").groupBy("user_idx", "cat_l2").agg(F.sum("c").alias("same_brand"))
    )
    sizes = detail.groupBy("cat_l2").agg((n_rows() - 1).alias("pool"))
    rows = scale.salted_join(by_cat, sizes, ["cat_l2"], "inner").where(F.col("pool") > 0).join(shared, ["user_idx", "cat_l2"], "left")
    s = F.coalesce("same_brand", F.lit(0))
    # A branded positive is itself among its category's same-brand items; an unbranded one is not.
    high = F.col("n_named") * F.least(s - 1, F.col("pool")) + (F.col("n") - F.col("n_named")) * F.least(s, F.col("pool"))
    return rows.groupBy("user_idx").agg(F.sum(F.col("n") * F.col("pool")).alias("candidates"), F.sum(high).alias("high_risk")).withColumn(
        "risk_pct", F.col("high_risk") * 100 / F.col("candidates")
    )


def false_negative_risk(tp: DataFrame, items: DataFrame) -> DataFrame:
    users = scale.cut_lineage(user_risk(tp, items).withColumn("risk_pct", F.round("risk_pct", 9)))
    row = users.agg(
        n_rows().alias("n_users"), F.sum("candidates").alias("candidates"), F.sum("high_risk").alias("high_risk"),
        F.round(F.sum("high_risk") * 100 / F.sum("candidates"), 6).alias("overall_pct"), F.round(F.avg("risk_pct"), 6).alias("mean"),
        F.round(F.count_if(F.col("risk_pct") > 20) * 100 / n_rows(), 4).alias("pct_users_above_20"),
        F.round(F.count_if(F.col("risk_pct") < 5) * 100 / n_rows(), 4).alias("pct_users_below_5"),
    )
    points = scale.percentiles(users, "risk_pct", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])
    return scale.beside(row, points.select(*[F.round(c, 6).alias(c) for c in points.columns]))


def popularity_risk(tp: DataFrame, items: DataFrame, k: int = 1000) -> DataFrame:
    """Distribution over users of the share of top-k items inside categories they touched."""
    freq = tp.groupBy("item_idx").agg(n_rows().alias("freq"))
    top = freq.orderBy(F.desc("freq"), "item_idx").limit(k).join(items.select("item_idx", "cat_l2"), "item_idx", "left")
    top_counts = top.groupBy("cat_l2").agg(n_rows().alias("c"))
    size = top_counts.agg(F.sum("c").alias("s")).scalar()
    touched = tp.join(items.select("item_idx", "cat_l2"), "item_idx").select("user_idx", "cat_l2").distinct()
    shares = scale.salted_join(touched, top_counts, ["cat_l2"], "left").groupBy("user_idx").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("hits"))
    v, n = F.col("v"), F.col("n")
    return scale.value_counts(shares, "hits").withColumn("v", v * 100 / size).agg(
        F.sum(n).alias("n_users"), F.round(F.sum(v * n) / F.sum(n), 6).alias("mean"),
        *[F.round(scale.percentile_of_counts(p), 6).alias(scale.percentile_name(p)) for p in (0.1, 0.25, 0.5, 0.75, 0.9)],
    )


# --------------------------------------------------------------------------- popularity


def item_frequency(tp: DataFrame) -> DataFrame:
    return tp.groupBy("item_idx").agg(n_rows().alias("freq"))


def popularity_profile(tp: DataFrame, items: DataFrame, k: int = 1000, rare: int = 10) -> DataFrame:
    """Training-frequency distribution, rare and never-trained items, and the share of the top k."""
    freq = item_frequency(tp)
    v, n = F.col("v"), F.col("n")
    row = scale.value_counts(freq, "freq").agg(
        F.sum(n).alias("trained_items"), F.sum(v * n).alias("pairs"), F.max(v).alias("max"),
        *[F.round(scale.percentile_of_counts(p), 6).alias(scale.percentile_name(p)) for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)],
        F.coalesce(F.sum(F.when(v < rare, n)), F.lit(0)).alias("rare_items"), F.coalesce(F.sum(F.when(v == 1, n)), F.lit(0)).alias("once_items"),
    )
    listed = items.agg(F.count_distinct("item_idx").alias("catalog_items"))
    top = freq.orderBy(F.desc("freq"), "item_idx").limit(k).agg(F.sum("freq").alias("top_pairs"))
    out = scale.beside(scale.beside(row, listed), top)
    return out.withColumn("never_trained", F.col("catalog_items") - F.col("trained_items")).withColumn(
        "top_pct", F.round(F.col("top_pairs") * 100 / F.col("pairs"), 4)
    )


def top_items(tp: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent items with their cumulative share of all pairs."""
    total = tp.agg(n_rows().alias("t")).scalar()
    top = item_frequency(tp).orderBy(F.desc("freq"), "item_idx").limit(n)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("neg"), "item_idx")))
    rows = top.agg(packed.alias("l")).select("l", F.posexplode("l").alias("_at", "r"))
    upto = F.aggregate(F.slice("l", F.lit(1), F.col("_at") + 1), F.lit(0).cast("long"), lambda s, x: s - x["neg"])
    return rows.select(
        (F.col("_at") + 1).alias("pop_rank"), F.col("r.item_idx").alias("item_idx"), (-F.col("r.neg")).alias("freq"), F.round(upto * 100 / total, 4).alias("cum_pct")
    )


def batch_popularity(tp: DataFrame, size: int = 2048, n: int = 10, k: int = 1000, rare: int = 10, seed: int = 42) -> DataFrame:
    """Per random batch: share of top-k and of rare items, mean and median popularity rank."""
    ranked = scale.add_position(item_frequency(tp), [F.desc("freq"), F.asc("item_idx")], "pop_rank")
    rows = batches(tp, size, n, seed).join(ranked, "item_idx", "left")
    trained = ranked.agg(n_rows().alias("c")).scalar()
    rank = F.coalesce("pop_rank", F.col("_t") + 1)
    # A batch has ``size`` rows, so its median stays small.
    return rows.withColumn("_t", trained).groupBy("batch").agg(
        n_rows().alias("pairs"), F.round(F.count_if(F.col("pop_rank") <= k) * 100 / n_rows(), 4).alias("top_pct"),
        F.round(F.count_if(F.coalesce("freq", F.lit(0)) < rare) * 100 / n_rows(), 4).alias("rare_pct"),
        F.round(F.avg(rank), 6).alias("mean_rank"), F.round(F.median(rank), 6).alias("median_rank"),
    )


def batch_same_category(tp: DataFrame, items: DataFrame, size: int = 2048, n: int = 10, seed: int = 42) -> DataFrame:
    """Per random batch: share of ordered pairs of rows in the same category, from squared counts."""
    rows = batches(tp, size, n, seed).join(items.select("item_idx", "cat_l1", "cat_l2"), "item_idx")
    out = rows.groupBy("batch").agg(n_rows().alias("pairs"))
    for level in ("cat_l1", "cat_l2"):
        counts = rows.groupBy("batch", level).agg(n_rows().alias("c"))
        same = counts.groupBy("batch").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("b"))
        out = out.join(same.select("batch", F.round(F.try_divide(F.col("same") * 100, F.col("b") * (F.col("b") - 1)), 6).alias(f"same_{level}_pct")), "batch")
    return out


def collision_probability(items: DataFrame) -> DataFrame:
    """Chance in percent that two uniformly drawn items share a category, at both levels."""
    out = None
    for level in ("cat_l1", "cat_l2"):
        counts = items.groupBy(level).agg(n_rows().alias("c"))
        c = F.col("c").cast("double")
        one = counts.agg(F.round(F.sum(c * c) / (F.sum(c) * F.sum(c)) * 100, 6).alias("collision_pct")).select(F.lit(level).alias("level"), "collision_pct")
        out = one if out is None else out.unionByName(one)
    return out


# --------------------------------------------------------------------------- similarity


def intra_category_scores(
    tp: DataFrame, items: DataFrame, ivec: DataFrame, uvec: DataFrame, n_pairs: int = 500, n_same: int = 5, n_diff: int = 5, seed: int = 42
) -> DataFrame:
    """(user_idx, item_idx) sample with mean cosines: item to same and other category, user to positive, same, other.

    Items sorted by category hold a contiguous range per category: a same-category draw is a position in
    the range past the item itself, an other-category draw a position outside it. Pairs whose category
    has too few other items are left out.
    """
    listed = items.select("item_idx", "cat_l2").join(ivec.select("item_idx"), "item_idx", "left_semi")
    placed = scale.add_position(listed, [F.col("cat_l2"), F.col("item_idx")], "position", 0)
    spans = placed.groupBy("cat_l2").agg(F.min("position").alias("start"), n_rows().alias("size"))
    total = spans.agg(F.sum("size").alias("t")).scalar()
    picked = tp.select("user_idx", "item_idx").orderBy(scale.draw(seed, "user_idx", "item_idx"), "user_idx", "item_idx").limit(n_pairs)
    rows = picked.join(placed, "item_idx").join(spans, "cat_l2").withColumn("_t", total)
    rows = rows.where((F.col("size") - 1 >= n_same) & (F.col("_t") - F.col("size") >= n_diff))
    slots = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i")) for kind, m in (("same", n_same), ("diff", n_diff)) for i in range(m)]
    rows = rows.withColumn("slot", F.explode(F.array(*slots)))
    at = F.col("slot.i")
    # Equal strides from a hashed start give different positions.
    same_free, diff_free = F.col("size") - 1, F.col("_t") - F.col("size")
    h = scale.draw(seed, "user_idx", "item_idx", F.col("slot.kind"))
    same = F.pmod(h + at * F.floor(same_free / n_same), same_free)
    same = F.col("start") + same
    same = F.when(same >= F.col("position"), same + 1).otherwise(same)
    diff = F.pmod(h + at * F.floor(diff_free / n_diff), diff_free)
    diff = F.when(diff >= F.col("start"), diff + F.col("size")).otherwise(diff)
    rows = rows.select("user_idx", "item_idx", F.col("slot.kind").alias("kind"), F.when(F.col("slot.kind") == "same", same).otherwise(diff).cast("long").alias("position"))
    rows = rows.join(placed.select("position", F.col("item_idx").alias("other")), "position")
    vi = ivec.select("item_idx", unit("vec").alias("vi"))
    scored = rows.join(vi, "item_idx").join(vi.toDF("other", "vo"), "other").join(uvec.select("user_idx", unit("vec").alias("vu")), "user_idx")
    scored = scored.select("user_idx", "item_idx", "kind", dot("vi", "vo").alias("io"), dot("vu", "vo").alias("uo"), dot("vu", "vi").alias("ui"))

    def mean(kind: str, c: str, name: str) -> Column:
        return F.round(F.avg(F.when(F.col("kind") == kind, F.col(c))), 9).alias(name)

    return scored.groupBy("user_idx", "item_idx").agg(
        mean("same", "io", "item_same"), mean("diff", "io", "item_diff"), F.round(F.max("ui"), 9).alias("user_pos"),
        mean("same", "uo", "user_same"), mean("diff", "uo", "user_diff"),
    )


def intra_category_report(scores: DataFrame) -> DataFrame:
    """Spread of each similarity column and the two gaps."""
    scores = scale.cut_lineage(scores)
    names = ("item_same", "item_diff", "user_pos", "user_same", "user_diff")
    out = scores.agg(n_rows().alias("pairs"))
    for name in names:
        out = scale.beside(out, _spread(scores, name, f"{name}_"))
    return out.withColumns(
        {"item_gap": F.col("item_same_mean") - F.col("item_diff_mean"), "user_gap": F.col("user_same_mean") - F.col("user_diff_mean")}
    )
