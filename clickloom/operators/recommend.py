"""Popularity, category and co-occurrence recommenders, exact vector top-k, item-kNN and ALS.

Every recommender returns (user_idx, rank, item_idx, score), rank from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import PAD, Config
from clickloom.functions import dot, n_rows, norm, sum_vector
from clickloom.operators import sample, tiles, vectors

# Ranks that travel together when users walk down a ranking.
RANK_BLOCK = 64


# --------------------------------------------------------------------------- rankings


def item_popularity(tp: DataFrame) -> DataFrame:
    """(item_idx, score): summed confidence over training pairs."""
    return tp.groupBy("item_idx").agg(F.sum("confidence_score").cast("double").alias("score"))


def pairs_per_user(tp: DataFrame) -> DataFrame:
    return tp.groupBy("user_idx").agg(n_rows().alias("n_seen"))


def _ranked(scores: DataFrame, key: str | None = None) -> DataFrame:
    """Full ranking (per key): position in one global sort, minus the position where the key starts."""
    order = [F.col(key)] if key else []
    placed = scale.add_position(scores, [*order, F.desc("score"), F.asc("item_idx")], "rank")
    if key is None:
        return placed
    start = placed.groupBy(key).agg((F.min("rank") - 1).alias("_start"))
    return placed.join(start, key).withColumn("rank", F.col("rank") - F.col("_start")).drop("_start")


def _unseen_top(candidates: DataFrame, tp: DataFrame, n: int, order: list[Column]) -> DataFrame:
    fresh = candidates.join(scale.by_size(tp.select("user_idx", "item_idx")), ["user_idx", "item_idx"], "left_anti")
    return scale.top_per_key(fresh, ["user_idx"], order, n).select("user_idx", "rank", "item_idx", "score")


def _walk(users: DataFrame, ranked: DataFrame, key: str | None, reach: Column, size: int = RANK_BLOCK) -> DataFrame:
    """(user_idx, item_idx, score): the first ``reach`` ranks of the ranking of each user's key.

    Rankings are cut into blocks of ``size`` ranks, and a user asks for as many blocks as its
    reach needs: n unseen items lie within n + (items seen) ranks, so the total is linear in users
    and pairs, and no list grows beyond a block. Users of a popular key are split by the adaptive
    skew join.
    """
    block = F.floor((F.col("rank") - 1) / size)
    on = ["_block"] if key is None else [key, "_block"]
    packed = F.sort_array(F.collect_list(F.struct("rank", "item_idx", "score")))
    blocks = ranked.withColumn("_block", block).groupBy(*on).agg(packed.alias("_part"))
    asked = users.withColumn("_reach", reach.cast("long")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_reach") - 1) / size)))
    )
    met = asked.join(blocks, on).select("user_idx", "_reach", F.explode("_part").alias("_rec"))
    return met.where(F.col("_rec.rank") <= F.col("_reach")).select("user_idx", "_rec.item_idx", "_rec.score")


def _with_seen(users: DataFrame, tp: DataFrame) -> DataFrame:
    return users.join(scale.by_size(pairs_per_user(tp)), "user_idx", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))


# --------------------------------------------------------------------------- popularity


def rec_popular(tp: DataFrame, users: DataFrame, n: int = 20, block: int = RANK_BLOCK) -> DataFrame:
    """Most popular items each user has not seen."""
    need = _with_seen(users.select("user_idx").distinct(), tp)
    steps = _walk(need, _ranked(item_popularity(tp)), None, F.col("n_seen") + n, block)
    return _unseen_top(steps, tp, n, [F.desc("score"), F.asc("item_idx")])


def _pad_popular(lists: DataFrame, tp: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Fill lists shorter than n with popular items neither seen nor already listed (score 0 order kept)."""
    # The lists are read three times below.
    lists = scale.cut_lineage(lists)
    size = scale.by_size(lists.groupBy("user_idx").agg(n_rows().alias("_have")))
    short = users.join(size, "user_idx", "left").where(F.coalesce("_have", F.lit(0)) < n)
    popular = rec_popular(tp, short.select("user_idx"), 2 * n)
    # n rows a user, though near items make small files.
    fresh = popular.join(scale.by_size(lists.select("user_idx", "item_idx")), ["user_idx", "item_idx"], "left_anti")
    joined = lists.withColumn("_tier", F.lit(0)).unionByName(fresh.withColumn("_tier", F.lit(1)))
    return scale.top_per_key(joined.withColumnRenamed("rank", "_old"), ["user_idx"], [F.asc("_tier"), F.asc("_old")], n).select(
        "user_idx", "rank", "item_idx", F.when(F.col("_tier") == 0, F.col("score")).otherwise(0.0).alias("score")
    )


# --------------------------------------------------------------------------- per category


def user_top_category(tp: DataFrame, items: DataFrame, category: str = "cat_l2") -> DataFrame:
    scored = tp.join(scale.by_size(items.select("item_idx", category)), "item_idx").groupBy("user_idx", category).agg(
        F.sum("confidence_score").alias("c")
    )
    return scale.top_per_key(scored, ["user_idx"], [F.desc("c"), F.asc(category)], 1).select("user_idx", category)


def rec_category(tp: DataFrame, items: DataFrame, users: DataFrame, n: int = 20, category: str = "cat_l2") -> DataFrame:
    """Unseen popular items of each user's strongest category, then global popularity."""
    # The users are read four times below, here and for the padding.
    users = scale.by_size(scale.cut_lineage(users.select("user_idx").distinct()))
    scores = item_popularity(tp).join(scale.by_size(items.select("item_idx", category)), "item_idx")
    top = users.join(user_top_category(tp, items, category), "user_idx")
    steps = _walk(_with_seen(top, tp), _ranked(scores, category), category, F.col("n_seen") + n)
    own = _unseen_top(steps, tp, n, [F.desc("score"), F.asc("item_idx")])
    return _pad_popular(own, tp, users, n)


# --------------------------------------------------------------------------- co-occurrence


def representative_item(tp: DataFrame) -> DataFrame:
    """Each user's strongest item, ties to the smallest id; a max that merges before the shuffle."""
    best = F.max(F.struct("confidence_score", (-F.col("item_idx")).alias("neg")))
    return tp.groupBy("user_idx").agg(best.alias("b")).select("user_idx", (-F.col("b.neg")).alias("rep"))


def co_counts(
    tp: DataFrame, reps: DataFrame, cap: int | None = Config.neighbour_cap, seed: int = 42, tile: int = tiles.TILE
) -> DataFrame:
    """(rep, item_idx, n): users of ``rep`` who also have the item.

    ``cap`` counts at most that many users of each rep, hash-sampled; None counts all. Users with more
    than ``tile`` items meet in tiles.
    """
    near = tp.join(reps.select(F.col("rep").alias("item_idx")).distinct(), "item_idx", "left_semi").select("item_idx", "user_idx")
    if cap is not None:
        near = sample.cap_per_key(near, "item_idx", cap, ["user_idx", "item_idx"], seed)
    return tiles.co_counts(tp.select("user_idx", "item_idx"), near, tile)


def top_neighbours(counts: DataFrame, n: int) -> DataFrame:
    return scale.top_per_key(counts, ["rep"], [F.desc("n"), F.asc("item_idx")], n)


def rec_cooccurrence(
    tp: DataFrame, users: DataFrame, n: int = 20, cap: int | None = Config.neighbour_cap, top: int | None = None
) -> DataFrame:
    """Items that share most users with the user's representative item, then global popularity.

    ``top`` leaves out neighbours beyond that rank; by default a user goes as far as it needs.
    """
    # The users are read four times below, here and for the padding.
    users = scale.by_size(scale.cut_lineage(users.select("user_idx").distinct()))
    reps = users.join(representative_item(tp), "user_idx")
    ranked = _ranked(co_counts(tp, reps, cap).select("rep", "item_idx", F.col("n").cast("double").alias("score")), "rep")
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    steps = _walk(_with_seen(reps, tp), ranked, "rep", F.col("n_seen") + n)
    own = _unseen_top(steps, tp, n, [F.desc("score"), F.asc("item_idx")])
    return _pad_popular(own, tp, users, n)


# --------------------------------------------------------------------------- vectors


topk_similar = vectors.topk


def restrict_index(items: DataFrame, tp: DataFrame) -> DataFrame:
    """Items seen in training, without the pad."""
    return items.join(tp.select("item_idx").distinct(), "item_idx", "left_semi").where(F.col("item_idx") != PAD)


def filter_seen(recs: DataFrame, tp: DataFrame, n: int = 20) -> DataFrame:
    """Remove seen items from retrieved candidates and renumber; lists may end up shorter than n."""
    fresh = recs.join(tp.select("user_idx", "item_idx"), ["user_idx", "item_idx"], "left_anti")
    return scale.top_per_key(fresh.withColumnRenamed("rank", "_old"), ["user_idx"], [F.asc("_old")], n).select(
        "user_idx", "rank", "item_idx", "score"
    )


def session_vectors(events: DataFrame, vecs: DataFrame, dim: int, max_len: int = Config.session_max_len) -> DataFrame:
    """Per session: events, known events, and the mean vector of its last known items."""
    sizes = events.groupBy("user_session").agg(n_rows().alias("session_length"))
    known = events.join(vecs.select("item_idx"), "item_idx", "left_semi")
    counts = known.groupBy("user_session").agg(n_rows().alias("known_items"))
    last = scale.top_per_key(known, ["user_session"], [F.desc("event_time"), F.desc("event_id"), F.desc("item_idx")], max_len, "_age")
    means = last.join(vecs, "item_idx").groupBy("user_session").agg(
        *[F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)]
    )
    vec = means.select("user_session", F.array(*[F.col(f"d{i}") for i in range(dim)]).alias("vec"))
    return counts.join(sizes, "user_session").join(vec, "user_session")


def recommend_sessions(events: DataFrame, vecs: DataFrame, k: int, dim: int) -> DataFrame:
    """Top-k items per session by its mean vector; sessions without a known item get none.

    Event types outside the known three count as views; the mean does not weigh by type.
    """
    sessions = scale.cut_lineage(scale.add_position(session_vectors(events, vecs, dim), [F.col("user_session")], "query_id"))
    top = topk_similar(sessions.select("query_id", "vec"), vecs, k + 10).where(F.col("rank") <= k)
    return top.join(sessions.drop("vec"), "query_id").drop("query_id")


def item_knn(tp: DataFrame, k: int = 20, tile: int = tiles.TILE) -> DataFrame:
    """k nearest items by cosine of their confidence vectors over users; users with many items meet in tiles."""
    scored = tiles.item_knn(tp, k, tile)
    return scale.top_per_key(scored, ["item_idx"], [F.desc(F.round("score", 12)), F.asc("neighbour")], k).select(
        "item_idx", "rank", "neighbour", "score"
    )


def als_fit(tp: DataFrame, rank: int = 64, reg: float = 0.01, iterations: int = 15, seed: int = 42):
    """Implicit-feedback ALS on the confidence scores."""
    from pyspark.ml.recommendation import ALS

    scale.ensure_checkpoint_dir(tp.sparkSession)
    model = ALS(
        rank=rank, regParam=reg, maxIter=iterations, implicitPrefs=True, userCol="user_idx", itemCol="item_idx",
        ratingCol="confidence_score", seed=seed, checkpointInterval=5,
    )
    typed = tp.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), F.col("confidence_score").cast("float"))
    return model.fit(typed)


def als_recommend(model, users: DataFrame, n: int = 20) -> DataFrame:
    recs = model.recommendForUserSubset(users.select(F.col("user_idx").cast("int")).distinct(), n)
    return recs.select("user_idx", F.posexplode("recommendations").alias("_at", "_rec")).select(
        F.col("user_idx").cast("long"), (F.col("_at") + 1).cast("long").alias("rank"),
        F.col("_rec.item_idx").cast("long").alias("item_idx"), F.col("_rec.rating").cast("double").alias("score"),
    )


def als_residuals(model, tp: DataFrame, reg: float = 0.01, alpha: float = 1.0) -> DataFrame:
    """(user_idx, residual, size): how far each user's factors are from solving their normal equations.

    The last half step of the fit solves, for every user u with item factors y_i and weights c_i =
    alpha x confidence, (Y'Y + sum c_i y_i y_i' + reg n_u) u = sum (1 + c_i) y_i. ``residual`` is the length
    of the difference of both sides, ``size`` that of the right side. Every pair gives one multiple of
    its item's factors; their sums combine before the shuffle.
    """
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_idx"), F.col("features").alias("y"))
    users = model.userFactors.select(F.col("id").cast("long").alias("user_idx"), F.col("features").alias("u"))
    rank = model.rank
    y = [F.get("y", F.lit(i)).cast("double") for i in range(rank)]
    gram = items.agg(F.array(*[F.sum(y[i] * y[j]) for i in range(rank) for j in range(rank)]).alias("g")).scalar()
    c = F.col("confidence_score").cast("double") * alpha
    # Pairs without confidence carry no weight and aren't counted in n_u.
    met = tp.where("confidence_score > 0").join(items, "item_idx").join(users, "user_idx").withColumn("c", c)
    pull, push = (1 + F.col("c")) - F.col("c") * dot("y", "u"), 1 + F.col("c")
    scaled = met.select("user_idx", F.transform("y", lambda v: v.cast("double") * pull).alias("open"), F.transform("y", lambda v: v.cast("double") * push).alias("right"))
    sums = scaled.groupBy("user_idx").agg(sum_vector("open").alias("open"), sum_vector("right").alias("right"), n_rows().alias("n"))
    both = sums.join(users, "user_idx").withColumn("g", gram)
    rows = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda i: F.slice("g", i * rank + 1, rank))
    left = F.transform(rows, lambda r, i: dot(r, F.col("u")) + F.get("u", i).cast("double") * reg * F.col("n"))
    gap = F.zip_with(left, "open", lambda a, b: a - b)
    return both.select("user_idx", norm(gap).alias("residual"), norm("right").alias("size"))
