"""Item and user features, vocabularies, scaling, encoding, and the checks on the encoded tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import UNKNOWN
from clickloom.functions import count_type, event_code, is_type, known, month_of, n_rows, part_of, price_level


# Fixed value: items are aged against the first day of the test month.
RECENCY_CUTOFF = datetime(2020, 2, 1)


# --------------------------------------------------------------------------- feature tables


def item_features(ev: DataFrame, im: DataFrame) -> DataFrame:
    """One row per item: categories, brand, price level and price, confidence and purchase rate."""
    code = known(F.max("category_code"))
    base = ev.groupBy("product_id").agg(code.alias("code"), known(F.max("brand")).alias("brand"),
                                        F.avg("price").alias("price"))
    stats = im.groupBy("product_id").agg(
        F.sum("confidence_score").alias("c"), F.try_divide(F.sum("n_purchases"), F.sum("n_views")).alias("r")
    )
    # Both sides are one row per item, so the join comes after the aggregation, not before it.
    return base.join(stats, "product_id", "left").select(
        "product_id",
        part_of("code", 0).alias("cat_l1"),
        known(part_of("code", 1)).alias("cat_l2"),
        "brand",
        price_level("price").alias("price_bucket"),
        F.round("price", 4).alias("avg_price"),
        F.coalesce("c", F.lit(0).cast("long")).alias("item_total_confidence"),
        F.coalesce("r", F.lit(0.0)).alias("item_purchase_rate"),
    )


def user_category_counts(train: DataFrame, itemf: DataFrame) -> DataFrame:
    """(user, cat_l1, events). Events merge to one row per (user, item) before meeting the items."""
    counts = train.groupBy("user_id", "product_id").agg(n_rows().alias("n"))
    return counts.join(itemf.select("product_id", "cat_l1"), "product_id").groupBy("user_id", "cat_l1").agg(
        F.sum("n").alias("n_events")
    )


def top_category(train: DataFrame, itemf: DataFrame) -> DataFrame:
    """Most frequent level-1 category per user, ties to the first name."""
    ranked = scale.top_per_key(user_category_counts(train, itemf), ["user_id"], [F.desc("n_events"), F.asc("cat_l1")], 1)
    return ranked.select("user_id", F.col("cat_l1").alias("top_category"), "n_events")


def user_prices(train: DataFrame, itemf: DataFrame) -> DataFrame:
    """Mean item price over a user's purchases and over all events."""
    counts = train.groupBy("user_id", "product_id").agg(n_rows().alias("n"), count_type("purchase").alias("b"))
    priced = counts.join(itemf.select("product_id", "avg_price"), "product_id")
    price = F.col("avg_price")
    return priced.groupBy("user_id").agg(
        F.try_divide(F.sum(F.when(F.col("b") > 0, price * F.col("b"))), F.sum("b")).alias("bought"),
        F.try_divide(F.sum(price * F.col("n")), F.sum(F.when(price.isNotNull(), F.col("n")))).alias("viewed"),
        (F.sum("b") > 0).cast("int").alias("has_purchase"),
    )


def user_features(train: DataFrame, itemf: DataFrame) -> DataFrame:
    base = train.groupBy("user_id").agg(
        n_rows().alias("total_events"),
        F.count_distinct(month_of("event_time")).alias("months_active"),
        F.round(count_type("purchase") / n_rows(), 4).alias("purchase_rate"),
        F.round(count_type("cart") / n_rows(), 4).alias("cart_rate"),
        F.count_distinct("user_session").alias("n_sessions"),
        F.floor(F.avg(F.hour("event_time")) / 6).cast("long").alias("peak_hour_bucket"),
        F.round(F.avg(F.dayofweek("event_time"))).cast("long").alias("preferred_dow"),
    )
    cats = top_category(train, itemf).select("user_id", "top_category")
    out = base.join(cats, "user_id", "left").join(user_prices(train, itemf), "user_id", "left")
    return out.select(
        *base.columns,
        known("top_category").alias("top_category"),
        F.coalesce("bought", "viewed").alias("avg_purchase_price"),
        F.col("has_purchase").alias("has_purchase_history"),
    )


# --------------------------------------------------------------------------- vocabularies


def id_vocab(df: DataFrame, column: str, start: int = 0, name: str = "idx") -> DataFrame:
    """(id, idx): sorted distinct ids numbered from ``start``."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    return scale.add_position(ids, [F.col(column)], name, start)


def first_seen_vocab(df: DataFrame, column: str, order: Sequence[str] = ("event_time", "event_id"), start: int = 0, name: str = "idx") -> DataFrame:
    """(id, idx): distinct ids numbered from ``start`` in the order in which they first appear."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return scale.add_position(first, [F.col("_first"), F.col(column)], name, start).drop("_first")


def str_vocabs(df: DataFrame, columns: Sequence[str], name: str = "idx") -> dict[str, DataFrame]:
    """(text, idx) per column: 'unknown' is 0, the others are numbered from 1 in sorted order.

    All columns share one pass and one sort: values are numbered by (column, text) together, and each
    column subtracts where its range starts.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in columns])))
    others = pairs.where(F.col("_v").isNotNull() & (F.col("_v") != UNKNOWN)).distinct()
    placed = scale.add_position(others, [F.col("_c"), F.col("_v")], "_at", 0)
    zero = df.sparkSession.createDataFrame([(UNKNOWN, 0)], f"_v string, {name} long")
    out = {}
    for c in columns:
        mine = placed.where(F.col("_c") == c)
        start = mine.agg(F.min("_at").alias("s")).scalar()
        out[c] = mine.select("_v", (F.col("_at") - start + 1).alias(name)).unionByName(zero).withColumnRenamed("_v", c)
    return out


def str_vocab(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    return str_vocabs(df, [column], name)[column]


def encode_column(df: DataFrame, vocab: DataFrame, column: str, name: str, missing: int | None = None) -> DataFrame:
    """Look ids up in a vocabulary; misses become null or ``missing``."""
    key, idx = vocab.columns
    out = df.join(vocab.select(F.col(key).alias(column), F.col(idx).alias(name)), column, "left")
    return out if missing is None else out.withColumn(name, F.coalesce(name, F.lit(missing).cast("long")))


def drop_oov(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Events with user_idx, item_idx and event_idx; rows missing any of them or the session go."""
    coded = df.withColumn("event_idx", event_code("event_type")).where(
        F.col("event_idx").isNotNull() & F.col("user_session").isNotNull()
    )
    u, i = users.toDF("user_id", "user_idx"), items.toDF("product_id", "item_idx")
    return coded.join(u, "user_id").join(i, "product_id")


def oov_report(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    kept = drop_oov(df, users, items).agg(n_rows().alias("c")).scalar()
    return df.agg(n_rows().alias("total_rows")).withColumn("kept_rows", kept).withColumn(
        "dropped_rows", F.col("total_rows") - F.col("kept_rows")
    )


# --------------------------------------------------------------------------- scaling and encoding


def standard_scale(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add z-scores by population mean and deviation; a constant column divides by 1."""
    stats = df.agg(
        *[F.avg(e).alias(f"m_{n}") for n, e in exprs.items()], *[F.stddev_pop(e).alias(f"s_{n}") for n, e in exprs.items()]
    )
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = df.withColumn("_stats", packed)

    def z(n: str, e: Column) -> Column:
        dev = F.col("_stats")[f"s_{n}"]
        return (e - F.col("_stats")[f"m_{n}"]) / F.when(dev > 0, dev).otherwise(F.lit(1.0))

    return out.withColumns({n: z(n, e) for n, e in exprs.items()}).drop("_stats")


ITEM_ENCODED = ("product_id", "item_idx", "cat_l1_idx", "cat_l2_idx", "brand_idx", "price_bucket",
                "avg_price_scaled", "log_confidence_scaled", "purchase_rate_scaled")
USER_ENCODED = ("user_id", "user_idx", "top_cat_idx", "peak_hour_bucket", "preferred_dow", "has_purchase_history",
                "log_total_events", "months_active", "purchase_rate", "cart_rate", "log_n_sessions",
                "avg_purchase_price_scaled")


def vocabularies(im: DataFrame, itemf: DataFrame, userf: DataFrame) -> dict[str, DataFrame]:
    """The six dimension tables. Item numbers start at 1 because 0 pads sequences."""
    return {
        "user": id_vocab(im, "user_id"),
        "item": id_vocab(itemf, "product_id", start=1),
        **str_vocabs(itemf, ("cat_l1", "cat_l2", "brand")),
        "top_cat": str_vocab(userf, "top_category"),
    }


def encode_items(itemf: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    out = encode_column(itemf, vocabs["item"], "product_id", "item_idx")
    for c in ("cat_l1", "cat_l2", "brand"):
        out = encode_column(out, vocabs[c], c, f"{c}_idx", 0)
    scaled = standard_scale(
        out,
        {
            "avg_price_scaled": F.col("avg_price"),
            "log_confidence_scaled": F.log1p(F.col("item_total_confidence")),
            "purchase_rate_scaled": F.col("item_purchase_rate"),
        },
    )
    return scaled.select(*ITEM_ENCODED)


def encode_users(userf: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    out = encode_column(userf, vocabs["user"], "user_id", "user_idx")
    out = encode_column(out, vocabs["top_cat"], "top_category", "top_cat_idx", 0)
    scaled = standard_scale(
        out.withColumn("preferred_dow", F.col("preferred_dow") - 1),
        {
            "log_total_events": F.log1p(F.col("total_events")),
            "months_active": F.col("months_active"),
            "purchase_rate": F.col("purchase_rate"),
            "cart_rate": F.col("cart_rate"),
            "log_n_sessions": F.log1p(F.col("n_sessions")),
            "avg_purchase_price_scaled": F.col("avg_purchase_price"),
        },
    )
    return scaled.select(*USER_ENCODED)


def train_pairs(im: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    u, i = users.toDF("user_id", "user_idx"), items.toDF("product_id", "item_idx")
    return im.join(u, "user_id").join(i, "product_id").select("user_idx", "item_idx", "confidence_score")


def price_relative(itemf: DataFrame) -> DataFrame:
    """Price against the mean of its level-2 category, and its z-score."""
    means = itemf.groupBy("cat_l2").agg(F.avg("avg_price").alias("mean"))
    out = scale.salted_join(itemf, means, ["cat_l2"])
    mean = F.when(F.coalesce("mean", F.lit(0.0)) == 0, 1.0).otherwise(F.col("mean"))
    out = out.withColumn("price_relative", (F.col("avg_price") - mean) / mean).drop("mean")
    return standard_scale(out, {"price_relative_scaled": F.col("price_relative")})


def item_recency(itemf: DataFrame, im: DataFrame, cutoff: datetime = RECENCY_CUTOFF) -> DataFrame:
    """log1p of days from an item's first interaction to the cutoff, 0 when it has none, and its z-score."""
    first = im.groupBy("product_id").agg(F.min("first_interaction").alias("first"))
    days = (F.unix_micros(F.lit(cutoff).cast("timestamp")) - F.unix_micros("first")) / F.lit(86_400e6)
    out = itemf.select("product_id").join(first, "product_id", "left")
    out = out.withColumn("log_recency", F.coalesce(F.log1p(F.greatest(days, F.lit(0.0))), F.lit(0.0))).drop("first")
    return standard_scale(out, {"log_recency_scaled": F.col("log_recency")})


def cyclic_dow(users: DataFrame, column: str = "preferred_dow") -> DataFrame:
    angle = F.lit(2 * math.pi) * F.col(column) / 7
    return users.withColumns({"dow_sin": F.sin(angle), "dow_cos": F.cos(angle)})


def log_q(tp: DataFrame, items: DataFrame) -> DataFrame:
    """ln of each item's share of training pairs; ln(1/n_items) for items without any."""
    counts = tp.groupBy("item_idx").agg(n_rows().alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    size = items.agg(F.count_distinct("item_idx").alias("t")).scalar()
    out = items.select("item_idx").distinct().join(counts, "item_idx", "left")
    return out.select("item_idx", F.coalesce(F.ln(F.col("n") / total), F.ln(F.lit(1.0) / size)).alias("log_q"))


def confidence_weight(tp: DataFrame) -> DataFrame:
    """Confidence divided by its table mean, so the weights average 1."""
    mean = tp.agg(F.avg("confidence_score").alias("m")).scalar()
    return tp.withColumn("weight", F.col("confidence_score") / mean)


# --------------------------------------------------------------------------- vectors


def centroid_summary(centroids: DataFrame) -> DataFrame:
    """One row: users with and without strong pairs, and the mean norm of those with."""
    has = F.col("n_items") > 0
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x))
    return centroids.agg(
        F.count_if(has).alias("with_history"), F.count_if(~has).alias("without_history"), F.round(F.avg(F.when(has, length)), 6).alias("mean_norm")
    )


def user_centroid(tp: DataFrame, vecs: DataFrame, dim: int, min_score: float = 2.0) -> DataFrame:
    """Mean item vector over each user's strong pairs; a zero vector when there is none.

    The sums run as one numeric column per dimension, so they combine before the shuffle.
    """
    users = tp.select("user_idx").distinct()
    strong = tp.where(F.col("confidence_score") >= min_score).join(vecs.select("item_idx", "vec"), "item_idx")
    means = strong.groupBy("user_idx").agg(
        *[F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)], n_rows().alias("n_items")
    )
    packed = means.select("user_idx", F.array(*[F.col(f"d{i}") for i in range(dim)]).alias("centroid"), "n_items")
    zero = F.array_repeat(F.lit(0.0), F.lit(dim))
    return users.join(packed, "user_idx", "left").select(
        "user_idx", F.coalesce("centroid", zero).alias("centroid"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")
    )


def assemble_users(users: DataFrame, centroid: DataFrame | None = None, cyclic: bool = True) -> DataFrame:
    """(user_idx, categorical[4], dense[6], or 8 with the cyclic day); the centroid is appended to dense when given."""
    out = cyclic_dow(users) if cyclic else users
    cats = F.array(*[F.col(c).cast("long") for c in ("top_cat_idx", "peak_hour_bucket", "preferred_dow", "has_purchase_history")])
    dense = F.array(*[F.col(c).cast("double") for c in (*USER_ENCODED[6:], *(("dow_sin", "dow_cos") if cyclic else ()))])
    if centroid is not None:
        out = out.join(centroid.select("user_idx", "centroid"), "user_idx", "left")
        # Users without any pair have no centroid row.
        width = centroid.agg(F.max(F.size("centroid")).alias("w")).scalar()
        dense = F.concat(dense, F.coalesce("centroid", F.array_repeat(F.lit(0.0), F.coalesce(width, F.lit(0)))))
    return out.select("user_idx", cats.alias("user_cat"), dense.alias("user_dense"))


def assemble_items(items: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(item_idx, categorical[5], dense[3 + extras])."""
    cats = ("item_idx", "cat_l1_idx", "cat_l2_idx", "brand_idx", "price_bucket")
    return items.select(
        "item_idx",
        F.array(*[F.col(c).cast("long") for c in cats]).alias("item_cat"),
        F.array(*[F.col(c).cast("double") for c in (*ITEM_ENCODED[6:], *extra)]).alias("item_dense"),
    )


# --------------------------------------------------------------------------- checks


def check_rows(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named condition over a one-row frame."""
    rows = [
        F.struct(F.lit(name).alias("check_name"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))
        for name, ok in checks.items()
    ]
    return row.select(F.inline(F.array(*rows)))


def item_feature_nulls(itemf: DataFrame, low: int = 280_000, high: int = 290_000) -> DataFrame:
    keys = ("cat_l1", "cat_l2", "brand", "avg_price", "item_total_confidence", "item_purchase_rate")
    return itemf.agg(
        n_rows().alias("n_items"), F.when(n_rows().between(low + 1, high - 1), "PASS").otherwise("FAIL").alias("size_check"),
        *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys],
    )


def price_bucket_counts(itemf: DataFrame) -> DataFrame:
    return itemf.groupBy("price_bucket").agg(n_rows().alias("n_items")).orderBy("price_bucket")


def validate_user_features(f: DataFrame) -> DataFrame:
    """Ranges and null counts of the user features and the three assertions on them."""
    ends = ("total_events", "months_active", "purchase_rate", "peak_hour_bucket", "preferred_dow", "avg_purchase_price",
            "has_purchase_history")
    row = f.agg(
        n_rows().alias("n_users"),
        *[fn(c).alias(f"{p}_{c}") for c in ends for p, fn in (("min", F.min), ("max", F.max))],
        F.round(F.avg("total_events"), 1).alias("avg_events"),
        F.count_if(F.col("total_events").isNull()).alias("null_event_count"),
        F.count_if(F.col("top_category").isNull()).alias("null_top_category"),
    )
    ok = (
        (F.col("min_peak_hour_bucket") >= 0) & (F.col("max_peak_hour_bucket") <= 3)
        & (F.col("min_preferred_dow") >= 1) & (F.col("max_preferred_dow") <= 7) & (F.col("null_event_count") == 0)
    )
    return row.withColumn("in_range", ok)


def validate_encoded(
    items: DataFrame, users: DataFrame, tp: DataFrame, vocabs: dict[str, DataFrame],
    pair_bounds: tuple[int, int] = (400_000, 2_000_000), first_item: int = 1,
) -> DataFrame:
    """The fourteen checks on the encoded tables, as PASS/FAIL rows.

    Vocabulary and scaler files are tables here, so their checks look at columns and contents.
    """
    def missing(df: DataFrame) -> Column:
        total = F.lit(0)
        for f in df.schema:
            c = F.col(f.name)
            total = total + F.count_if(c.isNull() | (F.isnan(c) if f.dataType.typeName() == "double" else F.lit(False)))
        return total

    def one(df: DataFrame, expr: Column) -> Column:
        return df.agg(expr.alias("v")).scalar()

    sizes = {n: one(v, n_rows()) for n, v in vocabs.items()}
    zero = {
        n: vocabs[n].where(F.col(vocabs[n].columns[0]) == UNKNOWN).agg(F.max(vocabs[n].columns[1]).alias("v")).scalar()
        for n in ("cat_l1", "brand")
    }
    row = tp.agg(
        n_rows().alias("n_pairs"), F.min("item_idx").alias("lo_i"), F.max("item_idx").alias("hi_i"),
        F.min("user_idx").alias("lo_u"), F.max("user_idx").alias("hi_u"),
    ).withColumns(
        {
            "n_item": sizes["item"], "n_user": sizes["user"], "z_cat": zero["cat_l1"], "z_brand": zero["brand"],
            "bad_items": one(items, missing(items)), "bad_users": one(users, missing(users)),
            "u_items": one(items, F.count_distinct("item_idx")), "u_users": one(users, F.count_distinct("user_idx")),
        }
    )
    c = F.col
    return check_rows(
        row,
        {
            "vocabularies present": F.lit(set(vocabs) == {"user", "item", "cat_l1", "cat_l2", "brand", "top_cat"}),
            "item scaled columns present": F.lit(set(ITEM_ENCODED[6:]) <= set(items.columns)),
            "user scaled columns present": F.lit(set(USER_ENCODED[6:]) <= set(users.columns)),
            "items_encoded columns": F.lit(set(items.columns) == set(ITEM_ENCODED)),
            "users_encoded columns": F.lit(set(users.columns) == set(USER_ENCODED)),
            "train_pairs columns": F.lit(set(tp.columns) == {"user_idx", "item_idx", "confidence_score"}),
            "items_encoded has no NaN": c("bad_items") == 0,
            "users_encoded has no NaN": c("bad_users") == 0,
            "item_idx in range": (c("lo_i") >= first_item) & (c("hi_i") < c("n_item") + first_item),
            "user_idx in range": (c("lo_u") >= 0) & (c("hi_u") < c("n_user")),
            "train_pairs size": c("n_pairs").between(*pair_bounds),
            "unknown is 0": (c("z_cat") == 0) & (c("z_brand") == 0),
            "item vocabulary size": c("u_items") == c("n_item"),
            "user vocabulary size": c("u_users") == c("n_user"),
        },
    )


def vocab_report(items: DataFrame, users: DataFrame, tp: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    """Sizes, ranges and shares of the encoded tables in one row, with the pairs whose index does not map back."""
    u = vocabs["user"].toDF("user_id", "user_idx")
    i = vocabs["item"].toDF("product_id", "item_idx")
    lost = tp.join(u, "user_idx", "left_anti").select("item_idx").unionByName(tp.join(i, "item_idx", "left_anti").select("item_idx"))
    lowest = items.agg(F.min("purchase_rate_scaled").alias("m")).scalar()
    row = items.agg(
        n_rows().alias("n_items"), F.min("cat_l1_idx").alias("min_cat_l1"), F.max("cat_l1_idx").alias("max_cat_l1"),
        F.min("cat_l2_idx").alias("min_cat_l2"), F.max("cat_l2_idx").alias("max_cat_l2"),
        F.min("brand_idx").alias("min_brand"), F.max("brand_idx").alias("max_brand"),
    ).withColumn(
        "pct_min_purchase_rate",
        items.agg(F.round(F.count_if(F.col("purchase_rate_scaled") == lowest) * 100 / n_rows(), 4).alias("v")).scalar(),
    )
    row = scale.beside(row, users.agg(
        n_rows().alias("n_users"), F.min("preferred_dow").alias("min_dow"), F.max("preferred_dow").alias("max_dow"),
        F.count_if(F.col("has_purchase_history") == 1).alias("with_purchases"),
        F.count_if(F.col("has_purchase_history") == 0).alias("without_purchases"),
    ))
    row = scale.beside(row, tp.agg(
        n_rows().alias("n_pairs"), F.count_distinct("user_idx").alias("pair_users"), F.count_distinct("item_idx").alias("pair_items"),
        F.min("confidence_score").alias("min_score"), F.max("confidence_score").alias("max_score"),
    ))
    return row.withColumn("unmapped_pairs", lost.agg(n_rows().alias("c")).scalar())


def describe_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min and max per scaled column."""
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"),
            F.round(F.stddev_samp(c), 6).alias("std"), F.round(F.min(c), 6).alias("min"), F.round(F.max(c), 6).alias("max"),
        ).alias(c) for c in columns
    ])
    return row.select(F.inline(F.array(*columns)))


def topn_coverage(test: DataFrame, trained: DataFrame, n: int = 100, gate: int = 90) -> DataFrame:
    """How many of the n most bought test items were seen in training."""
    top = (
        test.where(is_type("purchase")).groupBy("product_id").agg(n_rows().alias("purchases"))
        .orderBy(F.desc("purchases"), "product_id").limit(n)
    )
    seen = trained.select("product_id", F.lit(1).alias("hit")).distinct()
    out = top.join(seen, "product_id", "left").agg(n_rows().alias("top_items"), F.count("hit").alias("covered"))
    return out.withColumn("verdict", F.when(F.col("covered") >= gate, "PASS").otherwise("FAIL"))
