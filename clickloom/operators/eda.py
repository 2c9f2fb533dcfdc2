"""Descriptive reports over an event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.functions import (
    ITEM_BINS, ITEM_BINS_SHORT, PER_DAY_BINS, PRICE_BINS, PURCHASE_BINS, SESSION_BINS, SESSION_BINS_SHORT,
    USER_BINS, USER_BINS_SHORT, WEEKDAYS, at_most_label, bin_order, count_type, month_of, n_rows, part_of, pct, price_label,
)
from clickloom.operators.clean import DUP_KEYS, in_category



def count_per(ev: DataFrame, key: str, name: str = "n_events") -> DataFrame:
    return ev.groupBy(key).agg(n_rows().alias(name))


def with_share(groups: DataFrame, n: str, name: str = "pct", digits: int = 2, of: Column | None = None) -> DataFrame:
    """Share of total over an already grouped report, by a scalar subquery."""
    total = groups.agg((of if of is not None else F.sum(n)).alias("t")).scalar()
    return groups.withColumn(name, F.round(F.col(n) / total * 100, digits))


def monthly_volume(ev: DataFrame) -> DataFrame:
    return (
        ev.groupBy(month_of("event_time").alias("month"))
        .agg(
            n_rows().alias("total_events"),
            F.count_distinct("user_id").alias("unique_users"),
            F.count_distinct("product_id").alias("unique_products"),
            count_type("view").alias("views"),
            count_type("cart").alias("carts"),
            count_type("purchase").alias("purchases"),
            pct(count_type("cart"), n_rows()).alias("cart_rate_pct"),
            pct(count_type("purchase"), n_rows()).alias("purchase_rate_pct"),
        )
        .orderBy("month")
    )


def null_audit(ev: DataFrame) -> DataFrame:
    columns = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price",
               "user_id", "user_session")
    missing = {c: F.col(c).isNull() for c in columns}
    cat, brand = missing["category_code"], missing["brand"]
    return ev.agg(
        n_rows().alias("total_rows"),
        *[F.count_if(missing[c]).alias(f"null_{c}") for c in columns],
        *[pct(F.count_if(missing[c]), n_rows()).alias(f"pct_null_{c}")
          for c in ("category_code", "brand", "price", "user_session")],
        F.count_if(cat & brand).alias("null_both_cat_brand"),
        F.count_if(cat & ~brand).alias("null_cat_only"),
        F.count_if(~cat & brand).alias("null_brand_only"),
    )


def null_by_type(ev: DataFrame) -> DataFrame:
    return (
        ev.groupBy("event_type")
        .agg(n_rows().alias("total"),
             *[pct(F.count_if(F.col(c).isNull()), n_rows()).alias(f"pct_null_{c}")
               for c in ("category_code", "brand", "price")])
        .orderBy(F.desc("total"), "event_type")
    )


def dup_count(ev: DataFrame) -> DataFrame:
    """Rows beyond the first of each duplicate key; a null session is a value of its own."""
    groups = ev.groupBy(*DUP_KEYS).agg(n_rows().alias("n"))
    extra = F.sum(F.col("n") - 1)
    return groups.agg(
        F.sum("n").alias("total_rows"),
        extra.alias("exact_duplicate_rows"),
        F.round(extra / F.sum("n") * 100, 4).alias("exact_dupe_pct"),
    )


def price_percentiles(ev: DataFrame) -> DataFrame:
    price = F.col("price")
    row = ev.agg(
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.avg(price).alias("price_mean"),
        F.count_if(price.isNull()).alias("null_price_count"),
        F.count_if(price <= 0).alias("zero_or_negative_price"),
        F.count_if(price > 10000).alias("price_gt_10k"),
        F.count_if(price > 50000).alias("price_gt_50k"),
    )
    points = scale.percentiles(ev, "price", [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])
    return scale.beside(row, points)


def price_buckets(ev: DataFrame) -> DataFrame:
    return (
        ev.groupBy(price_label("price").alias("price_bucket"))
        .agg(n_rows().alias("event_count"), F.count_distinct("product_id").alias("unique_products"),
             F.min(F.coalesce("price", F.lit(-1.0))).alias("_order"))
        .orderBy("_order")
        .drop("_order")
    )


def binned_counts(counts: DataFrame, value: str, bins: Sequence, label: str, name: str) -> DataFrame:
    """How many keys fall in each bin of their count, in bin order."""
    out = counts.groupBy(at_most_label(value, bins).alias(label)).agg(n_rows().alias(name))
    return out.orderBy(bin_order(label, bins))


def user_activity_buckets(ev: DataFrame, bins: Sequence = USER_BINS) -> DataFrame:
    return binned_counts(count_per(ev, "user_id"), "n_events", bins, "total_events_bucket", "user_count")


def user_activity_buckets_short(ev: DataFrame) -> DataFrame:
    return user_activity_buckets(ev, USER_BINS_SHORT)


def epd_buckets(ev: DataFrame) -> DataFrame:
    per_user = ev.groupBy("user_id").agg((n_rows() / F.count_distinct(F.to_date("event_time"))).alias("per_day"))
    return binned_counts(per_user, "per_day", PER_DAY_BINS, "epd_bucket", "user_count")


def core_viability(ev: DataFrame, ks: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    counts = count_per(ev, "user_id").select("n_events", F.explode(F.array(*map(F.lit, ks))).alias("min_interactions"))
    out = counts.where(F.col("n_events") >= F.col("min_interactions")).groupBy("min_interactions").agg(
        n_rows().alias("users_surviving")
    )
    return with_share(out, "users_surviving", "pct_surviving", of=F.max("users_surviving")).orderBy("min_interactions")


def core_marginal(viability: DataFrame) -> DataFrame:
    """Users lost between one threshold and the next; one row per threshold."""
    w = Window.orderBy("min_interactions")
    prev = {c: F.lag(c).over(w) for c in ("min_interactions", "users_surviving", "pct_surviving")}
    return viability.select(
        prev["min_interactions"].alias("k_from"),
        F.col("min_interactions").alias("k_to"),
        (prev["users_surviving"] - F.col("users_surviving")).alias("users_lost"),
        F.round(prev["pct_surviving"] - F.col("pct_surviving"), 2).alias("pct_lost"),
        (F.col("min_interactions") - prev["min_interactions"]).alias("k_units"),
    ).where(F.col("k_from").isNotNull())


def item_activity_buckets(ev: DataFrame, bins: Sequence = ITEM_BINS) -> DataFrame:
    return binned_counts(count_per(ev, "product_id"), "n_events", bins, "event_count_bucket", "product_count")


def item_activity_buckets_short(ev: DataFrame) -> DataFrame:
    return item_activity_buckets(ev, ITEM_BINS_SHORT)


def top_products(ev: DataFrame, n: int = 100) -> DataFrame:
    return (
        ev.groupBy("product_id")
        .agg(
            n_rows().alias("total_events"),
            count_type("view").alias("views"),
            count_type("cart").alias("carts"),
            count_type("purchase").alias("purchases"),
            F.count_distinct("user_id").alias("unique_users"),
            F.max("brand").alias("brand"),
            F.max("category_code").alias("category_code"),
            F.round(F.avg("price"), 2).alias("avg_price"),
        )
        .orderBy(F.desc("total_events"), "product_id")
        .limit(n)
    )


def session_lengths(ev: DataFrame) -> DataFrame:
    return count_per(ev.where(F.col("user_session").isNotNull()), "user_session", "session_length")


def session_length_buckets(ev: DataFrame, bins: Sequence = SESSION_BINS) -> DataFrame:
    out = session_lengths(ev).groupBy(at_most_label("session_length", bins).alias("session_length_bucket")).agg(
        n_rows().alias("session_count")
    )
    return with_share(out, "session_count").orderBy(bin_order("session_length_bucket", bins))


def session_length_buckets_short(ev: DataFrame) -> DataFrame:
    return binned_counts(session_lengths(ev), "session_length", SESSION_BINS_SHORT, "bucket", "n_sessions")


def _session_spans(ev: DataFrame) -> DataFrame:
    seconds = scale.epoch_seconds("event_time")
    return ev.where(F.col("user_session").isNotNull()).groupBy("user_session").agg(
        (F.max(seconds) - F.min(seconds)).alias("seconds")
    )


def session_duration(ev: DataFrame) -> DataFrame:
    """Whole minutes between first and last event; merged to one row per distinct duration first."""
    minutes = scale.value_counts(_session_spans(ev).select(F.floor(F.col("seconds") / 60).alias("m")), "m")
    v, n = F.col("v"), F.col("n")

    def sessions(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return minutes.agg(
        *[scale.percentile_of_counts(p).alias(f"p{p * 100:.0f}_min") for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)],
        F.round(F.sum(v * n) / F.sum(n), 6).alias("mean_min"),
        sessions(v == 0).alias("zero_duration_sessions"),
        sessions(v > 60).alias("sessions_over_1hr"),
        sessions(v > 480).alias("sessions_over_8hr"),
    )


def flag_long_sessions(ev: DataFrame, minutes: int = 60) -> DataFrame:
    return _session_spans(ev).select(
        "user_session", "seconds", (F.col("seconds") > minutes * 60).alias("is_broken")
    )


def sessions_per_user(ev: DataFrame) -> DataFrame:
    per_user = ev.where(F.col("user_session").isNotNull()).groupBy("user_id").agg(
        F.count_distinct("user_session").alias("s")
    )
    v, n = F.col("v"), F.col("n")
    return scale.value_counts(per_user, "s").agg(
        *[scale.percentile_of_counts(p).alias(f"p{p * 100:.0f}") for p in (0.25, 0.5, 0.75, 0.9, 0.99)],
        F.round(F.sum(v * n) / F.sum(n), 6).alias("mean"),
        F.max(v).alias("max_sessions"),
    )


def user_funnel(ev: DataFrame) -> DataFrame:
    per_user = ev.groupBy("user_id").agg(
        count_type("view").alias("views"), count_type("cart").alias("carts"), count_type("purchase").alias("purchases")
    )
    viewed, carted, bought = (F.col(c) > 0 for c in ("views", "carts", "purchases"))
    return per_user.agg(
        n_rows().alias("total_users"),
        F.count_if(viewed).alias("users_with_views"),
        F.count_if(carted).alias("users_with_carts"),
        F.count_if(bought).alias("users_with_purchases"),
        F.count_if(viewed & ~carted & ~bought).alias("view_only_users"),
        F.count_if(carted & ~bought).alias("carted_never_purchased"),
        F.count_if(bought).alias("ever_purchased"),
        pct(F.count_if(carted), n_rows()).alias("pct_users_carted"),
        pct(F.count_if(bought), n_rows()).alias("pct_users_purchased"),
    )


def product_conversion(ev: DataFrame, min_views: int = 10) -> DataFrame:
    counts = ev.groupBy("product_id").agg(count_type("purchase").alias("purchases"), count_type("view").alias("views"))
    return counts.where(F.col("views") >= min_views).withColumn(
        "conversion_rate", F.try_divide(F.col("purchases"), F.col("views"))
    )


def conversion_stats(ev: DataFrame, min_views: int = 10) -> DataFrame:
    rates = product_conversion(ev, min_views)
    rate = F.col("conversion_rate")
    row = rates.agg(
        F.round(F.avg(rate), 6).alias("mean_conv"),
        F.count_if(rate == 0).alias("zero_conversion_products"),
        F.count_if(rate == 1).alias("full_conversion_products"),
    )
    points = scale.percentiles(rates, "conversion_rate", [0.25, 0.5, 0.75, 0.9])
    return scale.beside(row, points.select(*[F.round(c, 6).alias(f"{c}_conv") for c in points.columns]))


def monthly_users(ev: DataFrame) -> DataFrame:
    return ev.select("user_id", month_of("event_time").alias("month")).distinct()


def month_overlap(ev: DataFrame, diagonal: bool = False) -> DataFrame:
    """Users active in both months. A user has at most one row per month, so pairs stay few."""
    mu = monthly_users(ev)
    a, b = mu.withColumnRenamed("month", "month_a"), mu.withColumnRenamed("month", "month_b")
    later = F.col("month_a") <= F.col("month_b") if diagonal else F.col("month_a") < F.col("month_b")
    return a.join(b, "user_id").where(later).groupBy("month_a", "month_b").agg(n_rows().alias("shared_users")).orderBy(
        "month_a", "month_b"
    )


def mirrored(upper: DataFrame) -> DataFrame:
    """An upper triangle and its mirror image."""
    swapped = upper.select(F.col("month_b").alias("month_a"), F.col("month_a").alias("month_b"), "shared_users")
    return upper.select("month_a", "month_b", "shared_users").unionByName(swapped)


def overlap_matrix(ev: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Symmetric month-by-month matrix of shared users; one column per month."""
    grid = mirrored(month_overlap(ev, diagonal=True)).groupBy("month_a")
    pivot = grid.pivot("month_b", list(months)) if months else grid.pivot("month_b")
    return pivot.agg(F.first("shared_users").cast("double")).orderBy("month_a")


def category_l1(ev: DataFrame, n: int = 30) -> DataFrame:
    out = (
        ev.where(F.col("category_code").isNotNull())
        .groupBy(part_of("category_code", 0).alias("top_level_category"))
        .agg(n_rows().alias("events"), F.count_distinct("product_id").alias("unique_products"),
             F.count_distinct("user_id").alias("unique_users"))
    )
    return with_share(out, "events", "pct_events").orderBy(F.desc("events"), "top_level_category").limit(n)


def category_drill(ev: DataFrame, level1: str, n: int = 20) -> DataFrame:
    return (
        in_category(ev, level1)
        .groupBy("category_code")
        .agg(n_rows().alias("events"), F.count_distinct("brand").alias("brands"),
             F.round(F.avg("price"), 2).alias("avg_price"), F.count_distinct("product_id").alias("products"))
        .orderBy(F.desc("events"), "category_code")
        .limit(n)
    )


def category_depth(ev: DataFrame) -> DataFrame:
    return (
        ev.where(F.col("category_code").isNotNull())
        .groupBy(F.size(F.split("category_code", "[.]")).alias("depth"))
        .agg(n_rows().alias("event_count"), F.count_distinct("product_id").alias("unique_products"))
        .orderBy("depth")
    )


def null_category(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.col("category_code").isNull().alias("cat_code_is_null")).agg(
        n_rows().alias("events"),
        F.count_distinct("category_id").alias("unique_category_ids"),
        F.count_distinct("product_id").alias("unique_products"),
        F.round(F.avg("price"), 2).alias("avg_price"),
    )


def top_brands(ev: DataFrame, n: int = 30) -> DataFrame:
    return (
        ev.where(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(n_rows().alias("events"), F.count_distinct("product_id").alias("unique_products"),
             F.round(F.avg("price"), 2).alias("avg_price"), count_type("purchase").alias("purchases"))
        .orderBy(F.desc("events"), "brand")
        .limit(n)
    )


def active_months(ev: DataFrame) -> DataFrame:
    per_user = monthly_users(ev).groupBy("user_id").agg(n_rows().alias("active_months"))
    return with_share(per_user.groupBy("active_months").agg(n_rows().alias("user_count")), "user_count").orderBy("active_months")


def repeat_purchase(ev: DataFrame) -> DataFrame:
    bought = count_per(ev.where(F.col("event_type") == "purchase"), "user_id")
    return with_share(
        binned_counts(bought, "n_events", PURCHASE_BINS, "purchase_count_bucket", "user_count"), "user_count"
    ).orderBy(bin_order("purchase_count_bucket", PURCHASE_BINS))


def new_vs_returning(ev: DataFrame) -> DataFrame:
    """Per month, users seen for the first time and users seen before."""
    mu = monthly_users(ev)
    first = mu.groupBy("user_id").agg(F.min("month").alias("month"), F.lit(1).alias("is_new"))
    flagged = mu.join(first, ["user_id", "month"], "left")
    fresh = F.count("is_new")
    return flagged.groupBy("month").agg(
        n_rows().alias("active_users"), fresh.alias("new_users"), (n_rows() - fresh).alias("returning_users"),
        pct(fresh, n_rows()).alias("pct_new"),
    ).orderBy("month")


def event_mix(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(n_rows().alias("n_events")).orderBy(F.desc("n_events"), "event_type")


SUMMARY_POINTS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def summary(df: DataFrame, column: str) -> DataFrame:
    """min, quartiles, upper percentiles, max and mean of a numeric column of any cardinality."""
    ends = df.agg(F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
                  F.round(F.avg(column), 6).alias("mean"))
    points = scale.percentiles(df, column, SUMMARY_POINTS)
    return scale.beside(ends, points.select(*[F.round(c, 6).alias(c) for c in points.columns]))


def count_summary(df: DataFrame, column: str) -> DataFrame:
    """:func:`summary` for a column of per-key counts: one row per distinct count is merged."""
    v, n = F.col("v"), F.col("n")
    return scale.value_counts(df, column).agg(
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"),
        F.round(F.sum(v * n) / F.sum(n), 6).alias("mean"),
        *[F.round(scale.percentile_of_counts(p), 6).alias(scale.percentile_name(p)) for p in SUMMARY_POINTS],
    )


def activity_summary(ev: DataFrame) -> DataFrame:
    """Summaries of events per user, per item and per session."""
    out = None
    for name, key in (("user", "user_id"), ("item", "product_id"), ("session", "user_session")):
        one = count_summary(count_per(ev, key), "n_events").select(F.lit(name).alias("per"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def price_floor_audit(ev: DataFrame) -> DataFrame:
    zero, low = F.count_if(F.col("price") <= 0), F.count_if(F.col("price") < 1)
    return ev.agg(
        n_rows().alias("total_rows"), zero.alias("zero_or_negative"), pct(zero, n_rows()).alias("zero_pct"),
        low.alias("below_1"), pct(low, n_rows()).alias("below_1_pct"),
    )


def hourly(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.hour("event_time").alias("hour")).agg(n_rows().alias("n_events")).orderBy("hour")


def daily(ev: DataFrame) -> DataFrame:
    days = F.array(*map(F.lit, WEEKDAYS))
    out = ev.groupBy(F.date_format("event_time", "EEEE").alias("day_of_week")).agg(n_rows().alias("n_events"))
    return out.orderBy(F.array_position(days, F.col("day_of_week")))


def category_bins(items: DataFrame, column: str) -> DataFrame:
    """Items per category with their share of the catalog."""
    out = items.groupBy(column).agg(F.count_distinct("product_id").alias("item_count"))
    return with_share(out, "item_count", "pct", 4)


def category_bin_stats(items: DataFrame, column: str) -> DataFrame:
    """Distribution of category sizes, and how many categories are small."""
    v, n = F.col("v"), F.col("n")

    def bins(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return scale.value_counts(category_bins(items, column), "item_count").agg(
        F.sum(n).alias("n_bins"), F.round(F.sum(v * n) / F.sum(n), 6).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        *[scale.percentile_of_counts(p).alias(scale.percentile_name(p)) for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)],
        bins(v < 50).alias("bins_under_50"), bins(v < 10).alias("bins_under_10"),
    )


def head_and_tail(ranking: DataFrame, value: str, key: str, n: int = 20) -> DataFrame:
    """The n largest and the n smallest rows of a ranking."""
    top = ranking.orderBy(F.desc(value), F.asc(key)).limit(n).withColumn("side", F.lit("top"))
    bottom = ranking.orderBy(F.asc(value), F.asc(key)).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
