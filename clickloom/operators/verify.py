"""Checks of which features carry signal, on training and test events with item features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import scale
from clickloom.functions import SHARE_CUTS, SPREAD_CUTS, is_type, n_rows
from clickloom.operators.features import user_category_counts

STAT_KEYS = ("product_id", "total_confidence", "n_views", "n_purchases", "n_carts", "purchase_rate", "cat_l1", "brand",
             "price_bucket", "avg_price")
BINS = ("very_cold", "cold", "medium", "warm", "hot")


def item_stats(im: DataFrame, itemf: DataFrame) -> DataFrame:
    """Distinct users per distinct tuple of interaction stats and item features (not per item)."""
    joined = im.join(itemf.select("product_id", "cat_l1", "brand", "price_bucket", "avg_price"), "product_id")
    return joined.withColumns(
        {"total_confidence": F.col("confidence_score"), "purchase_rate": F.try_divide("n_purchases", "n_views")}
    ).groupBy(*STAT_KEYS).agg(F.count_distinct("user_id").alias("n_users"))


def quintiles(stats: DataFrame, value: str, average: str) -> DataFrame:
    """Five equal-width slices of the rank of ``value``: size, mean, share with purchases, mean rate."""
    order = [F.asc(value), *[F.asc_nulls_first(k) for k in STAT_KEYS]]
    ranked = scale.add_position(stats, order, "_r")
    size = stats.agg(n_rows().alias("c")).scalar()
    at = F.ceil(F.lit(5) * (F.col("_r") - 1) / (F.col("_n") - 1))
    binned = ranked.withColumn("_n", size).withColumn("_bin", F.greatest(F.lit(1), at.cast("int")))
    return binned.groupBy("_bin").agg(
        n_rows().alias("n_items"), F.round(F.avg(value), 4).alias(average),
        F.round(F.avg((F.col("n_purchases") > 0).cast("int")), 4).alias("pct_purchased"),
        F.round(F.avg("purchase_rate"), 4).alias("avg_purchase_rate"),
    ).select(F.element_at(F.array(*map(F.lit, BINS)), F.col("_bin")).alias("bin"), "n_items", average, "pct_purchased", "avg_purchase_rate")


def pareto(stats: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """Percentage of purchasing rows that make up each share of all purchases."""
    bought = stats.where(F.col("n_purchases") > 0).select("n_purchases")
    # Equal counts are interchangeable, so the walk goes over distinct counts and divides inside the last.
    groups = bought.groupBy("n_purchases").agg(n_rows().alias("k"), F.sum("n_purchases").alias("units"))
    walked = scale.add_running_total(groups, [F.desc("n_purchases")], "units", "units_upto")
    rows = scale.add_running_total(groups, [F.desc("n_purchases")], "k", "rows_upto").select("n_purchases", "rows_upto")
    totals = groups.agg(F.struct(F.sum("units").alias("units"), F.sum("k").alias("k")).alias("t")).scalar()
    out = walked.join(rows, "n_purchases").withColumn("_t", totals).withColumn(
        "threshold", F.explode(F.array(*map(F.lit, thresholds)))
    )
    goal = F.col("threshold") * F.col("_t.units")
    before = F.col("units_upto") - F.col("units")
    inside = F.ceil((goal - before) / F.col("n_purchases"))
    rank = F.col("rows_upto") - F.col("k") + F.greatest(inside, F.lit(1))
    return out.where((F.col("units_upto") >= goal) & (before < goal)).select(
        "threshold", rank.cast("long").alias("rank"), F.round(rank * 100 / F.col("_t.k"), 4).alias("pct_items")
    )


def describe(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max."""
    row = df.agg(
        F.count(column).alias("count"), F.round(F.avg(column), digits).alias("mean"), F.round(F.stddev_samp(column), digits).alias("std"),
        F.round(F.min(column), digits).alias("min"), F.round(F.max(column), digits).alias("max"),
    )
    points = scale.percentiles(df, column, [0.25, 0.5, 0.75])
    return scale.beside(row, points.select(*[F.round(c, digits).alias(c) for c in points.columns]))


def cut(value: str, edges) -> Column:
    """Label of the right-closed interval, null above the last edge."""
    out = None
    for upper, label in edges:
        out = F.when(F.col(value) <= upper, label) if out is None else out.when(F.col(value) <= upper, label)
    return out


def top_category_share(train: DataFrame, itemf: DataFrame) -> DataFrame:
    """Each user's strongest level-1 category and its share of the user's events."""
    counts = user_category_counts(train, itemf)
    total = counts.groupBy("user_id").agg(F.sum("n_events").alias("total"))
    best = scale.top_per_key(counts, ["user_id"], [F.desc("n_events"), F.asc("cat_l1")], 1)
    return best.join(total, "user_id").select("user_id", "cat_l1", (F.col("n_events") / F.col("total")).alias("share"))


def binned_share(df: DataFrame, column: str, edges) -> DataFrame:
    return df.groupBy(cut(column, edges).alias("bin")).agg(n_rows().alias("n_users"))


def share_bins(top: DataFrame) -> DataFrame:
    return binned_share(top, "share", SHARE_CUTS)


def category_match(test: DataFrame, top: DataFrame, itemf: DataFrame) -> DataFrame:
    """(train_top_cat, purchases, matches): test purchases of known users, by their top category."""
    counts = test.where(is_type("purchase")).groupBy("user_id", "product_id").agg(n_rows().alias("n"))
    bought = counts.join(itemf.select("product_id", F.col("cat_l1").alias("purchased_cat")), "product_id")
    merged = bought.join(top.select("user_id", F.col("cat_l1").alias("train_top_cat")), "user_id")
    return merged.groupBy("train_top_cat").agg(
        F.sum("n").alias("purchases"), F.coalesce(F.sum(F.when(F.col("purchased_cat") == F.col("train_top_cat"), F.col("n"))), F.lit(0)).alias("matches")
    )


def category_match_report(match: DataFrame) -> DataFrame:
    """Match rate overall and per training top category."""
    both = match.withColumn("category", F.explode(F.array("train_top_cat", F.lit("(all)"))))
    return both.groupBy("category").agg(
        F.sum("purchases").alias("purchases"), F.round(F.sum("matches") / F.sum("purchases"), 6).alias("match_rate")
    )


def price_spread(train: DataFrame, itemf: DataFrame, min_purchases: int = 2) -> DataFrame:
    """Sample deviation of the price level over each user's purchases."""
    bought = train.where(is_type("purchase")).select("user_id", "product_id").join(itemf.select("product_id", "price_bucket"), "product_id")
    out = bought.groupBy("user_id").agg(n_rows().alias("n"), F.stddev_samp("price_bucket").alias("spread"))
    return out.where(F.col("n") >= min_purchases)


def spread_bins(spread: DataFrame) -> DataFrame:
    return binned_share(spread, "spread", SPREAD_CUTS)


def price_correlation(train: DataFrame, test: DataFrame, itemf: DataFrame) -> DataFrame:
    """Pearson correlation of users' mean purchase price in training and in the test window."""
    def mean(ev: DataFrame, name: str) -> DataFrame:
        bought = ev.where(is_type("purchase")).select("user_id", "product_id")
        return bought.join(itemf.select("product_id", "avg_price"), "product_id").groupBy("user_id").agg(F.avg("avg_price").alias(name))

    both = mean(train, "a").join(mean(test, "b"), "user_id")
    return both.agg(F.round(F.corr("a", "b"), 6).alias("correlation"), n_rows().alias("n_users"))


def feature_decisions(train: DataFrame, test: DataFrame, itemf: DataFrame, im: DataFrame) -> DataFrame:
    """Include or leave out each feature, by the fixed thresholds of the verification."""
    stats = item_stats(im, itemf)

    def rising(value: str) -> DataFrame:
        bins = quintiles(stats, value, "average")
        # Five rows.
        shares = F.transform(F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, BINS)), F.col("bin")).alias("at"), "pct_purchased"))), lambda x: x["pct_purchased"])
        row = bins.agg(shares.alias("s"))
        ok = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i) >= F.get("s", i - 1))
        return row.select(ok.alias("ok"))

    match = category_match(test, top_category_share(train, itemf), itemf)
    row = stats.agg(F.round(F.avg((F.col("n_purchases") == 0).cast("int")) * 100, 4).alias("zero_pct"))
    row = row.withColumns(
        {
            "by_confidence": rising("total_confidence").scalar(),
            "by_users": rising("n_users").scalar(),
            "match": match.agg(F.round(F.sum("matches") / F.sum("purchases"), 6).alias("m")).scalar(),
            "corr": price_correlation(train, test, itemf).select("correlation").scalar(),
        }
    )
    rules = {
        "item_total_confidence": (F.col("by_confidence").cast("double"), F.col("by_confidence")),
        "item_n_users": (F.col("by_users").cast("double"), F.col("by_users")),
        "item_purchase_rate": (F.col("zero_pct"), F.col("zero_pct") > 40),
        "user_top_category": (F.col("match"), F.col("match") > 0.30),
        "user_avg_purchase_price": (F.col("corr"), F.col("corr") > 0.4),
    }
    rows = [
        F.struct(F.lit(name).alias("feature"), value.alias("result"), F.when(ok, "yes").otherwise("no").alias("include"))
        for name, (value, ok) in rules.items()
    ]
    return row.select(F.inline(F.array(*rows)))
