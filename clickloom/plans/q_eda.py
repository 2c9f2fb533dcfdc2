"""Aggregation, window, sort, set and scalar-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom import functions as fn
from clickloom import scale
from clickloom.functions import time_text
from clickloom.operators import clean, eda, features, tables
from clickloom.plans.q_clean import BOT_PER_DAY, CFG
from clickloom.plans.registry import cte, query

TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def case_at_most(value: str, bins) -> str:
    """SQL CASE for bins closed at their upper edge."""
    arms = " ".join(f"WHEN {value} <= {u} THEN '{label}'" for u, label in bins if u is not None)
    return f"CASE {arms} ELSE '{bins[-1][1]}' END"


def binned_sql(key: str, bins, label: str, name: str, source: str, where: str = "TRUE") -> str:
    return (f"SELECT {case_at_most('n', bins)} AS {label}, count(*) AS {name} FROM "
            f"(SELECT {key}, count(*) AS n FROM {source} WHERE {where} GROUP BY {key}) GROUP BY 1")


def pct_sql(part: str, whole: str = "count(*)", digits: int = 2) -> str:
    return f"round({part} / {whole} * 100, {digits})"


def filt(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


VIEW, CART, BUY = (filt(f"event_type = '{e}'") for e in ("view", "cart", "purchase"))


@query("agg_01_interactions", f"""
SELECT user_id, product_id, confidence_score, n_views, n_carts, n_purchases, {TIME.format('first_interaction')} AS first_interaction,
       {TIME.format('last_interaction')} AS last_interaction FROM im""")
def _(t):
    return t.im.withColumns({c: time_text(c) for c in ("first_interaction", "last_interaction")})


@query("agg_01_interactions_clean", """
SELECT user_id, product_id, CAST(4 * count(*) FILTER (event_type = 'purchase') + 2 * count(*) FILTER (event_type = 'cart')
       + count(*) FILTER (event_type = 'view') AS BIGINT) AS confidence_score FROM cleaned GROUP BY 1, 2""")
def _(t):
    return tables.interactions(clean.clean(t.clicks, CFG, core=False)).select("user_id", "product_id", "confidence_score")


@query("agg_02_monthly_volume", f"""
SELECT strftime(event_time, '%Y-%m') AS month, count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT product_id) AS unique_products, {VIEW} AS views, {CART} AS carts, {BUY} AS purchases,
       {pct_sql(CART)} AS cart_rate_pct, {pct_sql(BUY)} AS purchase_rate_pct FROM baskets GROUP BY 1""")
def _(t):
    return eda.monthly_volume(t.baskets)


NULLABLE = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")


@query("agg_03_null_audit", f"""
SELECT count(*) AS total_rows, {', '.join(f"{filt(c + ' IS NULL')} AS null_{c}" for c in NULLABLE)},
       {', '.join(f"{pct_sql(filt(c + ' IS NULL'))} AS pct_null_{c}" for c in ('category_code', 'brand', 'price', 'user_session'))},
       {filt('category_code IS NULL AND brand IS NULL')} AS null_both_cat_brand,
       {filt('category_code IS NULL AND brand IS NOT NULL')} AS null_cat_only,
       {filt('category_code IS NOT NULL AND brand IS NULL')} AS null_brand_only FROM clicks""")
def _(t):
    return eda.null_audit(t.clicks)


@query("agg_04_null_by_type", f"""
SELECT event_type, count(*) AS total,
       {', '.join(f"{pct_sql(filt(c + ' IS NULL'))} AS pct_null_{c}" for c in ('category_code', 'brand', 'price'))}
FROM clicks GROUP BY 1""")
def _(t):
    return eda.null_by_type(t.clicks)


KEY = ("CAST(event_time AS VARCHAR) || '|' || event_type || '|' || CAST(product_id AS VARCHAR) || '|' || "
       "CAST(user_id AS VARCHAR) || '|' || coalesce(user_session, 'NULL')")


@query("agg_05_dup_count", f"""
SELECT count(*) AS total_rows, count(*) - count(DISTINCT {KEY}) AS exact_duplicate_rows,
       round((count(*) - count(DISTINCT {KEY})) / count(*) * 100, 4) AS exact_dupe_pct FROM clicks""")
def _(t):
    return eda.dup_count(t.clicks)


@query("agg_06_near_dup_counts", """
WITH g AS (SELECT epoch(date_trunc('second', event_time)) - lag(epoch(date_trunc('second', event_time))) OVER (
  PARTITION BY user_id, product_id, event_type ORDER BY event_time) AS gap FROM clicks)
SELECT count(*) AS total_rows, count(*) FILTER (gap <= 1) AS near_dupe_within_1s, count(*) FILTER (gap <= 5) AS near_dupe_within_5s,
       count(*) FILTER (gap <= 30) AS near_dupe_within_30s, round(count(*) FILTER (gap <= 1) / count(*) * 100, 4) AS pct_near_dupe_1s FROM g""")
def _(t):
    return clean.near_dup_counts(t.clicks)


def q(col: str, p: float, digits: int = 6) -> str:
    return f"round(quantile_cont({col}, {p}), {digits})"


@query("agg_07_price_percentiles", f"""
SELECT round(min(price), 6) AS price_min, round(max(price), 6) AS price_max, round(avg(price), 6) AS price_mean,
       {', '.join(f"{q('price', p)} AS p{round(p * 100)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0))},
       {filt('price IS NULL')} AS null_price_count, {filt('price <= 0')} AS zero_or_negative_price,
       {filt('price > 10000')} AS price_gt_10k, {filt('price > 50000')} AS price_gt_50k FROM baskets""")
def _(t):
    out = eda.price_percentiles(t.baskets)
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


@query("agg_08_price_buckets", """
SELECT CASE WHEN price IS NULL THEN 'NULL' WHEN price <= 0 THEN '<=0' WHEN price < 1 THEN '0-1' WHEN price < 10 THEN '1-10'
            WHEN price < 50 THEN '10-50' WHEN price < 100 THEN '50-100' WHEN price < 500 THEN '100-500'
            WHEN price < 1000 THEN '500-1k' WHEN price < 5000 THEN '1k-5k' WHEN price < 10000 THEN '5k-10k' ELSE '>10k' END AS price_bucket,
       count(*) AS event_count, count(DISTINCT product_id) AS unique_products FROM clicks GROUP BY 1""")
def _(t):
    return eda.price_buckets(t.clicks)


@query("agg_09_user_activity_buckets", binned_sql("user_id", fn.USER_BINS, "total_events_bucket", "user_count", "baskets"))
def _(t):
    return eda.user_activity_buckets(t.baskets)


@query("agg_09_user_activity_buckets_short", binned_sql("user_id", fn.USER_BINS_SHORT, "total_events_bucket", "user_count", "baskets"))
def _(t):
    return eda.user_activity_buckets_short(t.baskets)


@query("agg_10_epd_buckets", f"""
SELECT {case_at_most('n', fn.PER_DAY_BINS)} AS epd_bucket, count(*) AS user_count FROM (
  SELECT user_id, count(*) / count(DISTINCT CAST(event_time AS DATE)) AS n FROM baskets GROUP BY 1) GROUP BY 1""")
def _(t):
    return eda.epd_buckets(t.baskets)


VIABILITY = """
SELECT CAST(k AS INT) AS min_interactions, count(*) AS users_surviving,
       round(count(*) / max(count(*)) OVER () * 100, 2) AS pct_surviving
FROM (SELECT user_id, count(*) AS n FROM baskets GROUP BY 1), (SELECT unnest([1, 2, 3, 5, 10, 20]) AS k) WHERE n >= k GROUP BY 1"""


@query("agg_11_core_viability", VIABILITY)
def _(t):
    return eda.core_viability(t.baskets)


@query("agg_12_core_marginal", f"""
SELECT * FROM (SELECT lag(min_interactions) OVER w AS k_from, min_interactions AS k_to,
  lag(users_surviving) OVER w - users_surviving AS users_lost, round(lag(pct_surviving) OVER w - pct_surviving, 2) AS pct_lost,
  min_interactions - lag(min_interactions) OVER w AS k_units FROM ({VIABILITY}) WINDOW w AS (ORDER BY min_interactions))
WHERE k_from IS NOT NULL""")
def _(t):
    return eda.core_marginal(eda.core_viability(t.baskets))


@query("agg_13_item_activity_buckets", binned_sql("product_id", fn.ITEM_BINS, "event_count_bucket", "product_count", "clicks"))
def _(t):
    return eda.item_activity_buckets(t.clicks)


@query("agg_13_item_activity_buckets_short", binned_sql("product_id", fn.ITEM_BINS_SHORT, "event_count_bucket", "product_count", "clicks"))
def _(t):
    return eda.item_activity_buckets_short(t.clicks)


@query("agg_14_top_products", f"""
SELECT product_id, count(*) AS total_events, {VIEW} AS views, {CART} AS carts, {BUY} AS purchases, count(DISTINCT user_id) AS unique_users,
       max(brand) AS brand, max(category_code) AS category_code, round(avg(price), 2) AS avg_price
FROM baskets GROUP BY 1 ORDER BY total_events DESC, product_id LIMIT 100""")
def _(t):
    return eda.top_products(t.baskets)


@query("agg_15_session_length_buckets", f"""
SELECT {case_at_most('n', fn.SESSION_BINS)} AS session_length_bucket, count(*) AS session_count,
       round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM (SELECT user_session, count(*) AS n FROM clicks WHERE user_session IS NOT NULL GROUP BY 1) GROUP BY 1""")
def _(t):
    return eda.session_length_buckets(t.clicks)


@query("agg_15_session_length_buckets_short", binned_sql("user_session", fn.SESSION_BINS_SHORT, "bucket", "n_sessions", "clicks", "user_session IS NOT NULL"))
def _(t):
    return eda.session_length_buckets_short(t.clicks)


cte("session_spans", """
SELECT user_session, CAST(epoch(date_trunc('second', max(event_time))) - epoch(date_trunc('second', min(event_time))) AS BIGINT) AS seconds
FROM clicks WHERE user_session IS NOT NULL GROUP BY 1""")


@query("agg_16_session_duration", f"""
SELECT {', '.join(f"{q('m', p)} AS p{round(p * 100)}_min" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))}, round(avg(m), 6) AS mean_min,
       {filt('m = 0')} AS zero_duration_sessions, {filt('m > 60')} AS sessions_over_1hr, {filt('m > 480')} AS sessions_over_8hr
FROM (SELECT seconds // 60 AS m FROM session_spans)""")
def _(t):
    return eda.session_duration(t.clicks)


@query("agg_17_sessions_per_user", f"""
SELECT {', '.join(f"{q('s', p)} AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99))}, round(avg(s), 6) AS mean, max(s) AS max_sessions
FROM (SELECT user_id, count(DISTINCT user_session) AS s FROM baskets WHERE user_session IS NOT NULL GROUP BY 1)""")
def _(t):
    return eda.sessions_per_user(t.baskets)


@query("agg_18_user_funnel", f"""
SELECT count(*) AS total_users, {filt('v > 0')} AS users_with_views, {filt('c > 0')} AS users_with_carts, {filt('p > 0')} AS users_with_purchases,
       {filt('v > 0 AND c = 0 AND p = 0')} AS view_only_users, {filt('c > 0 AND p = 0')} AS carted_never_purchased, {filt('p > 0')} AS ever_purchased,
       {pct_sql(filt('c > 0'))} AS pct_users_carted, {pct_sql(filt('p > 0'))} AS pct_users_purchased
FROM (SELECT user_id, {VIEW} AS v, {CART} AS c, {BUY} AS p FROM baskets GROUP BY 1)""")
def _(t):
    return eda.user_funnel(t.baskets)


@query("agg_19_conversion_stats", f"""
SELECT {', '.join(f"{q('r', p)} AS p{round(p * 100)}_conv" for p in (0.25, 0.5, 0.75, 0.9))}, round(avg(r), 6) AS mean_conv,
       {filt('r = 0')} AS zero_conversion_products, {filt('r = 1')} AS full_conversion_products
FROM (SELECT product_id, {BUY} / {VIEW} AS r FROM baskets GROUP BY 1 HAVING {VIEW} >= 10)""")
def _(t):
    return eda.conversion_stats(t.baskets)


cte("monthly_users", "SELECT DISTINCT strftime(event_time, '%Y-%m') AS month, user_id FROM baskets")


def overlap_sql(op: str) -> str:
    return f"""SELECT a.month AS month_a, b.month AS month_b, count(DISTINCT a.user_id) AS shared_users
FROM monthly_users a JOIN monthly_users b USING (user_id) WHERE a.month {op} b.month GROUP BY 1, 2"""


@query("agg_20_month_overlap", overlap_sql("<"))
def _(t):
    return eda.month_overlap(t.baskets)




@query("agg_21_overlap_matrix", """
WITH u AS (SELECT DISTINCT CAST(year(event_time) AS VARCHAR) || '-01' AS month, user_id FROM baskets),
     s AS (SELECT a.month AS month_a, b.month AS month_b, count(*)::DOUBLE AS n FROM u a JOIN u b USING (user_id) GROUP BY 1, 2)
SELECT month_a, """ + ", ".join(f"max(n) FILTER (month_b = '{y}-01') AS \"{y}-01\"" for y in range(1995, 2002)) + " FROM s GROUP BY 1")
def _(t):
    yearly = t.baskets.withColumn("event_time", F.date_trunc("year", "event_time"))
    return eda.overlap_matrix(yearly, [f"{y}-01" for y in range(1995, 2002)])


@query("agg_22_category_l1", """
SELECT split_part(category_code, '.', 1) AS top_level_category, count(*) AS events, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT user_id) AS unique_users, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct_events
FROM clicks WHERE category_code IS NOT NULL GROUP BY 1 ORDER BY events DESC, 1 LIMIT 30""")
def _(t):
    return eda.category_l1(t.clicks)


@query("agg_23_category_drill", """
SELECT category_code, count(*) AS events, count(DISTINCT brand) AS brands, round(avg(price), 2) AS avg_price, count(DISTINCT product_id) AS products
FROM baskets WHERE split_part(category_code, '.', 1) = 'economy' GROUP BY 1 ORDER BY events DESC, 1 LIMIT 20""")
def _(t):
    return eda.category_drill(t.baskets, "economy")


@query("agg_24_category_depth", """
SELECT CAST(len(string_split(category_code, '.')) AS INT) AS depth, count(*) AS event_count, count(DISTINCT product_id) AS unique_products
FROM clicks WHERE category_code IS NOT NULL GROUP BY 1""")
def _(t):
    return eda.category_depth(t.clicks)


@query("agg_25_null_category", """
SELECT category_code IS NULL AS cat_code_is_null, count(*) AS events, count(DISTINCT category_id) AS unique_category_ids,
       count(DISTINCT product_id) AS unique_products, round(avg(price), 2) AS avg_price FROM clicks GROUP BY 1""")
def _(t):
    return eda.null_category(t.clicks)


@query("agg_26_top_brands", f"""
SELECT brand, count(*) AS events, count(DISTINCT product_id) AS unique_products, round(avg(price), 2) AS avg_price, {BUY} AS purchases
FROM clicks WHERE brand IS NOT NULL GROUP BY 1 ORDER BY events DESC, brand LIMIT 30""")
def _(t):
    return eda.top_brands(t.clicks)


@query("agg_27_active_months", """
SELECT active_months, count(*) AS user_count, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM (SELECT user_id, count(*) AS active_months FROM monthly_users GROUP BY 1) GROUP BY 1""")
def _(t):
    return eda.active_months(t.baskets)


@query("agg_28_repeat_purchase", f"""
SELECT {case_at_most('n', fn.PURCHASE_BINS)} AS purchase_count_bucket, count(*) AS user_count,
       round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM (SELECT user_id, count(*) AS n FROM baskets WHERE event_type = 'purchase' GROUP BY 1) GROUP BY 1""")
def _(t):
    return eda.repeat_purchase(t.baskets)


@query("agg_29_new_vs_returning", """
SELECT m.month, count(*) AS active_users, count(*) FILTER (f.month IS NOT NULL) AS new_users, count(*) FILTER (f.month IS NULL) AS returning_users,
       round(count(*) FILTER (f.month IS NOT NULL) / count(*) * 100, 2) AS pct_new
FROM monthly_users m LEFT JOIN (SELECT user_id, min(month) AS month FROM monthly_users GROUP BY 1) f
  ON f.user_id = m.user_id AND f.month = m.month GROUP BY 1""")
def _(t):
    return eda.new_vs_returning(t.baskets)


@query("agg_30_event_mix", "SELECT event_type, count(*) AS n_events FROM clicks GROUP BY 1")
def _(t):
    return eda.event_mix(t.clicks)


def summary_sql(col: str) -> str:
    return (f"min({col})::DOUBLE AS min, max({col})::DOUBLE AS max, round(avg({col}), 6) AS mean, "
            + ", ".join(f"{q(col, p)} AS p{round(p * 100)}" for p in eda.SUMMARY_POINTS))


@query("agg_31_price_summary", f"SELECT {summary_sql('price')} FROM clicks")
def _(t):
    return eda.summary(t.clicks, "price")


@query("agg_31_activity_summary", "\nUNION ALL ".join(
    f"SELECT '{per}' AS per, {summary_sql('n')} FROM (SELECT {key}, count(*) AS n FROM baskets GROUP BY 1)"
    for per, key in (("user", "user_id"), ("item", "product_id"), ("session", "user_session"))))
def _(t):
    return eda.activity_summary(t.baskets)


@query("agg_32_price_floor_audit", f"""
SELECT count(*) AS total_rows, {filt('price <= 0')} AS zero_or_negative, {pct_sql(filt('price <= 0'))} AS zero_pct,
       {filt('price < 1')} AS below_1, {pct_sql(filt('price < 1'))} AS below_1_pct FROM clicks""")
def _(t):
    return eda.price_floor_audit(t.clicks)


@query("agg_33_hourly", "SELECT CAST(hour(event_time) AS INT) AS hour, count(*) AS n_events FROM clicks GROUP BY 1")
def _(t):
    return eda.hourly(t.clicks)


@query("agg_34_daily", "SELECT dayname(event_time) AS day_of_week, count(*) AS n_events FROM clicks GROUP BY 1")
def _(t):
    return eda.daily(t.clicks)


@query("agg_35_load_sanity", f"""
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products, {VIEW} AS views, {CART} AS carts,
       {BUY} AS purchases, {TIME.format('min(event_time)')} AS min_time, {TIME.format('max(event_time)')} AS max_time FROM clicks""")
def _(t):
    return tables.load_sanity(t.clicks).withColumns({c: time_text(c) for c in ("min_time", "max_time")})


@query("agg_36_split_report", """
WITH r AS (SELECT (SELECT count(*) FROM btrain) AS train_rows, (SELECT count(*) FROM btest) AS test_rows,
  (SELECT count(DISTINCT user_id) FROM btrain) AS train_users, (SELECT count(DISTINCT user_id) FROM btest) AS test_users,
  (SELECT count(*) FROM (SELECT DISTINCT user_id FROM btrain INTERSECT SELECT DISTINCT user_id FROM btest)) AS overlap_users)
SELECT *, round(overlap_users / test_users * 100, 4) AS overlap_pct,
       CASE WHEN round(overlap_users / test_users * 100, 4) BETWEEN 65 AND 85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def _(t):
    return tables.split_report(t.train, t.test)


@query("agg_37_interaction_report", f"""
WITH r AS (SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS items,
  round(avg(confidence_score), 4) AS avg_score, max(confidence_score) AS max_score,
  round({filt('confidence_score = 1')} * 100 / count(*), 4) AS pct_score_1, round({filt('confidence_score = 2')} * 100 / count(*), 4) AS pct_score_2,
  round({filt('confidence_score >= 4')} * 100 / count(*), 4) AS pct_score_4_up FROM im)
SELECT *, round((1 - pairs / (users::DOUBLE * items)) * 100, 6) AS sparsity_pct,
       CASE WHEN (1 - pairs / (users::DOUBLE * items)) * 100 > 99 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def _(t):
    return tables.interaction_report(t.im)


VALID = {"total_rows": (5_000, 20_000), "unique_users": (100, 200), "unique_items": (50, 90)}


def check_sql(name: str, value: str, cond: str | None) -> str:
    status = f"CASE WHEN ({value}) {cond} THEN 'PASS' ELSE 'FAIL' END" if cond else "'INFO'"
    return f"SELECT '{name}' AS check_name, CAST(({value}) AS BIGINT) AS actual, {status} AS status FROM cleaned"


@query("agg_38_validate_clean", "\nUNION ALL ".join([
    check_sql("total_rows", "count(*)", "BETWEEN 5000 AND 20000"), check_sql("unique_users", "count(DISTINCT user_id)", "BETWEEN 100 AND 200"),
    check_sql("unique_items", "count(DISTINCT product_id)", "BETWEEN 50 AND 90"), check_sql("price_below_1", filt("price < 1"), "= 0"),
    check_sql("null_user_session", filt("user_session IS NULL"), "= 0"), check_sql("null_category_code", filt("category_code IS NULL"), "= 0"),
    check_sql("null_brand", filt("brand IS NULL"), "= 0"), check_sql("views", VIEW, None), check_sql("carts", CART, None),
    check_sql("purchases", BUY, None), check_sql("min_event_second", "epoch(date_trunc('second', min(event_time)))", None),
    check_sql("max_event_second", "epoch(date_trunc('second', max(event_time)))", None),
    f"""SELECT 'bot_user_count', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT user_id FROM (
      SELECT user_id, CAST(event_time AS DATE) AS d, count(*) AS n FROM cleaned GROUP BY 1, 2) GROUP BY 1 HAVING avg(n) > {BOT_PER_DAY})"""]))
def _(t):
    return tables.validate_clean(clean.clean(t.clicks, CFG, core=False), VALID, BOT_PER_DAY)


@query("agg_39_item_feature_nulls", f"""
SELECT count(*) AS n_items, CASE WHEN count(*) > 1000 AND count(*) < 3000 THEN 'PASS' ELSE 'FAIL' END AS size_check,
       {', '.join(f"{filt(c + ' IS NULL')} AS null_{c}" for c in ('cat_l1', 'cat_l2', 'brand', 'avg_price', 'item_total_confidence', 'item_purchase_rate'))}
FROM itemf""")
def _(t):
    return features.item_feature_nulls(t.item_features, 1000, 3000)


@query("agg_39_price_bucket_counts", "SELECT price_bucket, count(*) AS n_items FROM itemf GROUP BY 1")
def _(t):
    return features.price_bucket_counts(t.item_features)


ENDS = ("total_events", "months_active", "purchase_rate", "peak_hour_bucket", "preferred_dow", "has_purchase_history")


@query("agg_40_validate_user_features", f"""
SELECT count(*) AS n_users, {', '.join(f"{p}({c}) AS {p}_{c}" for c in ENDS for p in ('min', 'max'))},
       round(min(avg_purchase_price), 4) AS min_avg_purchase_price, round(max(avg_purchase_price), 4) AS max_avg_purchase_price,
       round(avg(total_events), 1) AS avg_events, {filt('total_events IS NULL')} AS null_event_count, {filt('top_category IS NULL')} AS null_top_category,
       min(peak_hour_bucket) >= 0 AND max(peak_hour_bucket) <= 3 AND min(preferred_dow) >= 1 AND max(preferred_dow) <= 7
         AND {filt('total_events IS NULL')} = 0 AS in_range FROM userf""")
def _(t):
    out = features.validate_user_features(t.user_features)
    return out.withColumns({c: F.round(c, 4) for c in ("min_avg_purchase_price", "max_avg_purchase_price")})


cte("l2_bins", "SELECT cat_l2, count(*) AS item_count FROM itemf GROUP BY 1")


@query("agg_41_category_bins", "SELECT cat_l2, item_count, round(item_count / sum(item_count) OVER () * 100, 4) AS pct FROM l2_bins")
def _(t):
    return eda.category_bins(t.item_features, "cat_l2")


@query("agg_41_category_bins_l1", "SELECT cat_l1, count(*) AS item_count, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM itemf GROUP BY 1")
def _(t):
    return eda.category_bins(t.item_features, "cat_l1")


@query("agg_41_category_bin_stats", f"""
SELECT count(*)::BIGINT AS n_bins, round(avg(item_count), 6) AS mean, min(item_count) AS min, max(item_count) AS max,
       {', '.join(f"{q('item_count', p)} AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))},
       {filt('item_count < 50')} AS bins_under_50, {filt('item_count < 10')} AS bins_under_10 FROM l2_bins""")
def _(t):
    return eda.category_bin_stats(t.item_features, "cat_l2")


# --------------------------------------------------------------------------- windows


@query("win_01_lag", f"""
SELECT event_id, {TIME.format('event_time')} AS event_time, {TIME.format('prev')} AS previous_time FROM (
  SELECT *, lag(event_time) OVER (PARTITION BY user_id, product_id, event_type ORDER BY event_time, event_id) AS prev FROM baskets)""")
def _(t):
    out = scale.with_previous(t.baskets, ["user_id", "product_id", "event_type"], "event_time", ["event_id"], {"previous_time": "event_time"})
    return out.select("event_id", time_text("event_time").alias("event_time"), time_text("previous_time").alias("previous_time"))


cte("user_cats", "SELECT t.user_id, f.cat_l1, count(*) AS n_events FROM btrain t JOIN itemf f USING (product_id) GROUP BY 1, 2")
cte("top_cats", """SELECT user_id, cat_l1, n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_events DESC, cat_l1) AS rn FROM user_cats) WHERE rn = 1""")


@query("win_02_top_category", "SELECT user_id, cat_l1 AS top_category, n_events FROM top_cats")
def _(t):
    return features.top_category(t.train, t.item_features)


@query("win_03_hashed_rank", "SELECT user_id, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn FROM (SELECT DISTINCT user_id FROM baskets)")
def _(t):
    users = t.baskets.select("user_id").distinct().withColumn("_h", F.md5(F.col("user_id").cast("string")))
    return scale.add_position(users, [F.col("_h"), F.col("user_id")], "rn").drop("_h")


@query("win_04_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share FROM clicks GROUP BY 1")
def _(t):
    return eda.with_share(eda.count_per(t.clicks, "event_type", "n"), "n", "share", 4)


@query("win_05_share_of_max", "SELECT event_type, count(*) AS n, round(count(*) / max(count(*)) OVER () * 100, 4) AS share FROM clicks GROUP BY 1")
def _(t):
    return eda.with_share(eda.count_per(t.clicks, "event_type", "n"), "n", "share", 4, F.max("n"))


@query("win_06_cumulative_share", """
SELECT product_id, n, running::BIGINT AS running, round(running / (SELECT sum(n) FROM (SELECT count(*) AS n FROM baskets GROUP BY product_id)), 6) AS share FROM (
  SELECT product_id, n, sum(n) OVER (ORDER BY n DESC, product_id ROWS UNBOUNDED PRECEDING) AS running FROM (
    SELECT product_id, count(*) AS n FROM baskets GROUP BY 1))""")
def _(t):
    counts = eda.count_per(t.baskets, "product_id", "n")
    out = scale.add_running_total(counts, [F.desc("n"), F.asc("product_id")], "n", "running")
    return out.withColumn("share", F.round(F.col("running") / counts.agg(F.sum("n").alias("t")).scalar(), 6))


@query("win_08_group_mean", """
SELECT product_id, avg_price, round(avg(avg_price) OVER (PARTITION BY cat_l2), 6) AS category_mean FROM itemf""")
def _(t):
    means = t.item_features.groupBy("cat_l2").agg(F.round(F.avg("avg_price"), 6).alias("category_mean"))
    return scale.salted_join(t.item_features, means, ["cat_l2"]).select("product_id", "avg_price", "category_mean")


@query("win_11_previous_in_session", """
SELECT event_id, lag(product_id) OVER (PARTITION BY user_session ORDER BY event_time, event_id, product_id) AS previous_item FROM baskets""")
def _(t):
    return scale.with_previous(t.baskets, ["user_session"], "event_time", ["event_id", "product_id"], {"previous_item": "product_id"}).select("event_id", "previous_item")


@query("win_12_last_n", """
SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS rn FROM baskets) WHERE rn <= 5""")
def _(t):
    return scale.top_per_key(t.baskets, ["user_id"], [F.desc("event_time"), F.desc("event_id")], 5, "rn").select("user_id", "event_id", "rn")


@query("win_13_popularity_rank", """
SELECT item_idx, freq, row_number() OVER (ORDER BY freq DESC, item_idx) AS pop_rank FROM (SELECT item_idx, count(*) AS freq FROM tp GROUP BY 1)""")
def _(t):
    return scale.add_position(eda.count_per(t.pairs_once, "item_idx", "freq"), [F.desc("freq"), F.asc("item_idx")], "pop_rank")


@query("win_15_next_item", """
SELECT event_id, lead(product_id) OVER (PARTITION BY user_session ORDER BY event_time, event_id, product_id) AS next_item FROM baskets""")
def _(t):
    # The next event is the previous one of the reversed order.
    back = t.baskets.withColumns({"_back": F.timestamp_micros(-F.unix_micros("event_time")), "_tie": -F.col("event_id"), "_tie2": -F.col("product_id")})
    return scale.with_previous(back, ["user_session"], "_back", ["_tie", "_tie2"], {"next_item": "product_id"}).select("event_id", "next_item")


# --------------------------------------------------------------------------- sorts and top-k


@query("top_01_top_n", "SELECT product_id, count(*) AS n FROM baskets GROUP BY 1 ORDER BY n DESC, product_id LIMIT 30")
def _(t):
    return eda.count_per(t.baskets, "product_id", "n").orderBy(F.desc("n"), "product_id").limit(30)


@query("top_02_bin_order", f"""
SELECT *, CASE total_events_bucket {' '.join(f"WHEN '{label}' THEN {i}" for i, (_, label) in enumerate(fn.USER_BINS, 1))} END::BIGINT AS bin_order
FROM ({binned_sql('user_id', fn.USER_BINS, 'total_events_bucket', 'user_count', 'baskets')})""")
def _(t):
    out = eda.user_activity_buckets(t.baskets)
    return out.withColumn("bin_order", fn.bin_order("total_events_bucket", fn.USER_BINS))


@query("top_03_stable_sort", "SELECT event_id, row_number() OVER (ORDER BY user_id, event_time, event_id) AS position FROM baskets")
def _(t):
    order = [F.col(c) for c in ("user_id", "event_time", "event_id")]
    return scale.add_position(t.baskets.select("user_id", "event_time", "event_id"), order).select("event_id", "position")


@query("top_04_top_k_per_user", """
SELECT user_idx, item_idx, rank FROM (SELECT user_idx, item_idx, row_number() OVER (PARTITION BY user_idx ORDER BY confidence_score DESC, item_idx) AS rank FROM tp) WHERE rank <= 20""")
def _(t):
    return scale.top_per_key(t.pairs_once, ["user_idx"], [F.desc("confidence_score"), F.asc("item_idx")], 20).select("user_idx", "item_idx", "rank")


@query("top_05_head_and_tail", """
SELECT cat_l2, item_count, 'top' AS side FROM (SELECT * FROM l2_bins ORDER BY item_count DESC, cat_l2 LIMIT 5)
UNION ALL SELECT cat_l2, item_count, 'bottom' FROM (SELECT * FROM l2_bins ORDER BY item_count, cat_l2 LIMIT 5)""")
def _(t):
    return eda.head_and_tail(eda.category_bins(t.item_features, "cat_l2").drop("pct"), "item_count", "cat_l2", 5)


# --------------------------------------------------------------------------- set operations


@query("set_01_union_all", "SELECT 'a' AS stage, count(*) AS n FROM clicks UNION ALL SELECT 'b', count(*) FROM clicks WHERE price >= 1")
def _(t):
    a = t.clicks.agg(F.count(F.lit(1)).alias("n")).select(F.lit("a").alias("stage"), "n")
    b = clean.price_floor(t.clicks).agg(F.count(F.lit(1)).alias("n")).select(F.lit("b").alias("stage"), "n")
    return a.unionByName(b)


@query("set_02_mirrored", f"WITH o AS ({overlap_sql('<')}) SELECT * FROM o UNION ALL SELECT month_b, month_a, shared_users FROM o")
def _(t):
    return eda.mirrored(eda.month_overlap(t.baskets))


cte("session_sets", """
SELECT user_session, list(DISTINCT product_id) FILTER (event_type = 'view') AS viewed,
       list(DISTINCT product_id) FILTER (event_type IN ('cart', 'purchase')) AS positive
FROM ctrain WHERE user_session IS NOT NULL GROUP BY 1""")


@query("set_03_session_difference", """
SELECT DISTINCT v.user_session, v.product_id FROM ctrain v WHERE v.event_type = 'view' AND v.user_session IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM ctrain p WHERE p.user_session = v.user_session AND p.product_id = v.product_id AND p.event_type IN ('cart', 'purchase'))""")
def _(t):
    train = clean.drop_null_session(t.click_splits[0])
    viewed = train.where(F.col("event_type") == "view").select("user_session", "product_id").distinct()
    return viewed.join(clean.high_intent(train), ["user_session", "product_id"], "left_anti")


@query("set_04_intersection_size", """
SELECT count(*) AS shared_items FROM (SELECT DISTINCT product_id FROM btrain INTERSECT SELECT DISTINCT product_id FROM btest)""")
def _(t):
    shared = t.train.select("product_id").intersect(t.test.select("product_id"))
    return shared.agg(F.count(F.lit(1)).alias("shared_items"))


@query("set_05_difference_size", """
SELECT count(*) AS users_lost FROM (SELECT DISTINCT user_id FROM baskets EXCEPT SELECT DISTINCT user_id FROM btest)""")
def _(t):
    lost = t.baskets.select("user_id").distinct().join(t.test.select("user_id"), "user_id", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("users_lost"))


@query("set_06_distinct", "SELECT DISTINCT user_id, event_type FROM baskets")
def _(t):
    return t.baskets.select("user_id", "event_type").distinct()


@query("set_07_concat_frames", "SELECT 'clicks' AS log, event_type, count(*) AS n FROM clicks GROUP BY 2 UNION ALL SELECT 'baskets', event_type, count(*) FROM baskets GROUP BY 2")
def _(t):
    logs = [df.select(F.lit(n).alias("log"), "event_type") for n, df in (("clicks", t.clicks), ("baskets", t.baskets))]
    return reduce(lambda a, b: a.unionByName(b), logs).groupBy("log", "event_type").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- scalar functions


@query("scl_01_string", """
SELECT event_id, nullif(split_part(category_code, '.', 2), '') AS second_level, CASE WHEN category_code IS NULL THEN NULL ELSE '' END AS no_third,
       concat(event_type, '|', coalesce(user_session, 'NULL')) AS key, trim(lower(coalesce(brand, ''))) AS brand_lower,
       CAST(product_id AS VARCHAR) AS product_text FROM clicks""")
def _(t):
    return t.clicks.select(
        "event_id", fn.part_of("category_code", 1).alias("second_level"),
        F.when(F.col("category_code").isNotNull(), F.coalesce(fn.part_of("category_code", 2), F.lit(""))).alias("no_third"),
        F.concat("event_type", F.lit("|"), F.coalesce("user_session", F.lit("NULL"))).alias("key"),
        F.trim(F.lower(F.coalesce("brand", F.lit("")))).alias("brand_lower"), F.col("product_id").cast("string").alias("product_text"),
    )


@query("scl_04_brand_title", """
SELECT DISTINCT p_name AS raw, array_to_string(list_transform(string_split(CASE WHEN p_partkey % 3 = 0 THEN 'lg ' ELSE '' END || lower(p_name), ' '),
  lambda w: CASE WHEN w IN ('lg', 'tv') THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS title FROM part""")
def _(t):
    part = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    lead = F.when(F.col("p_partkey") % 3 == 0, "lg ").otherwise("")
    return part.select(F.col("p_name").alias("raw"), fn.brand_title(F.concat(lead, F.col("p_name"))).alias("title")).distinct()


@query("scl_06_leading_int", f"""
SELECT total_events_bucket, TRY_CAST(split_part(total_events_bucket, '-', 1) AS INT) AS low FROM (
{binned_sql('user_id', fn.USER_BINS, 'total_events_bucket', 'user_count', 'baskets')})""")
def _(t):
    return eda.user_activity_buckets(t.baskets).select("total_events_bucket", fn.leading_int("total_events_bucket").alias("low"))


@query("scl_10_dates", f"""
SELECT event_id, strftime(event_time, '%Y-%m') AS month, strftime(event_time, '%Y-%m-%d') AS day,
       CAST(epoch(date_trunc('second', TIMESTAMP '2024-02-01')) - epoch(date_trunc('second', event_time)) AS BIGINT) AS seconds_left,
       CAST(epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', event_time)) AS BIGINT) // 60 AS minutes_left,
       CAST(hour(event_time) AS INT) AS hour, CAST(dayofweek(event_time) + 1 AS INT) AS dow, dayname(event_time) AS day_name,
       round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(event_time)) / 86400000000, 6) AS days_left,
       year(event_time) = 2024 AND month(event_time) = 1 AS in_month FROM clicks""")
def _(t):
    from datetime import datetime

    from clickloom.sources.files import month_range

    cutoff = F.lit(datetime(2024, 2, 1)).cast("timestamp")
    left = F.unix_seconds(cutoff) - F.unix_seconds("event_time")
    return t.clicks.select(
        "event_id", fn.month_of("event_time").alias("month"), F.to_date("event_time").cast("string").alias("day"),
        left.alias("seconds_left"), F.floor(left / 60).alias("minutes_left"), F.hour("event_time").alias("hour"),
        F.dayofweek("event_time").alias("dow"), F.date_format("event_time", "EEEE").alias("day_name"),
        F.round((F.unix_micros(cutoff) - F.unix_micros("event_time")) / F.lit(86_400e6), 6).alias("days_left"),
        month_range(F.col("event_time"), "2024-01").alias("in_month"),
    )


@query("scl_20_math", """
SELECT event_id, round(price, 2) AS rounded, round(price / nullif(product_id % 3, 0), 6) AS safe_ratio, CAST(floor(price / 6) AS BIGINT) AS floored,
       round(ln(1 + price), 6) AS log1p, round(1 / log2(price + 2), 6) AS discount, round(ln(price + 1e-10), 6) AS ln,
       round(sin(price), 6) AS sin, round(cos(price), 6) AS cos, greatest(price - 50, 0.0) AS clipped, least(price, 50.0) AS capped FROM clicks""")
def _(t):
    p = F.col("price")
    return t.clicks.select(
        "event_id", F.round(p, 2).alias("rounded"), F.round(F.try_divide(p, F.col("product_id") % 3), 6).alias("safe_ratio"),
        F.floor(p / 6).alias("floored"), F.round(F.log1p(p), 6).alias("log1p"), F.round(1 / F.log2(p + 2), 6).alias("discount"),
        F.round(F.ln(p + 1e-10), 6).alias("ln"), F.round(F.sin(p), 6).alias("sin"), F.round(F.cos(p), 6).alias("cos"),
        F.greatest(p - 50, F.lit(0.0)).alias("clipped"), F.least(p, F.lit(50.0)).alias("capped"),
    )


@query("scl_30_conditional", f"""
SELECT user_id, count(*) AS n, CASE WHEN count(*) BETWEEN 3 AND 10 THEN 'cold' WHEN count(*) BETWEEN 11 AND 50 THEN 'medium' WHEN count(*) >= 51 THEN 'warm' END AS cohort,
       coalesce(max(brand), 'unknown') AS brand, {BUY} AS purchases, CASE WHEN avg(price) < 10 THEN 0 WHEN avg(price) < 50 THEN 1 WHEN avg(price) < 100 THEN 2
            WHEN avg(price) < 200 THEN 3 WHEN avg(price) < 500 THEN 4 WHEN avg(price) < 1000 THEN 5 WHEN avg(price) < 2000 THEN 6 ELSE 7 END AS price_level,
       CASE WHEN {BUY} / count(*) <= 0.5 THEN '<50%' WHEN {BUY} / count(*) <= 0.7 THEN '50-70%' WHEN {BUY} / count(*) <= 0.85 THEN '70-85%' ELSE '>85%' END AS share_cut
FROM baskets GROUP BY 1""")
def _(t):
    n = fn.n_rows()
    return t.baskets.groupBy("user_id").agg(
        n.alias("n"), fn.cohort(n).alias("cohort"), fn.known(F.max("brand")).alias("brand"), fn.count_type("purchase").alias("purchases"),
        fn.price_level(F.avg("price")).alias("price_level"), fn.at_most_label(fn.count_type("purchase") / n, [*fn.SHARE_CUTS[:-1], (None, ">85%")]).alias("share_cut"),
    )


@query("scl_40_arrays", """
SELECT user_idx, user_session, CAST(len(item_seq) AS INT) AS length, array_to_string(item_seq, ',') AS items, item_seq[-1] AS last_item,
       array_to_string(item_seq[:-2], ',') AS all_but_last, array_to_string(item_seq[-2:], ',') AS tail,
       array_to_string(list_concat(list_transform(range(greatest(7 - len(item_seq), 0)), lambda x: 0), item_seq[-7:]), ',') AS padded,
       CAST(len(list_distinct(item_seq)) AS INT) AS n_different FROM split_sessions WHERE split = 'train'""")
def _(t):
    return t.sessions["train"].select(
        "user_idx", "user_session", F.size("item_seq").alias("length"), fn.text_list("item_seq").alias("items"), F.element_at("item_seq", -1).alias("last_item"),
        fn.text_list(fn.init("item_seq")).alias("all_but_last"), fn.text_list(fn.tail("item_seq", 2)).alias("tail"),
        fn.text_list(fn.left_pad("item_seq", 7)).alias("padded"), F.size(F.array_distinct("item_seq")).alias("n_different"),
    )


@query("scl_41_unnest", "SELECT k, count(*) FILTER (n >= k) AS users FROM (SELECT count(*) AS n FROM baskets GROUP BY user_id), (SELECT CAST(unnest([1, 10, 20, 40]) AS INT) AS k) GROUP BY 1")
def _(t):
    counts = eda.count_per(t.baskets, "user_id", "n").withColumn("k", F.explode(F.array(*map(F.lit, (1, 10, 20, 40)))))
    return counts.groupBy("k").agg(F.count_if(F.col("n") >= F.col("k")).alias("users"))


@query("scl_47_vectors", """
SELECT item_idx, round(list_dot_product(vec, vec), 5) AS dot, round(sqrt(list_dot_product(vec, vec)), 5) AS norm, round(list_avg(vec), 5) AS mean FROM vecs""")
def _(t):
    v = F.transform("vec", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size("vec")
    return t.vectors.select("item_idx", F.round(fn.dot("vec", "vec"), 5).alias("dot"), F.round(fn.norm("vec"), 5).alias("norm"), F.round(mean, 5).alias("mean"))


@query("scl_46_sets", """
SELECT user_id, array_to_string(list_sort(list(DISTINCT category_code)), ',') AS categories, count(DISTINCT brand) AS brands FROM baskets GROUP BY 1""")
def _(t):
    sets = t.baskets.groupBy("user_id").agg(F.array_sort(F.collect_set("category_code")).alias("categories"), F.size(F.collect_set("brand")).cast("long").alias("brands"))
    return sets.select("user_id", F.array_join("categories", ",").alias("categories"), "brands")


@query("scl_46_bitmaps", "SELECT year(event_time) AS year, count(DISTINCT user_id) AS users FROM baskets GROUP BY 1")
def _(t):
    return fn.distinct_by_bitmap(t.baskets.withColumn("year", F.year("event_time")), ["year"], "user_id", "users")


@query("scl_47_mean_vectors", """
SELECT grp, CAST(i - 1 AS INT) AS dim, round(avg(vec[i]), 6) AS mean, round(sum(vec[i]), 5) AS total FROM (SELECT item_idx % 10 AS grp, vec FROM vecs), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2""")
def _(t):
    out = t.vectors.groupBy((F.col("item_idx") % 10).alias("grp")).agg(fn.mean_vector("vec").alias("m"), fn.sum_vector("vec").alias("s"))
    flat = out.select("grp", F.posexplode(F.arrays_zip("m", "s")).alias("dim", "v"))
    return flat.select("grp", "dim", F.round("v.m", 6).alias("mean"), F.round("v.s", 5).alias("total"))


@query("scl_50_hash", "SELECT user_id, md5(CAST(user_id AS VARCHAR)) AS fingerprint, ('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|3'), 1, 15))::BIGINT AS draw FROM (SELECT DISTINCT user_id FROM baskets)")
def _(t):
    users = t.baskets.select("user_id").distinct()
    return users.select("user_id", F.md5(F.col("user_id").cast("string")).alias("fingerprint"), scale.draw(3, "user_id").alias("draw"))


@query("scl_60_statistics", """
SELECT round(corr(avg_price, item_purchase_rate), 6) AS corr, round(stddev_samp(avg_price), 6) AS std, round(stddev_pop(avg_price), 6) AS std_pop,
       round(avg(avg_price), 6) AS mean, round(quantile_cont(avg_price, 0.9), 6) AS p90, round(median(avg_price), 6) AS p50 FROM itemf""")
def _(t):
    f = t.item_features
    row = f.agg(F.round(F.corr("avg_price", "item_purchase_rate"), 6).alias("corr"), F.round(F.stddev_samp("avg_price"), 6).alias("std"),
                F.round(F.stddev_pop("avg_price"), 6).alias("std_pop"), F.round(F.avg("avg_price"), 6).alias("mean"))
    points = scale.percentiles(f, "avg_price", [0.5, 0.9])
    return scale.beside(row, points.select(*[F.round(c, 6).alias(c) for c in points.columns]))
