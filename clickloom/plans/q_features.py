"""Join, feature, encoding and feature-verification queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clickloom import scale
from clickloom.functions import n_rows, text_list
from clickloom.operators import clean, drift, eda, features, recommend, verify
from clickloom.plans.q_clean import BOT_PER_DAY, CFG
from clickloom.plans.registry import cte, query

DIM = 64


def rounded(df, digits: int = 6):
    """Round every double so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# --------------------------------------------------------------------------- joins


@query("jn_01_inner", "SELECT f.cat_l1, count(*) AS n, count(DISTINCT t.user_id) AS users FROM btrain t JOIN itemf f USING (product_id) GROUP BY 1")
def _(t):
    # The dimension is small per key but a category may hold most rows, so the item key is salted.
    joined = scale.salted_join(t.train.select("user_id", "product_id", "event_id"), t.item_features.select("product_id", "cat_l1"), ["product_id"], "inner")
    return joined.groupBy("cat_l1").agg(n_rows().alias("n"), F.count_distinct("user_id").alias("users"))


@query("jn_02_left_anti", "SELECT event_id, user_id FROM floored WHERE user_id NOT IN (SELECT user_id FROM bots)")
def _(t):
    floored = clean.clean_steps(t.clicks, CFG)["price_floor"]
    return floored.join(clean.bot_users(floored, BOT_PER_DAY).select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


@query("jn_03_left_semi", "SELECT event_id FROM baskets WHERE product_id IN (SELECT product_id FROM baskets GROUP BY 1 HAVING count(*) >= 32)")
def _(t):
    keys = eda.count_per(t.baskets, "product_id", "n").where("n >= 32").select("product_id")
    return t.baskets.join(keys, "product_id", "left_semi").select("event_id")


@query("jn_04_two_key_semi", """
SELECT event_id, user_id, product_id FROM baskets WHERE user_id IN (SELECT user_id FROM baskets GROUP BY 1 HAVING count(*) >= 42)
  AND product_id IN (SELECT product_id FROM baskets GROUP BY 1 HAVING count(*) >= 32)""")
def _(t):
    users = eda.count_per(t.baskets, "user_id", "n").where("n >= 42").select("user_id")
    items = eda.count_per(t.baskets, "product_id", "n").where("n >= 32").select("product_id")
    return t.baskets.join(users, "user_id", "left_semi").join(items, "product_id", "left_semi").select("event_id", "user_id", "product_id")


@query("jn_05_left_default", "SELECT p.p_partkey AS product_id, coalesce(b.n, 0) AS n FROM part p LEFT JOIN (SELECT product_id, count(*) AS n FROM clicks GROUP BY 1) b ON b.product_id = p.p_partkey")
def _(t):
    part = t.spark.read.parquet(f"{t.sf_dir}/part.parquet").select(F.col("p_partkey").alias("product_id"))
    return part.join(eda.count_per(t.clicks, "product_id", "n"), "product_id", "left").fillna(0, ["n"])


@query("jn_06_left_first", "SELECT DISTINCT b.user_id, c.cat_l1 FROM baskets b LEFT JOIN top_cats c ON c.user_id = b.user_id")
def _(t):
    top = features.top_category(t.train, t.item_features).select("user_id", F.col("top_category").alias("cat_l1"))
    return t.baskets.select("user_id").distinct().join(top, "user_id", "left")


@query("jn_07_theta_self", """
SELECT a.month AS month_a, b.month AS month_b, count(DISTINCT a.user_id) AS shared_users FROM monthly_users a JOIN monthly_users b USING (user_id)
WHERE a.month <= b.month GROUP BY 1, 2""")
def _(t):
    return eda.month_overlap(t.baskets, diagonal=True)


@query("jn_08_thresholds", """
SELECT k AS min_interactions, count(*) AS items_surviving FROM (SELECT count(*) AS n FROM baskets GROUP BY product_id),
  (SELECT CAST(unnest([1, 10, 25, 30, 40]) AS INT) AS k) WHERE n >= k GROUP BY 1""")
def _(t):
    # A literal list fans out by explode; no join is needed.
    counts = eda.count_per(t.baskets, "product_id", "n").withColumn("min_interactions", F.explode(F.array(*map(F.lit, (1, 10, 25, 30, 40)))))
    return counts.where(F.col("n") >= F.col("min_interactions")).groupBy("min_interactions").agg(n_rows().alias("items_surviving"))


@query("jn_09_one_row_cross", """
SELECT * FROM (SELECT count(*) AS total_rows, count(DISTINCT user_id) AS users FROM cleaned), (SELECT count(*) AS bot_users FROM bots)""")
def _(t):
    steps = clean.clean_steps(t.clicks, CFG)
    base = steps["bots"].agg(n_rows().alias("total_rows"), F.count_distinct("user_id").alias("users"))
    return scale.beside(base, clean.bot_users(steps["price_floor"], BOT_PER_DAY).agg(n_rows().alias("bot_users")))


@query("jn_10_scalar_subqueries", """
SELECT (SELECT count(*) FROM btrain) AS train_rows, (SELECT count(*) FROM btest) AS test_rows, (SELECT count(DISTINCT product_id) FROM btest) AS test_items""")
def _(t):
    row = t.train.agg(n_rows().alias("train_rows"))
    return row.withColumns({"test_rows": t.test.agg(n_rows().alias("c")).scalar(), "test_items": t.test.agg(F.count_distinct("product_id").alias("c")).scalar()})


@query("jn_11_set_overlap", "SELECT count(*) AS shared_users FROM (SELECT user_id FROM btrain INTERSECT SELECT user_id FROM btest)")
def _(t):
    return t.train.select("user_id").intersect(t.test.select("user_id")).agg(n_rows().alias("shared_users"))


@query("jn_12_both_sides", """
SELECT user_session, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type IN ('cart', 'purchase')) AS positives
FROM clicks WHERE user_session IS NOT NULL GROUP BY 1 HAVING views > 0 AND positives > 0""")
def _(t):
    kind = F.col("event_type")
    out = clean.drop_null_session(t.clicks).groupBy("user_session").agg(F.count_if(kind == "view").alias("views"), F.count_if(kind.isin("cart", "purchase")).alias("positives"))
    return out.where("views > 0 AND positives > 0")


@query("jn_13_map_lookup", "SELECT c.event_id, c.event_time > TIMESTAMP '2024-01-25' AS late, u.user_idx, i.item_idx FROM clicks c LEFT JOIN user_vocab u USING (user_id) LEFT JOIN item_vocab i USING (product_id)")
def _(t):
    users, items = t.click_vocabs
    ev = t.clicks.select("event_id", (F.col("event_time") > F.lit(datetime(2024, 1, 25))).alias("late"), "user_id", "product_id")
    out = features.encode_column(ev, users, "user_id", "user_idx")
    return features.encode_column(out, items, "product_id", "item_idx").drop("user_id", "product_id")


@query("jn_14_gather", "SELECT p.user_idx, p.item_idx, i.cat_l2, i.brand, i.price_bucket FROM tp p JOIN items i USING (item_idx)")
def _(t):
    return scale.salted_join(t.pairs_once.select("user_idx", "item_idx"), t.items.select("item_idx", "cat_l2", "brand", "price_bucket"), ["item_idx"], "inner")


cte("reps", "SELECT user_idx, item_idx AS rep FROM (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY confidence_score DESC, item_idx) AS rn FROM tp) WHERE rn = 1")
cte("co_counts", """
SELECT a.item_idx AS rep, b.item_idx, count(*) AS n FROM tp a JOIN tp b ON b.user_idx = a.user_idx AND b.item_idx <> a.item_idx
WHERE a.item_idx IN (SELECT rep FROM reps) GROUP BY 1, 2""")


@query("jn_15_cooccurrence", "SELECT * FROM co_counts")
def _(t):
    return recommend.co_counts(t.pairs, recommend.representative_item(t.pairs))


@query("jn_15_cooccurrence_tiles", "SELECT * FROM co_counts")
def _(t):
    # Tiles of ten items: most users meet themselves in several.
    return recommend.co_counts(t.pairs, recommend.representative_item(t.pairs), tile=10)


@query("jn_16_train_test_users", """
SELECT user_id, a.n AS train_events, b.n AS test_events FROM (SELECT user_id, count(*) AS n FROM btrain GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM btest GROUP BY 1) b USING (user_id)""")
def _(t):
    return eda.count_per(t.train, "user_id", "train_events").join(eda.count_per(t.test, "user_id", "test_events"), "user_id")


cte("drift_p", "SELECT product_id AS item_id, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM clicks WHERE event_time < TIMESTAMP '2024-01-16' GROUP BY 1")
cte("drift_q", "SELECT product_id AS item_id, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM clicks WHERE event_time >= TIMESTAMP '2024-01-16' GROUP BY 1")


def drift_windows(t):
    """The first and the second half of the month, each whole."""
    half = F.lit(datetime(2024, 1, 16))
    a, b = t.clicks.where(F.col("event_time") < half), t.clicks.where(F.col("event_time") >= half)
    return a.select(F.col("product_id").alias("item_id")), b.select(F.col("product_id").alias("item_id"))


@query("jn_17_aligned_union", "SELECT coalesce(p.item_id, q.item_id) AS item_id, round(coalesce(p.share, 0), 6) AS p, round(coalesce(q.share, 0), 6) AS q FROM drift_p p FULL JOIN drift_q q ON p.item_id = q.item_id")
def _(t):
    a, b = drift_windows(t)
    return rounded(drift.aligned(drift.item_shares(a), drift.item_shares(b)))


@query("jn_18_exclude_seen", "SELECT user_idx, item_idx FROM truth WHERE (user_idx, item_idx) NOT IN (SELECT user_idx, item_idx FROM tp)")
def _(t):
    return t.truth.join(t.pairs_once, ["user_idx", "item_idx"], "left_anti")


# --------------------------------------------------------------------------- features


@query("fe_01_item_features", """
SELECT product_id, cat_l1, cat_l2, brand, price_bucket, round(avg_price, 4) AS avg_price, item_total_confidence, round(item_purchase_rate, 6) AS item_purchase_rate FROM itemf""")
def _(t):
    return rounded(t.item_features)


@query("fe_01_item_features_dirty", """
SELECT product_id, cat_l1, cat_l2, brand, price_bucket, round(avg_price, 4) AS avg_price, item_total_confidence, round(item_purchase_rate, 6) AS item_purchase_rate FROM citemf""")
def _(t):
    from clickloom.operators import tables

    return rounded(features.item_features(t.clicks, tables.interactions(t.click_splits[0])))


@query("fe_02_user_features", """
SELECT user_id, total_events, months_active, purchase_rate, cart_rate, n_sessions, peak_hour_bucket, preferred_dow, top_category,
       round(avg_purchase_price + 1.3e-7, 6) AS avg_purchase_price, has_purchase_history FROM userf""")
def _(t):
    # Means of four-digit prices often end exactly on a half; the small shift keeps both engines on one side.
    return rounded(t.user_features.withColumn("avg_purchase_price", F.col("avg_purchase_price") + 1.3e-7))


cte("uvoc", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM im)")
cte("ivoc", "SELECT product_id, row_number() OVER (ORDER BY product_id) AS item_idx FROM itemf")
for _name, _col, _src in (("voc_l1", "cat_l1", "itemf"), ("voc_l2", "cat_l2", "itemf"), ("voc_brand", "brand", "itemf"), ("voc_top", "top_category", "userf")):
    cte(_name, f"SELECT 'unknown' AS v, 0 AS idx UNION ALL SELECT v, row_number() OVER (ORDER BY v) FROM (SELECT DISTINCT {_col} AS v FROM {_src} WHERE {_col} <> 'unknown')")


def z_sql(x: str) -> str:
    return f"round(({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () > 0 THEN stddev_pop({x}) OVER () ELSE 1 END, 6)"


cte("ienc", f"""
SELECT f.product_id, v.item_idx, coalesce(a.idx, 0) AS cat_l1_idx, coalesce(b.idx, 0) AS cat_l2_idx, coalesce(c.idx, 0) AS brand_idx, f.price_bucket,
       {z_sql('f.avg_price')} AS avg_price_scaled, {z_sql('ln(1 + f.item_total_confidence)')} AS log_confidence_scaled, {z_sql('f.item_purchase_rate')} AS purchase_rate_scaled
FROM itemf f JOIN ivoc v USING (product_id) LEFT JOIN voc_l1 a ON a.v = f.cat_l1 LEFT JOIN voc_l2 b ON b.v = f.cat_l2 LEFT JOIN voc_brand c ON c.v = f.brand""")
cte("uenc", f"""
SELECT f.user_id, v.user_idx, coalesce(c.idx, 0) AS top_cat_idx, f.peak_hour_bucket, f.preferred_dow - 1 AS preferred_dow, f.has_purchase_history,
       {z_sql('ln(1 + f.total_events)')} AS log_total_events, {z_sql('f.months_active')} AS months_active, {z_sql('f.purchase_rate')} AS purchase_rate,
       {z_sql('f.cart_rate')} AS cart_rate, {z_sql('ln(1 + f.n_sessions)')} AS log_n_sessions, {z_sql('f.avg_purchase_price')} AS avg_purchase_price_scaled
FROM userf f JOIN uvoc v USING (user_id) LEFT JOIN voc_top c ON c.v = f.top_category""")
cte("tpenc", "SELECT user_idx, item_idx, confidence_score FROM im JOIN uvoc USING (user_id) JOIN ivoc USING (product_id)")


class Encoded:
    """The encoded tables of one data folder; the vocabularies are numbered once."""

    def __init__(self, t):
        self.itemf, self.userf, self.im = t.stored_item_features, t.stored_user_features, scale.cut_lineage(t.im)
        self.vocabs = features.vocabularies(self.im, self.itemf, self.userf)
        self.items = features.encode_items(self.itemf, self.vocabs)
        self.users = features.encode_users(self.userf, self.vocabs)
        self.pairs = features.train_pairs(self.im, self.vocabs["user"], self.vocabs["item"])


@query("fe_03_id_vocab", "SELECT * FROM uvoc")
def _(t):
    return features.id_vocab(t.im, "user_id", name="user_idx")


@query("fe_03_first_appearance", """
SELECT user_id, row_number() OVER (ORDER BY event_time, event_id) - 1 AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS rn FROM clicks) WHERE rn = 1""")
def _(t):
    return features.first_seen_vocab(t.clicks, "user_id")


@query("fe_04_str_vocab", "SELECT v AS cat_l2, idx FROM voc_l2")
def _(t):
    return features.str_vocab(t.item_features, "cat_l2")


@query("fe_05_standard_scale", f"SELECT product_id, {z_sql('avg_price')} AS z FROM itemf")
def _(t):
    return rounded(features.standard_scale(t.item_features.select("product_id", "avg_price"), {"z": F.col("avg_price")}).select("product_id", "z"))


@query("fe_06_encode_items", "SELECT * FROM ienc")
def _(t):
    itemf = t.stored_item_features
    vocabs = {"item": features.id_vocab(itemf, "product_id", 1), **features.str_vocabs(itemf, ("cat_l1", "cat_l2", "brand"))}
    return rounded(features.encode_items(itemf, vocabs))


@query("fe_07_encode_users", "SELECT * FROM uenc")
def _(t):
    vocabs = {"user": features.id_vocab(t.im, "user_id"), "top_cat": features.str_vocab(t.stored_user_features, "top_category")}
    return rounded(features.encode_users(t.stored_user_features, vocabs))


@query("fe_08_train_pairs", "SELECT * FROM tpenc")
def _(t):
    return features.train_pairs(t.im, features.id_vocab(t.im, "user_id"), features.id_vocab(t.item_features, "product_id", 1))


cte("price_rel", """
SELECT product_id, (avg_price - m) / m AS r FROM (SELECT product_id, avg_price, CASE WHEN coalesce(avg(avg_price) OVER w, 0) = 0 THEN 1 ELSE avg(avg_price) OVER w END AS m
FROM itemf WINDOW w AS (PARTITION BY cat_l2))""")


@query("fe_09_price_relative", f"SELECT product_id, round(r, 6) AS price_relative, {z_sql('r')} AS price_relative_scaled FROM price_rel")
def _(t):
    return rounded(features.price_relative(t.item_features).select("product_id", "price_relative", "price_relative_scaled"))


cte("recency", """
SELECT f.product_id, coalesce(ln(1 + greatest((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(i.first)) / 86400000000, 0)), 0) AS r
FROM itemf f LEFT JOIN (SELECT product_id, min(first_interaction) AS first FROM im GROUP BY 1) i USING (product_id)""")


@query("fe_10_item_recency", f"SELECT product_id, round(r, 6) AS log_recency, {z_sql('r')} AS log_recency_scaled FROM recency")
def _(t):
    return rounded(features.item_recency(t.item_features, t.im, datetime(2000, 1, 1)))


@query("fe_11_cyclic_dow", "SELECT user_id, round(sin(2 * pi() * preferred_dow / 7), 6) AS dow_sin, round(cos(2 * pi() * preferred_dow / 7), 6) AS dow_cos FROM userf")
def _(t):
    return rounded(features.cyclic_dow(t.user_features).select("user_id", "dow_sin", "dow_cos"))


cte("centroids", f"""
SELECT u.user_idx, coalesce(c.vec, list_transform(range({DIM}), lambda x: 0.0::DOUBLE)) AS centroid, coalesce(c.n, 0) AS n_items FROM (SELECT DISTINCT user_idx FROM ctp) u
LEFT JOIN (SELECT user_idx, list(m ORDER BY i) AS vec, any_value(n) AS n FROM (
  SELECT p.user_idx, g.i, avg(v.vec[g.i]) AS m, count(*) AS n FROM ctp p JOIN vecs v USING (item_idx), (SELECT unnest(range(1, {DIM + 1})) AS i) g
  WHERE p.confidence_score >= 2 GROUP BY 1, 2) GROUP BY 1) c USING (user_idx)""")


@query("fe_12_user_centroid", "SELECT user_idx, n_items, round(centroid[1], 6) AS d1, round(centroid[64], 6) AS d64, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm FROM centroids")
def _(t):
    from clickloom.functions import norm

    out = features.user_centroid(t.click_pairs, t.vectors, DIM)
    return rounded(out.select("user_idx", "n_items", F.get("centroid", F.lit(0)).alias("d1"), F.get("centroid", F.lit(63)).alias("d64"), norm("centroid").alias("norm")))


@query("fe_12_centroid_summary", """
SELECT count(*) FILTER (n_items > 0) AS with_history, count(*) FILTER (n_items = 0) AS without_history,
       round(avg(sqrt(list_dot_product(centroid, centroid))) FILTER (n_items > 0), 6) AS mean_norm FROM centroids""")
def _(t):
    return features.centroid_summary(features.user_centroid(t.click_pairs, t.vectors, DIM))


@query("fe_13_assemble_users", """
SELECT user_idx, array_to_string([top_cat_idx, peak_hour_bucket, preferred_dow, has_purchase_history], ',') AS user_cat,
       log_total_events AS d1, avg_purchase_price_scaled AS d6, round(sin(2 * pi() * preferred_dow / 7), 6) AS d7, 8 AS width FROM uenc""")
def _(t):
    vocabs = {"user": features.id_vocab(t.im, "user_id"), "top_cat": features.str_vocab(t.stored_user_features, "top_category")}
    out = features.assemble_users(features.encode_users(t.stored_user_features, vocabs))
    d = [F.round(F.get("user_dense", F.lit(i)), 6) for i in (0, 5, 6)]
    return out.select("user_idx", text_list("user_cat").alias("user_cat"), d[0].alias("d1"), d[1].alias("d6"), d[2].alias("d7"), F.size("user_dense").alias("width"))


def user_parts(t):
    vocabs = {"user": features.id_vocab(t.im, "user_id"), "top_cat": features.str_vocab(t.stored_user_features, "top_category")}
    return features.encode_users(t.stored_user_features, vocabs)


@query("fe_13_assemble_users_6", "SELECT user_idx, log_total_events AS d1, avg_purchase_price_scaled AS d6, 6 AS width FROM uenc")
def _(t):
    out = features.assemble_users(user_parts(t), cyclic=False)
    return out.select("user_idx", *[F.round(F.get("user_dense", F.lit(i)), 6).alias(n) for i, n in ((0, "d1"), (5, "d6"))], F.size("user_dense").alias("width"))


@query("fe_13_assemble_users_40", """
SELECT e.user_idx, e.log_total_events AS d1, round(coalesce(c.c1, 0), 6) AS c1, round(coalesce(c.c32, 0), 6) AS c32, 40 AS width FROM uenc e LEFT JOIN (
  SELECT user_idx, avg(vec[1]) AS c1, avg(vec[32]) AS c32 FROM tp JOIN vecs USING (item_idx) WHERE confidence_score >= 2 GROUP BY 1) c USING (user_idx)""")
def _(t):
    short = t.vectors.select("item_idx", F.slice("vec", 1, 32).alias("vec"))
    centroids = features.user_centroid(t.pairs, short, 32)
    out = features.assemble_users(user_parts(t), centroids)
    return out.select("user_idx", *[F.round(F.get("user_dense", F.lit(i)), 6).alias(n) for i, n in ((0, "d1"), (8, "c1"), (39, "c32"))], F.size("user_dense").alias("width"))


@query("fe_13_assemble_items", """
SELECT item_idx, array_to_string([item_idx, cat_l1_idx, cat_l2_idx, brand_idx, price_bucket], ',') AS item_cat, avg_price_scaled AS d1, purchase_rate_scaled AS d3 FROM ienc""")
def _(t):
    itemf = t.stored_item_features
    vocabs = {"item": features.id_vocab(itemf, "product_id", 1), **features.str_vocabs(itemf, ("cat_l1", "cat_l2", "brand"))}
    out = features.assemble_items(features.encode_items(itemf, vocabs))
    return out.select("item_idx", text_list("item_cat").alias("item_cat"), F.round(F.get("item_dense", F.lit(0)), 6).alias("d1"), F.round(F.get("item_dense", F.lit(2)), 6).alias("d3"))


@query("fe_14_log_q", """
SELECT i.item_idx, round(coalesce(ln(p.n / (SELECT count(*) FROM tp)), ln(1.0 / (SELECT count(*) FROM items))), 6) AS log_q
FROM items i LEFT JOIN (SELECT item_idx, count(*) AS n FROM tp GROUP BY 1) p USING (item_idx)""")
def _(t):
    return rounded(features.log_q(t.pairs, t.items))


@query("fe_14_log_q_high_intent", """
SELECT i.item_idx, round(coalesce(ln(p.n / (SELECT count(*) FROM tp WHERE confidence_score >= 2)), ln(1.0 / (SELECT count(*) FROM items))), 6) AS log_q
FROM items i LEFT JOIN (SELECT item_idx, count(*) AS n FROM tp WHERE confidence_score >= 2 GROUP BY 1) p USING (item_idx)""")
def _(t):
    return rounded(features.log_q(t.pairs.where("confidence_score >= 2"), t.items))


@query("fe_15_confidence_weight", "SELECT user_idx, item_idx, round(confidence_score / avg(confidence_score) OVER (), 6) AS weight FROM tp")
def _(t):
    return rounded(features.confidence_weight(t.pairs).select("user_idx", "item_idx", "weight"))


CHECKS = ("vocabularies present", "item scaled columns present", "user scaled columns present", "items_encoded columns", "users_encoded columns",
          "train_pairs columns", "items_encoded has no NaN", "users_encoded has no NaN", "item_idx in range", "user_idx in range", "train_pairs size",
          "unknown is 0", "item vocabulary size", "user vocabulary size")


@query("fe_16_validate_encoded", "\nUNION ALL ".join(
    f"SELECT '{c}' AS check_name, " + {
        "items_encoded has no NaN": "CASE WHEN count(*) FILTER (avg_price_scaled IS NULL OR isnan(avg_price_scaled) OR isnan(log_confidence_scaled) OR isnan(purchase_rate_scaled)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ienc",
        "users_encoded has no NaN": "CASE WHEN count(*) FILTER (avg_purchase_price_scaled IS NULL OR isnan(avg_purchase_price_scaled) OR isnan(cart_rate)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM uenc",
        "item_idx in range": "CASE WHEN min(item_idx) >= 1 AND max(item_idx) <= (SELECT count(*) FROM ivoc) THEN 'PASS' ELSE 'FAIL' END AS status FROM tpenc",
        "user_idx in range": "CASE WHEN min(user_idx) >= 0 AND max(user_idx) < (SELECT count(*) FROM uvoc) THEN 'PASS' ELSE 'FAIL' END AS status FROM tpenc",
        "train_pairs size": "CASE WHEN count(*) BETWEEN 10000 AND 60000 THEN 'PASS' ELSE 'FAIL' END AS status FROM tpenc",
        "item vocabulary size": "CASE WHEN count(DISTINCT item_idx) = (SELECT count(*) FROM ivoc) THEN 'PASS' ELSE 'FAIL' END AS status FROM ienc",
        "user vocabulary size": "CASE WHEN count(DISTINCT user_idx) = (SELECT count(*) FROM uvoc) THEN 'PASS' ELSE 'FAIL' END AS status FROM uenc",
    }.get(c, "'PASS' AS status") for c in CHECKS))
def _(t):
    e = Encoded(t)
    return features.validate_encoded(e.items, e.users, e.pairs, e.vocabs, (10_000, 60_000))


@query("fe_17_vocab_report", """
SELECT * FROM (SELECT count(*) AS n_items, min(cat_l1_idx) AS min_cat_l1, max(cat_l1_idx) AS max_cat_l1, min(cat_l2_idx) AS min_cat_l2, max(cat_l2_idx) AS max_cat_l2,
  min(brand_idx) AS min_brand, max(brand_idx) AS max_brand,
  round(count(*) FILTER (purchase_rate_scaled = (SELECT min(purchase_rate_scaled) FROM ienc)) * 100 / count(*), 4) AS pct_min_purchase_rate FROM ienc),
 (SELECT count(*) AS n_users, min(preferred_dow) AS min_dow, max(preferred_dow) AS max_dow, count(*) FILTER (has_purchase_history = 1) AS with_purchases,
  count(*) FILTER (has_purchase_history = 0) AS without_purchases FROM uenc),
 (SELECT count(*) AS n_pairs, count(DISTINCT user_idx) AS pair_users, count(DISTINCT item_idx) AS pair_items, min(confidence_score) AS min_score, max(confidence_score) AS max_score,
  CAST(0 AS BIGINT) AS unmapped_pairs FROM tpenc)""")
def _(t):
    e = Encoded(t)
    return features.vocab_report(e.items, e.users, e.pairs, e.vocabs)


@query("fe_17_describe_scaled", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(round(avg({c}), 5), 5) + 0.0 AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max FROM ienc"
    for c in ("avg_price_scaled", "log_confidence_scaled", "purchase_rate_scaled")))
def _(t):
    itemf = t.stored_item_features
    vocabs = {"item": features.id_vocab(itemf, "product_id", 1), **features.str_vocabs(itemf, ("cat_l1", "cat_l2", "brand"))}
    out = features.describe_scaled(features.encode_items(itemf, vocabs), ("avg_price_scaled", "log_confidence_scaled", "purchase_rate_scaled"))
    return rounded(out, 5).withColumn("mean", F.col("mean") + 0.0)


@query("fe_18_topn_coverage", """
SELECT count(*) AS top_items, count(*) FILTER (product_id IN (SELECT product_id FROM btrain)) AS covered,
       CASE WHEN count(*) FILTER (product_id IN (SELECT product_id FROM btrain)) >= 90 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT product_id, count(*) AS n FROM btest WHERE event_type = 'purchase' GROUP BY 1 ORDER BY n DESC, product_id LIMIT 100)""")
def _(t):
    return features.topn_coverage(t.test, t.train)


# --------------------------------------------------------------------------- verification

cte("stats", """
SELECT i.product_id, i.confidence_score AS total_confidence, i.n_views, i.n_purchases, i.n_carts, i.n_purchases / nullif(i.n_views, 0) AS purchase_rate,
       f.cat_l1, f.brand, f.price_bucket, f.avg_price, count(DISTINCT i.user_id) AS n_users
FROM im i JOIN itemf f USING (product_id) GROUP BY ALL""")
STAT_ORDER = ("product_id, total_confidence, n_views, n_purchases, n_carts, purchase_rate NULLS FIRST, cat_l1, brand, price_bucket, avg_price")


@query("fv_01_item_stats", "SELECT * REPLACE (round(purchase_rate, 6) AS purchase_rate) FROM stats")
def _(t):
    return rounded(verify.item_stats(t.im, t.stored_item_features))


def quintile_sql(value: str, average: str) -> str:
    return f"""
SELECT (['very_cold', 'cold', 'medium', 'warm', 'hot'])[b] AS bin, count(*) AS n_items, round(avg(v), 4) AS {average},
       round(avg(CAST(n_purchases > 0 AS INT)), 4) AS pct_purchased, round(avg(purchase_rate), 4) AS avg_purchase_rate
FROM (SELECT *, {value} AS v, CAST(greatest(1, ceil(5 * (row_number() OVER (ORDER BY {value}, {STAT_ORDER}) - 1) / (count(*) OVER () - 1))) AS INT) AS b FROM stats) GROUP BY b"""


@query("fv_02_quintiles_users", quintile_sql("n_users", "avg_n_users"))
def _(t):
    return verify.quintiles(verify.item_stats(t.im, t.stored_item_features), "n_users", "avg_n_users")


@query("fv_02_quintiles_confidence", quintile_sql("total_confidence", "avg_confidence"))
def _(t):
    return verify.quintiles(verify.item_stats(t.im, t.stored_item_features), "total_confidence", "avg_confidence")


@query("win_07_quintile_ranks", f"""
SELECT product_id, total_confidence, n_users, row_number() OVER (ORDER BY total_confidence, {STAT_ORDER}) AS place FROM stats""")
def _(t):
    stats = verify.item_stats(t.im, t.stored_item_features)
    placed = scale.add_position(stats, [F.asc("total_confidence"), *[F.asc_nulls_first(k) for k in verify.STAT_KEYS]], "place")
    return placed.select("product_id", "total_confidence", "n_users", "place")


@query("fv_03_pareto", """
WITH s AS (SELECT row_number() OVER (ORDER BY n_purchases DESC) AS rn, sum(n_purchases) OVER (ORDER BY n_purchases DESC ROWS UNBOUNDED PRECEDING) AS upto,
  sum(n_purchases) OVER () AS total, count(*) OVER () AS k FROM stats WHERE n_purchases > 0)
SELECT t::DOUBLE AS threshold, min(rn) AS rank, round(min(rn) * 100 / any_value(k), 4) AS pct_items FROM s, (SELECT unnest([0.5, 0.8, 0.9]) AS t) WHERE upto >= t * total GROUP BY 1""")
def _(t):
    return verify.pareto(verify.item_stats(t.im, t.stored_item_features))


cte("top_share", "SELECT t.user_id, t.cat_l1, t.n_events / s.total AS share FROM top_cats t JOIN (SELECT user_id, sum(n_events) AS total FROM user_cats GROUP BY 1) s USING (user_id)")


def describe_sql(col: str, src: str, d: int = 3) -> str:
    points = ", ".join(f"round(quantile_cont({col}, {p}), {d}) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"SELECT count({col}) AS count, round(avg({col}), {d}) AS mean, round(stddev_samp({col}), {d}) AS std, round(min({col}), {d}) AS min, round(max({col}), {d}) AS max, {points} FROM {src}"


@query("fv_04_top_category_share", describe_sql("share", "top_share"))
def _(t):
    return verify.describe(verify.top_category_share(t.train, t.stored_item_features), "share")


@query("fv_04_share_bins", "SELECT CASE WHEN share <= 0.5 THEN '<50%' WHEN share <= 0.7 THEN '50-70%' WHEN share <= 0.85 THEN '70-85%' ELSE '>85%' END AS bin, count(*) AS n_users FROM top_share GROUP BY 1")
def _(t):
    return verify.share_bins(verify.top_category_share(t.train, t.stored_item_features))


@query("win_10_first_per_group", "SELECT user_id, cat_l1, round(share, 6) AS share FROM top_share")
def _(t):
    return rounded(verify.top_category_share(t.train, t.stored_item_features))


cte("cat_match", """
SELECT s.cat_l1 AS train_top_cat, f.cat_l1 = s.cat_l1 AS hit FROM btest b JOIN itemf f USING (product_id) JOIN top_share s ON s.user_id = b.user_id WHERE b.event_type = 'purchase'""")


@query("fv_05_category_match", """
SELECT train_top_cat AS category, count(*) AS purchases, round(avg(CAST(hit AS INT)), 6) AS match_rate FROM cat_match GROUP BY 1
UNION ALL SELECT '(all)', count(*), round(avg(CAST(hit AS INT)), 6) FROM cat_match""")
def _(t):
    top = verify.top_category_share(t.train, t.stored_item_features)
    return verify.category_match_report(verify.category_match(t.test, top, t.stored_item_features))


cte("spreads", "SELECT b.user_id, stddev_samp(f.price_bucket) AS spread FROM btrain b JOIN itemf f USING (product_id) WHERE b.event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2")


@query("fv_06_price_spread", describe_sql("spread", "spreads"))
def _(t):
    return verify.describe(verify.price_spread(t.train, t.stored_item_features), "spread")


@query("fv_06_spread_bins", """
SELECT CASE WHEN spread <= 0.5 THEN 'very_consistent' WHEN spread <= 1 THEN 'consistent' WHEN spread <= 2 THEN 'mixed' WHEN spread <= 4 THEN 'random' END AS bin, count(*) AS n_users FROM spreads GROUP BY 1""")
def _(t):
    return verify.spread_bins(verify.price_spread(t.train, t.stored_item_features))


CORR = """
SELECT round(corr(a, b), 6) AS correlation, count(*) AS n_users FROM (SELECT user_id, avg(avg_price) AS a FROM btrain JOIN itemf USING (product_id) WHERE event_type = 'purchase' GROUP BY 1)
JOIN (SELECT user_id, avg(avg_price) AS b FROM btest JOIN itemf USING (product_id) WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)"""


@query("fv_07_price_correlation", CORR)
def _(t):
    return verify.price_correlation(t.train, t.test, t.stored_item_features)


def rising_sql(value: str, average: str) -> str:
    order = "CASE bin WHEN 'very_cold' THEN 1 WHEN 'cold' THEN 2 WHEN 'medium' THEN 3 WHEN 'warm' THEN 4 ELSE 5 END"
    return f"(SELECT bool_and(ok) FROM (SELECT coalesce(pct_purchased >= lag(pct_purchased) OVER (ORDER BY {order}), TRUE) AS ok FROM ({quintile_sql(value, average)})))"


@query("fv_08_feature_decisions", f"""
WITH r AS (SELECT {rising_sql('total_confidence', 'a')} AS c, {rising_sql('n_users', 'a')} AS u,
  (SELECT round(avg(CAST(n_purchases = 0 AS INT)) * 100, 4) FROM stats) AS z, (SELECT round(avg(CAST(hit AS INT)), 6) FROM cat_match) AS m,
  (SELECT correlation FROM ({CORR})) AS p)
SELECT 'item_total_confidence' AS feature, CAST(c AS INT)::DOUBLE AS result, CASE WHEN c THEN 'yes' ELSE 'no' END AS include FROM r
UNION ALL SELECT 'item_n_users', CAST(u AS INT)::DOUBLE, CASE WHEN u THEN 'yes' ELSE 'no' END FROM r
UNION ALL SELECT 'item_purchase_rate', z, CASE WHEN z > 40 THEN 'yes' ELSE 'no' END FROM r
UNION ALL SELECT 'user_top_category', m, CASE WHEN m > 0.3 THEN 'yes' ELSE 'no' END FROM r
UNION ALL SELECT 'user_avg_purchase_price', p, CASE WHEN p > 0.4 THEN 'yes' ELSE 'no' END FROM r""")
def _(t):
    return verify.feature_decisions(t.train, t.test, t.stored_item_features, t.im)
