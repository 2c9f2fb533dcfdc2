"""Sources, sinks, filters, cleaning, sampling and split queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from clickloom import scale
from clickloom.config import Config
from clickloom.functions import time_text
from clickloom.operators import clean, eda, features, sample, sequences, tables
from clickloom.plans.registry import BASKET_TEST, BASKET_VAL, TEST_START, TRAIN_END, cte, query
from clickloom.sources import files, views

BOT_PER_DAY = 2.9  # the click log has no user above 3.4 events a day
CORE_K = 22

EVENT_COLS = "event_id, event_type, product_id, category_id, category_code, brand, price, user_id, user_session"


def shown(df):
    """Event rows with the time as text."""
    return df.withColumn("event_time", time_text("event_time"))


def shown_sql(source: str) -> str:
    return f"SELECT {EVENT_COLS}, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM {source}"


def raw_csv(t):
    """The click log written the way it arrives: headed CSV, time as text with a zone."""
    path = scale.scratch_path(t.spark, "events-csv")
    names = files.RAW_EVENT_SCHEMA.fieldNames()
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    t.clicks.withColumn("event_time", text).select(*names).write.option("header", True).csv(path)
    return path


RAW_SQL = """
SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_second, event_type, product_id, category_id, category_code,
       brand, price, user_id, user_session FROM clicks"""


@query("src_01_read_events_csv", """
SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' UTC' AS event_time, event_type, product_id, category_id,
       category_code, brand, price, user_id, user_session FROM clicks""")
def _(t):
    return files.read_events_csv(t.spark, raw_csv(t))


@query("src_02_parse_event_time", RAW_SQL)
def _(t):
    raw = files.parse_event_time(files.read_events_csv(t.spark, raw_csv(t)))
    return raw.withColumn("event_second", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).drop("event_time")


@query("src_03_load_events", RAW_SQL)
def _(t):
    raw = files.load_events(t.spark, raw_csv(t), max_bad=1000)
    return raw.withColumn("event_second", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).drop("event_time")


@query("src_04_split_holdout", """
SELECT month, count(*) AS n, month > '2000-12' AS held_out FROM (
  SELECT strftime(event_time, '%Y-%m') AS month FROM baskets) GROUP BY month""")
def _(t):
    path = scale.scratch_path(t.spark, "by-month")
    months = t.baskets.select(F.date_format("event_time", "yyyy-MM").alias("month"))
    months.withColumn("stem", F.col("month")).write.partitionBy("stem").parquet(path)
    train, held = files.scan_split(t.spark, path, F.col("stem") > "2000-12")
    both = train.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
    return both.groupBy("month", "held_out").agg(F.count(F.lit(1)).alias("n"))


@query("src_05_scan", "SELECT user_id, product_id, event_type FROM clicks")
def _(t):
    path = scale.scratch_path(t.spark, "scan")
    t.clicks.write.parquet(path)
    return files.scan(t.spark, path, ["user_id", "product_id", "event_type"])


@query("src_06_load_window", """
SELECT product_id AS item_id FROM baskets WHERE strftime(event_time, '%Y-%m') = '1999-12'""")
def _(t):
    return files.load_window(t.baskets, "1999-12")


CLICK_TYPES = {
    "event_id": "bigint", "event_time": "timestamp", "event_type": "string", "product_id": "bigint", "category_id": "bigint",
    "category_code": "string", "brand": "string", "price": "double", "user_id": "bigint", "user_session": "string",
}


@query("src_07_table_profile", "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT {i} AS ordinal, '{name}' AS column_name, '{kind}' AS data_type, TRUE AS is_nullable, count(*) FILTER ({name} IS NULL) AS null_count, count(*) AS row_count FROM clicks"
    for i, (name, kind) in enumerate(CLICK_TYPES.items(), 1)) + ")")
def _(t):
    return files.table_profile(t.clicks)


@query("src_08_load_sessions", "SELECT split, count(*) AS n FROM split_sessions GROUP BY split")
def _(t):
    folder = scale.scratch_path(t.spark, "sessions")
    sequences.save_sessions(t.sessions, folder)
    out = None
    for name, df in files.load_sessions(t.spark, folder).items():
        if name != "metadata":
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name.split("_")[0]).alias("split"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def through_file(t, name, write):
    path = scale.scratch_path(t.spark, name)
    write(path)
    return t.spark.read.parquet(path)


@query("snk_01_write_events", shown_sql("clicks"))
def _(t):
    return shown(through_file(t, "events", lambda p: files.write_events(t.clicks, p, 8)))


@query("snk_02_save_table", shown_sql("clicks"))
def _(t):
    path = scale.scratch_path(t.spark, "table")
    name = "clickloom_events_" + path.rsplit("/", 1)[1][:12]
    files.save_table(t.clicks, name, path)
    return shown(t.spark.table(name))


@query("snk_02_bucketed_join", """
SELECT user_id, count(*) AS events, any_value(n_pairs) AS n_pairs FROM clicks JOIN (SELECT user_id, count(*) AS n_pairs FROM (SELECT DISTINCT user_id, product_id FROM clicks) GROUP BY 1) USING (user_id) GROUP BY user_id""")
def _(t):
    stored = []
    for df in (t.clicks, t.clicks.select("user_id", "product_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"))):
        path = scale.scratch_path(t.spark, "buckets")
        stored.append(files.save_bucketed(df, "clickloom_buckets_" + path.rsplit("/", 1)[1][:12], "user_id", 8, path))
    # Stored by user, the two tables join and group where they are.
    return stored[0].join(stored[1].hint("merge"), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("n_pairs").alias("n_pairs"))


@query("snk_03_ctas", "SELECT user_id, product_id, confidence_score FROM im")
def _(t):
    path = scale.scratch_path(t.spark, "ctas")
    name = "clickloom_interactions_" + path.rsplit("/", 1)[1][:12]
    files.ctas(t.im, name, path)
    return files.ctas(t.im, name, path).select("user_id", "product_id", "confidence_score")


@query("snk_04_export_parquet", shown_sql("clicks"))
def _(t):
    text = t.clicks.withColumn("event_time", F.col("event_time").cast("string"))
    return shown(through_file(t, "export", lambda p: files.export_parquet(text, p)))


@query("snk_05_export_sorted", "SELECT product_id, cat_l1, brand, row_number() OVER (ORDER BY product_id) AS file_order FROM itemf")
def _(t):
    out = through_file(t, "sorted", lambda p: files.export_sorted(t.item_features, p, "product_id"))
    return scale.add_position(out, [F.col("product_id")], "file_order").select("product_id", "cat_l1", "brand", "file_order")


@query("snk_06_write_report", """
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products FROM clicks""")
def _(t):
    path = scale.scratch_path(t.spark, "report")
    files.write_report(tables.load_sanity(t.clicks).select("total_rows", "users", "products"), path)
    return t.spark.read.json(path)


PRESETS = (3, 5, 8)
cte("catalog_rows", """
SELECT CAST(product_id AS VARCHAR) AS item_id, cat_l1 AS c1, cat_l2 AS c2, trim(lower(brand)) AS b,
       coalesce(floor(avg_price * 100 + 0.500001) / 100, 0.0) AS price, item_total_confidence AS interactions, product_id FROM itemf""")
cte("catalog", f"""
SELECT item_id, c1, c2, array_to_string(list_transform(string_split(b, ' '), lambda w: CASE
         WHEN w IN ('lg','hp','aeg','tcl','bmw','kia','cpu','ssd','led','rgb','usb','hdmi','tv','jbl','msn') THEN upper(w)
         ELSE upper(w[1]) || w[2:] END), ' ') AS brand, price
FROM catalog_rows WHERE product_id IN {PRESETS}
   OR product_id IN (SELECT product_id FROM catalog_rows ORDER BY interactions DESC, product_id LIMIT 2000)""")


def catalog(t):
    return files.build_catalog(t.item_features, 2000, PRESETS)


@query("snk_07_build_catalog", "SELECT * FROM catalog")
def _(t):
    return catalog(t)


@query("snk_07_catalog_counts", "SELECT c1, count(*) AS items FROM catalog GROUP BY c1")
def _(t):
    return files.catalog_counts(catalog(t))


@query("snk_08_write_vocab", "SELECT product_id, row_number() OVER (ORDER BY product_id) AS idx FROM (SELECT DISTINCT product_id FROM baskets)")
def _(t):
    return through_file(t, "vocab", lambda p: files.write_vocab(features.id_vocab(t.baskets, "product_id", 1), p))


@query("snk_09_materialise", shown_sql("clicks"))
def _(t):
    return shown(files.materialise(t.clicks, scale.scratch_path(t.spark, "barrier")))


@query("snk_10_checkpoint", "SELECT user_id, product_id, count(*) AS n FROM baskets GROUP BY 1, 2")
def _(t):
    return files.checkpoint_round(t.baskets.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------- filters

cte("filled", """
SELECT event_id, event_time, event_type, product_id, category_id, coalesce(category_code, 'unknown') AS category_code,
       coalesce(brand, 'unknown') AS brand, price, user_id, user_session FROM clicks""")


@query("flt_01_fill_unknown", shown_sql("filled"))
def _(t):
    return shown(clean.fill_unknown(t.clicks))


@query("flt_02_drop_null_session", shown_sql("clicks WHERE user_session IS NOT NULL"))
def _(t):
    return shown(clean.drop_null_session(t.clicks))


@query("flt_03_price_floor", shown_sql("clicks WHERE price >= 1.0"))
def _(t):
    return shown(clean.price_floor(t.clicks))


TRAIN_MONTHS = ("1999-10", "1999-11", "1999-12")


@query("flt_04_temporal_split", """
SELECT 'train' AS side, count(*) AS n, sum(event_id)::BIGINT AS ids FROM baskets
WHERE strftime(event_time, '%Y-%m') IN ('1999-10', '1999-11', '1999-12')
UNION ALL SELECT 'test', count(*), sum(event_id)::BIGINT FROM baskets WHERE strftime(event_time, '%Y-%m') = '2000-01'""")
def _(t):
    train, test = tables.temporal_split(t.baskets, TRAIN_MONTHS, "2000-01")
    both = train.select(F.lit("train").alias("side"), "event_id").unionByName(test.select(F.lit("test").alias("side"), "event_id"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("flt_05_three_way_split", """
SELECT 'train' AS side, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ctrain
UNION ALL SELECT 'val', count(*), sum(event_id)::BIGINT FROM cval
UNION ALL SELECT 'test', count(*), sum(event_id)::BIGINT FROM ctest""")
def _(t):
    sides = [df.select(F.lit(s).alias("side"), "event_id") for s, df in zip(("train", "val", "test"), t.click_splits)]
    both = reduce(lambda a, b: a.unionByName(b), sides)
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("flt_06_high_intent", shown_sql("clicks WHERE event_type IN ('cart', 'purchase')"))
def _(t):
    return shown(clean.high_intent(t.clicks))


cte("user_vocab", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM ctrain)")
cte("item_vocab", "SELECT product_id, row_number() OVER (ORDER BY product_id) AS item_idx FROM (SELECT DISTINCT product_id FROM ctrain)")
cte("mapped", """
SELECT c.*, u.user_idx, i.item_idx, CASE c.event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2 WHEN 'purchase' THEN 3 END AS event_idx
FROM clicks c JOIN user_vocab u USING (user_id) JOIN item_vocab i USING (product_id)
WHERE c.user_session IS NOT NULL AND c.event_type IN ('view', 'cart', 'purchase')""")


@query("flt_07_drop_oov", "SELECT event_id, user_idx, item_idx, CAST(event_idx AS BIGINT) AS event_idx, user_session FROM mapped")
def _(t):
    return features.drop_oov(t.clicks, *t.click_vocabs).select("event_id", "user_idx", "item_idx", "event_idx", "user_session")


@query("flt_07_oov_report", """
SELECT (SELECT count(*) FROM clicks) AS total_rows, (SELECT count(*) FROM mapped) AS kept_rows,
       (SELECT count(*) FROM clicks) - (SELECT count(*) FROM mapped) AS dropped_rows""")
def _(t):
    return features.oov_report(t.clicks, *t.click_vocabs)


@query("flt_08_min_confidence", "SELECT * FROM tp WHERE confidence_score >= 2")
def _(t):
    return clean.min_confidence(t.pairs_once)


@query("flt_08_min_confidence_report", """
SELECT count(*) AS pairs, count(*) FILTER (confidence_score >= 2) AS kept,
       round(count(*) FILTER (confidence_score >= 2) * 100 / count(*), 4) AS kept_pct,
       count(DISTINCT user_idx) FILTER (confidence_score >= 2) AS users,
       count(DISTINCT item_idx) FILTER (confidence_score >= 2) AS items FROM tp""")
def _(t):
    return clean.min_confidence_report(t.pairs_once)


@query("flt_09_min_views", """
SELECT product_id, purchases, views, round(purchases / views, 6) AS conversion_rate FROM (
  SELECT product_id, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'view') AS views
  FROM baskets GROUP BY 1) WHERE views >= 10""")
def _(t):
    return eda.product_conversion(t.baskets).withColumn("conversion_rate", F.round("conversion_rate", 6))


@query("flt_10_eligible_users", "SELECT user_id, count(*) AS event_count FROM baskets GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return sample.eligible_users(t.baskets)


@query("flt_11_multi_buyers", "SELECT user_id, count(*) AS n_purchases FROM baskets WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    bought = t.baskets.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_purchases"))
    return bought.where(F.col("n_purchases") >= 2)


@query("flt_12_in_category", shown_sql("clicks WHERE split_part(category_code, '.', 1) = 'economy'"))
def _(t):
    return shown(clean.in_category(t.clicks, "economy"))


@query("flt_13_catalog_search", """
SELECT * FROM catalog WHERE c1 = 'economy' AND (contains(lower(brand), '1') OR contains(lower(c2), '1') OR contains(item_id, '1'))
ORDER BY CAST(item_id AS BIGINT) LIMIT 20""")
def _(t):
    return files.catalog_search(catalog(t), "1", "economy", 20)


# --------------------------------------------------------------------------- cleaning

cte("no_null", "SELECT * FROM filled WHERE user_session IS NOT NULL")
cte("deduped", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY event_time, event_type, product_id, user_id, user_session ORDER BY event_id) AS rn FROM no_null) WHERE rn = 1""")
cte("near", """
SELECT * EXCLUDE prev FROM (SELECT *, lag(epoch(date_trunc('second', event_time))) OVER (
  PARTITION BY user_id, product_id, event_type ORDER BY event_time, event_id) AS prev FROM deduped)
WHERE prev IS NULL OR epoch(date_trunc('second', event_time)) - prev > 1""")
cte("floored", "SELECT * FROM near WHERE price >= 1.0")
cte("bots", f"""
SELECT user_id, avg(n) AS events_per_day FROM (
  SELECT user_id, CAST(event_time AS DATE) AS d, count(*) AS n FROM floored GROUP BY 1, 2)
GROUP BY 1 HAVING avg(n) > {BOT_PER_DAY}""")
cte("cleaned", "SELECT * FROM floored WHERE user_id NOT IN (SELECT user_id FROM bots)")

CFG = Config(bot_events_per_day=BOT_PER_DAY)


@query("cln_01_exact_dedup", shown_sql("deduped"))
def _(t):
    return shown(clean.exact_dedup(clean.drop_null_session(clean.fill_unknown(t.clicks))))


@query("cln_02_near_dedup", shown_sql("near"))
def _(t):
    return shown(clean.clean_steps(t.clicks, CFG, "near_dedup")["near_dedup"])


@query("cln_03_remove_bots", shown_sql("cleaned"))
def _(t):
    return shown(clean.clean_steps(t.clicks, CFG)["bots"])


@query("cln_03_bot_users", "SELECT user_id, round(events_per_day, 6) AS events_per_day FROM bots")
def _(t):
    floored = clean.clean_steps(t.clicks, CFG, "price_floor")["price_floor"]
    return clean.bot_users(floored, BOT_PER_DAY).withColumn("events_per_day", F.round("events_per_day", 6))


def core_sql(source: str, name: str, k: int, rounds: int) -> str:
    """k-core rounds spelled out; rounds after the fixpoint change nothing."""
    cte(f"{name}_0", f"SELECT * FROM {source}")
    for i in range(1, rounds + 1):
        p = f"{name}_{i - 1}"
        cte(f"{name}_{i}", f"""
SELECT * FROM {p} WHERE user_id IN (SELECT user_id FROM {p} GROUP BY 1 HAVING count(*) >= {k})
  AND product_id IN (SELECT product_id FROM {p} GROUP BY 1 HAVING count(*) >= {k})""")
    return f"{name}_{rounds}"


CORE = core_sql("baskets", "core", CORE_K, 10)
CLEAN_CORE = core_sql("cleaned", "clean_core", 3, 10)


@query("cln_04_k_core", shown_sql(CORE))
def _(t):
    return shown(clean.k_core(t.baskets, CORE_K))


ROUND_ROWS = "\nUNION ALL ".join(
    f"SELECT {i} AS round, (SELECT count(*) FROM core_{i}) AS events, (SELECT count(DISTINCT user_id) FROM core_{i}) AS users, "
    f"(SELECT count(DISTINCT product_id) FROM core_{i}) AS items, "
    f"(SELECT count(*) FROM core_{i - 1}) - (SELECT count(*) FROM core_{i}) AS removed"
    for i in range(1, 11)
)


@query("cln_04_k_core_report", f"""
WITH r AS ({ROUND_ROWS}) SELECT * FROM r WHERE round <= coalesce((SELECT min(round) FROM r WHERE removed = 0), 10)""")
def _(t):
    return clean.k_core_report(t.baskets, CORE_K)


SIM = core_sql("baskets", "sim", 20, 2)


@query("cln_05_core_simulation", """
WITH u3 AS (SELECT user_id FROM sim_2 GROUP BY 1 HAVING count(*) >= 20),
     i3 AS (SELECT product_id FROM sim_2 GROUP BY 1 HAVING count(*) >= 20)
SELECT 'raw' AS stage, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS items, count(*) AS events FROM sim_0
UNION ALL SELECT 'after_round_1', count(DISTINCT user_id), count(DISTINCT product_id), count(*) FROM sim_1
UNION ALL SELECT 'after_round_2', count(DISTINCT user_id), count(DISTINCT product_id), count(*) FROM sim_2
UNION ALL SELECT 'after_round_3', (SELECT count(*) FROM u3), (SELECT count(*) FROM i3),
  (SELECT count(*) FROM sim_2 WHERE user_id IN (SELECT user_id FROM u3) AND product_id IN (SELECT product_id FROM i3))""")
def _(t):
    return clean.core_simulation(t.baskets, 20, 3)


STEP_SOURCES = ("clicks", "no_null", "deduped", "near", "floored", "cleaned")
REPORT = "\nUNION ALL ".join(
    f"SELECT {i} AS step, '{name}' AS step_name, (SELECT count(*) FROM {src}) AS rows_left, "
    f"(SELECT count(*) FROM {STEP_SOURCES[max(i - 1, 0)]}) - (SELECT count(*) FROM {src}) AS removed, "
    f"round(((SELECT count(*) FROM clicks) - (SELECT count(*) FROM {src})) * 100 / (SELECT count(*) FROM clicks), 4) AS removed_pct, "
    + ("(SELECT count(*) FROM bots)" if name == "bots" else "NULL::BIGINT") + " AS bot_users"
    for i, (name, src) in enumerate(zip(clean.STEPS, STEP_SOURCES))
)


@query("cln_06_cleaning_report", REPORT)
def _(t):
    return clean.cleaning_report(t.clicks, CFG)


@query("cln_07_clean", shown_sql(CLEAN_CORE))
def _(t):
    return shown(clean.clean(t.clicks, CFG))


@query("cln_08_drop_repeats", """
SELECT user_idx, user_session, event_id, item_idx FROM (
  SELECT *, lag(item_idx) OVER (PARTITION BY user_idx, user_session ORDER BY event_time, event_id) AS prev FROM mapped_once)
WHERE prev IS NULL OR prev <> item_idx""")
def _(t):
    return sequences.drop_repeats(t.mapped).select("user_idx", "user_session", "event_id", "item_idx")


cte("seq_events", f"""
SELECT *, CASE WHEN event_time < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN event_time < TIMESTAMP '{TEST_START}' THEN 'val'
          ELSE 'test' END AS split FROM mapped_once""")
cte("seq_kept", """
SELECT *, row_number() OVER (PARTITION BY split, user_idx, user_session ORDER BY event_time DESC, event_id DESC) AS age FROM (
  SELECT *, lag(item_idx) OVER (PARTITION BY split, user_idx, user_session ORDER BY event_time, event_id) AS prev FROM seq_events)
WHERE prev IS NULL OR prev <> item_idx""")
cte("split_sessions", """
SELECT split, user_idx, user_session, list(item_idx ORDER BY event_time, event_id) AS item_seq,
       list(event_idx ORDER BY event_time, event_id) AS event_seq, count(*) AS seq_len
FROM seq_kept WHERE age <= 20 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
cte("mapped_once", """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_time, event_type, product_id, user_session ORDER BY event_id) AS rn FROM mapped) WHERE rn = 1""")


# --------------------------------------------------------------------------- samples

H = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def draw_sql(seed: int, *parts: str) -> str:
    """SQL twin of :func:`clickloom.scale.draw`."""
    text = " || '|' || ".join([*[f"CAST({p} AS VARCHAR)" for p in parts], f"'{seed}'"])
    return H.format(text)


@query("smp_01_sample_users_random", f"""
SELECT event_id, user_id FROM baskets WHERE user_id IN (
  SELECT user_id FROM (SELECT DISTINCT user_id FROM baskets) ORDER BY {draw_sql(7, 'user_id')}, user_id LIMIT 50)""")
def _(t):
    return sample.sample_users_random(t.baskets, 50, 7).select("event_id", "user_id")


@query("smp_02_sample_users_hash", """
SELECT event_id, user_id FROM baskets WHERE user_id IN (
  SELECT user_id FROM (SELECT DISTINCT user_id FROM baskets) ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 50)""")
def _(t):
    return sample.sample_users_hash(t.baskets, 50).select("event_id", "user_id")


cte("row_sample", f"""
SELECT b.* FROM baskets b WHERE user_id IN (
  SELECT user_id FROM (
    SELECT user_id, row_number() OVER (ORDER BY {draw_sql(42, 'user_id')}, user_id) AS rn FROM (
      SELECT user_id FROM baskets GROUP BY 1 HAVING count(*) >= 5))
  WHERE rn <= (SELECT CAST(floor(2000 / avg(n)) AS BIGINT) FROM (SELECT count(*) AS n FROM baskets GROUP BY user_id HAVING count(*) >= 5)))""")


@query("smp_03_sample_to_rows", "SELECT event_id, user_id FROM row_sample")
def _(t):
    return sample.sample_to_rows(t.baskets, 2000).select("event_id", "user_id")


def quality_sql(name: str, src: str) -> str:
    shares = ", ".join(f"round(count(*) FILTER (event_type = '{e}') * 100 / count(*), 4) AS {e}_pct" for e in ("view", "cart", "purchase"))
    return f"""
SELECT '{name}' AS sample, count(*) AS n_rows, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products, {shares},
       round(count(*) FILTER (category_code IS NULL) * 100 / count(*), 4) AS null_category_pct,
       round(count(*) FILTER (brand IS NULL) * 100 / count(*), 4) AS null_brand_pct,
       round(count(*) / count(DISTINCT user_id), 4) AS events_per_user FROM {src}"""


@query("smp_04_sample_quality", quality_sql("full", "baskets") + " UNION ALL " + quality_sql("sample", "row_sample"))
def _(t):
    return sample.sample_quality({"full": t.baskets, "sample": sample.sample_to_rows(t.baskets, 2000)})


@query("smp_05_sample_profile", """
SELECT count(DISTINCT user_id) AS users, count(*) AS events, count(DISTINCT product_id) AS items,
       strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS min_time, strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS max_time FROM row_sample""")
def _(t):
    out = sample.sample_profile(sample.sample_to_rows(t.baskets, 2000))
    return out.withColumns({c: time_text(c) for c in ("min_time", "max_time")})


@query("smp_06_sample_rows", f"SELECT user_idx, item_idx FROM tp ORDER BY {draw_sql(42, 'user_idx', 'item_idx')}, user_idx, item_idx LIMIT 500")
def _(t):
    return sample.sample_rows(t.pairs_once, 500, ["user_idx", "item_idx"]).select("user_idx", "item_idx")


@query("smp_07_cap_per_key", f"""
SELECT item_idx, user_idx FROM (SELECT *, row_number() OVER (
  PARTITION BY item_idx ORDER BY {draw_sql(42, 'user_idx', 'item_idx')}, user_idx) AS rn FROM tp) WHERE rn <= 10""")
def _(t):
    return sample.cap_per_key(t.pairs_once, "item_idx", 10, ["user_idx", "item_idx"]).select("item_idx", "user_idx")


@query("smp_08_draw_from_pool", f"""
WITH pool AS (SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS pos FROM (SELECT DISTINCT item_idx FROM tp)),
     z AS (SELECT count(*) AS n FROM pool),
     d AS (SELECT user_idx, k, (({draw_sql(42, 'user_idx')}) + k * greatest(n // 5, 1)) % n AS pos
           FROM (SELECT DISTINCT user_idx FROM tp), z, range(5) r(k))
SELECT d.user_idx, CAST(d.k AS INT) AS draw, pool.item_idx FROM d JOIN pool USING (pos)""")
def _(t):
    return sample.draw_from_pool(t.pairs.select("user_idx").distinct(), t.pairs, "item_idx", 5)
