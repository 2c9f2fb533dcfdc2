"""SQL forms of the shared event logs and derived tables, for checking results in another engine."""

from clickloom.plans.registry import BASKET_TEST, BASKET_VAL, TEST_START, TRAIN_END, cte

cte("click_rows", """
SELECT e.event_id, e.ts AS event_time,
       CASE e.event_type WHEN 'click' THEN 'cart' ELSE e.event_type END AS event_type,
       CAST(regexp_extract(e.props, '[0-9]+', 0) AS BIGINT) AS product_id, e.value AS price, e.user_id
FROM events e""")
cte("click_rich", """
SELECT b.event_id, b.event_time, b.event_type, b.product_id, CAST(p.p_size AS BIGINT) AS category_id,
       CASE WHEN b.product_id % 6 = 0 THEN NULL
            ELSE concat(lower(p.p_type), '.', split_part(p.p_name, ' ', 2)) END AS category_code,
       CASE WHEN b.product_id % 7 = 0 THEN NULL ELSE lower(p.p_brand) END AS brand,
       b.price, b.user_id,
       CASE WHEN b.event_id % 997 = 0 THEN NULL
            ELSE concat(CAST(b.user_id AS VARCHAR), '-',
                        CAST(CAST(date_trunc('week', b.event_time) AS DATE) AS VARCHAR)) END AS user_session
FROM click_rows b JOIN part p ON p.p_partkey = b.product_id""")
cte("clicks", """
SELECT * FROM click_rich
UNION ALL SELECT * FROM click_rich WHERE event_id % 50 = 0
UNION ALL SELECT event_id, event_time + INTERVAL '1' SECOND, event_type, product_id, category_id, category_code,
                 brand, price, user_id, user_session FROM click_rich WHERE event_id % 70 = 0""")
cte("baskets", """
SELECT l.l_orderkey * 10 + l.l_linenumber AS event_id,
       o.o_orderdate + CAST(l.l_linenumber AS INT) * INTERVAL '1' SECOND AS event_time,
       CASE l.l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type,
       l.l_partkey AS product_id, CAST(p.p_size AS BIGINT) AS category_id,
       concat(lower(p.p_type), '.', split_part(p.p_name, ' ', 2)) AS category_code, lower(p.p_brand) AS brand,
       l.l_extendedprice / l.l_quantity AS price, o.o_custkey AS user_id,
       CAST(l.l_orderkey AS VARCHAR) AS user_session
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""")
cte("ctrain", f"SELECT * FROM clicks WHERE event_time < TIMESTAMP '{TRAIN_END}'")
cte("cval", f"SELECT * FROM clicks WHERE event_time >= TIMESTAMP '{TRAIN_END}' AND event_time < TIMESTAMP '{TEST_START}'")
cte("ctest", f"SELECT * FROM clicks WHERE event_time >= TIMESTAMP '{TEST_START}'")
cte("btrain", f"SELECT * FROM baskets WHERE event_time < TIMESTAMP '{BASKET_VAL}'")
cte("bval", f"SELECT * FROM baskets WHERE event_time >= TIMESTAMP '{BASKET_VAL}' AND event_time < TIMESTAMP '{BASKET_TEST}'")
cte("btest", f"SELECT * FROM baskets WHERE event_time >= TIMESTAMP '{BASKET_TEST}'")


def interactions_sql(source: str) -> str:
    return f"""
SELECT user_id, product_id,
       CAST(4 * count(*) FILTER (event_type = 'purchase') + 2 * count(*) FILTER (event_type = 'cart')
            + count(*) FILTER (event_type = 'view') AS BIGINT) AS confidence_score,
       count(*) FILTER (event_type = 'view') AS n_views, count(*) FILTER (event_type = 'cart') AS n_carts,
       count(*) FILTER (event_type = 'purchase') AS n_purchases,
       min(event_time) AS first_interaction, max(event_time) AS last_interaction
FROM {source} GROUP BY user_id, product_id"""


cte("im", interactions_sql("btrain"))
cte("cim", interactions_sql("ctrain"))


def item_features_sql(events: str, im: str) -> str:
    return f"""
SELECT b.product_id, split_part(coalesce(max(b.category_code), 'unknown'), '.', 1) AS cat_l1,
       coalesce(nullif(split_part(coalesce(max(b.category_code), 'unknown'), '.', 2), ''), 'unknown') AS cat_l2,
       coalesce(max(b.brand), 'unknown') AS brand,
       CASE WHEN avg(b.price) < 10 THEN 0 WHEN avg(b.price) < 50 THEN 1 WHEN avg(b.price) < 100 THEN 2
            WHEN avg(b.price) < 200 THEN 3 WHEN avg(b.price) < 500 THEN 4 WHEN avg(b.price) < 1000 THEN 5
            WHEN avg(b.price) < 2000 THEN 6 ELSE 7 END AS price_bucket,
       round(avg(b.price), 4) AS avg_price,
       coalesce(max(s.c), 0) AS item_total_confidence, coalesce(max(s.r), 0) AS item_purchase_rate
FROM {events} b LEFT JOIN (
  SELECT product_id, CAST(sum(confidence_score) AS BIGINT) AS c,
         sum(n_purchases) / nullif(sum(n_views), 0) AS r FROM {im} GROUP BY product_id) s
  ON s.product_id = b.product_id
GROUP BY b.product_id"""


cte("itemf", item_features_sql("baskets", "im"))
cte("citemf", item_features_sql("clicks", "cim"))
cte("userf", """
SELECT b.user_id, count(*) AS total_events, count(DISTINCT strftime(b.event_time, '%Y-%m')) AS months_active,
       round(count(*) FILTER (b.event_type = 'purchase') / count(*), 4) AS purchase_rate,
       round(count(*) FILTER (b.event_type = 'cart') / count(*), 4) AS cart_rate,
       count(DISTINCT b.user_session) AS n_sessions,
       CAST(floor(avg(hour(b.event_time)) / 6) AS BIGINT) AS peak_hour_bucket,
       CAST(round(avg(dayofweek(b.event_time) + 1)) AS BIGINT) AS preferred_dow,
       coalesce(max(c.cat_l1), 'unknown') AS top_category,
       coalesce(max(p.bought), max(p.viewed)) AS avg_purchase_price, max(p.has_purchase) AS has_purchase_history
FROM btrain b
LEFT JOIN (
  SELECT user_id, cat_l1, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cat_l1) AS rn FROM (
    SELECT t.user_id, f.cat_l1, count(*) AS n FROM btrain t JOIN itemf f USING (product_id) GROUP BY 1, 2)
) c ON c.user_id = b.user_id AND c.rn = 1
LEFT JOIN (
  SELECT t.user_id, avg(f.avg_price) FILTER (t.event_type = 'purchase') AS bought, avg(f.avg_price) AS viewed,
         CAST(count(*) FILTER (t.event_type = 'purchase') > 0 AS INT) AS has_purchase
  FROM btrain t JOIN itemf f USING (product_id) GROUP BY 1
) p ON p.user_id = b.user_id
GROUP BY b.user_id""")
cte("tp", "SELECT user_id AS user_idx, product_id + 1 AS item_idx, confidence_score FROM im")
cte("ctp", "SELECT user_id AS user_idx, product_id + 1 AS item_idx, confidence_score FROM cim")
cte("items", "SELECT *, product_id + 1 AS item_idx FROM itemf")
cte("citems", "SELECT *, product_id + 1 AS item_idx FROM citemf")
cte("truth", """
SELECT DISTINCT user_id AS user_idx, product_id + 1 AS item_idx FROM btest WHERE event_type IN ('cart', 'purchase')""")
cte("vecs", "SELECT vec_id AS item_idx, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings")
