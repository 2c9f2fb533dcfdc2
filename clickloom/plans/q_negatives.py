"""Negative-sampling queries. The click log has unknown categories and both warm and cold users."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import negatives
from clickloom.plans.q_clean import draw_sql
from clickloom.plans.q_features import rounded
from clickloom.plans.q_recommend import spread_sql, user_vectors
from clickloom.plans.registry import cte, query

WARM = 35  # users of the click log have 25 to 48 pairs


@query("neg_01_uniform", f"""
SELECT user_idx, user_session, CAST(p AS INT) AS position, CAST(k AS INT) AS draw, 1 + ({draw_sql(42, 'user_idx', 'user_session', 'p', 'k')}) % ((SELECT count(*) FROM item_vocab) + 1 - 1) AS negative
FROM (SELECT user_idx, user_session, unnest(range(1, seq_len + 1)) AS p FROM split_sessions WHERE split = 'train'), range(1, 4) r(k)""")
def _(t):
    size = t.click_vocabs[1].agg((F.count(F.lit(1)) + 1).alias("n")).scalar()
    out = negatives.uniform_negatives(t.sessions["train"], 3, size, ["user_idx", "user_session"])
    flat = out.select("user_idx", "user_session", F.posexplode("negatives").alias("p", "n"))
    flat = flat.select("user_idx", "user_session", (F.col("p") + 1).alias("position"), F.posexplode("n").alias("k", "negative"))
    return flat.select("user_idx", "user_session", "position", (F.col("k") + 1).alias("draw"), "negative")


# The draws of the hard negatives, spelled out again from their definition.
cte("hn_items", "SELECT item_idx, CASE WHEN cat_l2 <> 'unknown' THEN 'c:' || cat_l2 END AS cat_pool, 'b:' || price_bucket AS bucket_pool FROM citems")
cte("hn_pools", """
SELECT pool, item_idx, row_number() OVER (PARTITION BY pool ORDER BY item_idx) - 1 AS at FROM (
  SELECT cat_pool AS pool, item_idx FROM hn_items WHERE cat_pool IS NOT NULL UNION ALL SELECT bucket_pool, item_idx FROM hn_items UNION ALL SELECT 'a', item_idx FROM hn_items)""")
cte("hn_spans", "SELECT pool, count(*) AS size FROM hn_pools GROUP BY 1")
cte("hn_pairs", "SELECT p.user_idx, p.item_idx, i.cat_pool, i.bucket_pool, count(*) OVER (PARTITION BY p.user_idx) >= 35 AS warm FROM ctp p JOIN hn_items i USING (item_idx)")
cte("hn_anti", """
SELECT u.user_idx, s.pool, s.size, row_number() OVER (PARTITION BY u.user_idx ORDER BY s.pool) - 1 AS r, count(*) OVER (PARTITION BY u.user_idx) AS cats, sum(s.size) OVER (PARTITION BY u.user_idx) AS items
FROM (SELECT DISTINCT user_idx FROM ctp) u, hn_spans s WHERE s.pool LIKE 'c:%' AND NOT EXISTS (SELECT 1 FROM hn_pairs p WHERE p.user_idx = u.user_idx AND p.cat_pool = s.pool)""")
cte("hn_routed", """
SELECT p.*, CASE WHEN cat_pool IS NULL THEN 'bucket' WHEN warm AND coalesce(a.cats, 0) > 0 AND coalesce(a.items, 0) >= 3 THEN 'anti' WHEN warm THEN 'warm_category' ELSE 'category' END AS route, a.cats
FROM hn_pairs p LEFT JOIN (SELECT DISTINCT user_idx, cats, items FROM hn_anti) a USING (user_idx)""")
cte("hn_by_cat", f"""
SELECT d.user_idx, d.item_idx, d.route, d.k, q.item_idx AS negative FROM (
  SELECT x.*, a.pool, a.size FROM (SELECT *, ({draw_sql(42, 'user_idx', 'item_idx', 'k', "'cat'")}) % cats AS r FROM hn_routed, range(3) g(k) WHERE route = 'anti') x
  JOIN hn_anti a ON a.user_idx = x.user_idx AND a.r = x.r) d
JOIN hn_pools q ON q.pool = d.pool AND q.at = ({draw_sql(42, 'd.user_idx', 'd.item_idx', 'd.k', "'item'")}) % d.size""")
cte("hn_rest", """
SELECT r.user_idx, r.item_idx, CASE WHEN f.free = 0 THEN 'any' ELSE r.route END AS route, CASE WHEN f.free = 0 THEN 'a' ELSE coalesce(r.cat_pool, r.bucket_pool) END AS pool
FROM hn_routed r JOIN (SELECT u.user_idx, q.pool, count(*) FILTER (p.item_idx IS NULL) AS free FROM (SELECT DISTINCT user_idx FROM ctp) u CROSS JOIN hn_pools q
  LEFT JOIN ctp p ON p.user_idx = u.user_idx AND p.item_idx = q.item_idx GROUP BY 1, 2) f ON f.user_idx = r.user_idx AND f.pool = coalesce(r.cat_pool, r.bucket_pool) WHERE r.route <> 'anti'""")
cte("hn_free", """
SELECT r.user_idx, r.item_idx, r.route, q.item_idx AS negative, row_number() OVER (PARTITION BY r.user_idx, r.item_idx ORDER BY q.at) - 1 AS rk, count(*) OVER (PARTITION BY r.user_idx, r.item_idx) AS free
FROM hn_rest r JOIN hn_pools q ON q.pool = r.pool LEFT JOIN ctp p ON p.user_idx = r.user_idx AND p.item_idx = q.item_idx
WHERE CASE WHEN r.route = 'any' THEN q.item_idx <> r.item_idx ELSE p.item_idx IS NULL END""")
cte("hn_draws", f"""
SELECT *, CASE WHEN free < 3 THEN b2 WHEN r2 = s0 OR r2 = s1 THEN free - 1 ELSE r2 END AS s2 FROM (
  SELECT *, CASE WHEN free < 3 THEN b1 WHEN r1 = s0 THEN free - 2 ELSE r1 END AS s1 FROM (
    SELECT *, CASE WHEN free < 3 THEN b0 ELSE r0 END AS s0 FROM (
      SELECT user_idx, item_idx, route, free, {', '.join(f"({draw_sql(42, 'user_idx', 'item_idx', str(i))}) % greatest(free - {2 - i}, 1) AS r{i}, ({draw_sql(42, 'user_idx', 'item_idx', str(i))}) % greatest(free, 1) AS b{i}" for i in range(3))}
      FROM (SELECT DISTINCT user_idx, item_idx, route, free FROM hn_free))))""")
cte("hn_all", """
SELECT user_idx, item_idx, route, CAST(k AS INT) AS draw, negative FROM hn_by_cat
UNION ALL SELECT d.user_idx, d.item_idx, d.route, CAST(d.k AS INT), f.negative FROM (
  SELECT user_idx, item_idx, route, 0 AS k, s0 AS s FROM hn_draws UNION ALL SELECT user_idx, item_idx, route, 1, s1 FROM hn_draws UNION ALL SELECT user_idx, item_idx, route, 2, s2 FROM hn_draws) d
JOIN hn_free f ON f.user_idx = d.user_idx AND f.item_idx = d.item_idx AND f.rk = d.s""")


def mined(t):
    return negatives.hard_negatives(t.click_pairs, t.click_items, warm=WARM)


@query("neg_02_hard_cold", "SELECT * FROM hn_all WHERE route = 'category'")
def _(t):
    return mined(t).where(F.col("route") == "category")


@query("neg_03_hard_warm", "SELECT * FROM hn_all WHERE route IN ('anti', 'warm_category')")
def _(t):
    return mined(t).where(F.col("route").isin("anti", "warm_category"))


@query("neg_04_hard_unknown", "SELECT * FROM hn_all WHERE route IN ('bucket', 'any')")
def _(t):
    return mined(t).where(F.col("route").isin("bucket", "any"))


@query("neg_03_rank_directory", "SELECT * FROM hn_all WHERE route <> 'anti'")
def _(t):
    # Cells of eight ranks: every pool has several, so the whole directory is in use.
    return negatives.hard_negatives(t.click_pairs, t.click_items, warm=WARM, cell=8).where(F.col("route") != "anti")


@query("neg_05_routes", """
SELECT count(*) AS pairs, count(cat_pool) AS known_pairs, count(*) FILTER (route = 'anti') AS anti_pairs, count(*) FILTER (route = 'warm_category') AS warm_fallback_pairs,
       count(*) FILTER (route = 'category') AS cold_pairs, (SELECT count(*) FROM hn_rest WHERE route = 'any') AS any_pairs, count(DISTINCT user_idx) FILTER (warm) AS warm_users, count(DISTINCT user_idx) FILTER (NOT warm) AS cold_users,
       count(*) FILTER (route = 'bucket') AS bucket_pairs, round(count(*) FILTER (route = 'bucket') * 100 / count(*), 4) AS bucket_pct FROM hn_routed""")
def _(t):
    return negatives.hard_negative_routes(t.click_pairs, t.click_items, warm=WARM)


def pool_sql(level: str) -> str:
    return f"""
SELECT '{level}' AS level, count(*)::BIGINT AS pairs, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10,
       CASE WHEN quantile_cont(v, 0.1) >= 50 THEN 'OK' ELSE 'CAUTION' END AS verdict FROM (
  SELECT s.n - 1 AS v FROM tp JOIN items i USING (item_idx) JOIN (SELECT {level}, count(*) AS n FROM items GROUP BY 1) s USING ({level}))"""


@query("neg_06_pool_sizes", pool_sql("cat_l1") + " UNION ALL " + pool_sql("cat_l2"))
def _(t):
    return negatives.pool_sizes(t.pairs, t.items)


cte("sess_items", """
SELECT user_session, product_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type IN ('cart', 'purchase')) AS positive FROM ctrain WHERE user_session IS NOT NULL GROUP BY 1, 2""")
cte("sess_stats", """
SELECT user_session, count(*) FILTER (viewed) AS v, count(*) FILTER (positive) AS p, count(*) FILTER (viewed AND NOT positive) AS neg FROM sess_items GROUP BY 1""")


@query("neg_07_session_negatives", "SELECT user_session, product_id FROM sess_items JOIN sess_stats USING (user_session) WHERE viewed AND NOT positive AND v > 0 AND p > 0")
def _(t):
    return negatives.session_negatives(t.click_splits[0])


@query("neg_07_session_negative_report", f"""
WITH u AS (SELECT neg FROM sess_stats WHERE v > 0 AND p > 0 AND neg > 0), q AS (SELECT count(*) AS n FROM sess_stats WHERE v > 0 AND p > 0)
SELECT (SELECT count(*) FROM sess_stats)::BIGINT AS sessions, (SELECT n FROM q)::BIGINT AS qualifying, count(*)::BIGINT AS usable, count(*) FILTER (neg >= 3)::BIGINT AS with_3_up, round(avg(neg), 6) AS mean,
       {', '.join(f"round(quantile_cont(neg, {p}), 6) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))},
       round(count(*) FILTER (neg >= 3) * 100 / (SELECT n FROM q), 4) AS pct_3_up,
       CASE WHEN count(*) FILTER (neg >= 3) * 100 / (SELECT n FROM q) >= 50 THEN 'OK' WHEN count(*) FILTER (neg >= 3) * 100 / (SELECT n FROM q) >= 20 THEN 'PARTIAL' ELSE 'CAUTION' END AS verdict FROM u""")
def _(t):
    return negatives.session_negative_report(t.click_splits[0])


@query("neg_08_session_negative_overlap", """
WITH l AS (SELECT s.*, i.cat_l1, i.cat_l2, i.product_id IS NOT NULL AS listed FROM sess_items s LEFT JOIN citems i USING (product_id)
           WHERE user_session IN (SELECT user_session FROM sess_stats WHERE v > 0 AND p > 0 AND neg > 0)),
     x AS (SELECT a.user_session, a.cat_l1 = b.cat_l1 AS s1, a.cat_l2 = b.cat_l2 AS s2, a.cat_l1 = b.cat_l1 AND a.cat_l2 = b.cat_l2 AS s12, b.listed FROM l a JOIN l b USING (user_session) WHERE a.positive AND a.listed AND b.viewed AND NOT b.positive)
SELECT (SELECT count(*) FROM sess_stats WHERE v > 0 AND p > 0 AND neg > 0) AS sessions, count(*) FILTER (listed)::BIGINT AS pairs, count(*) FILTER (listed AND s12)::BIGINT AS same_l2,
       count(*) FILTER (listed AND s1 AND NOT s12)::BIGINT AS same_l1_only, count(*) FILTER (listed AND NOT s1)::BIGINT AS different_l1, count(*) FILTER (NOT listed)::BIGINT AS uncatalogued,
       count(DISTINCT user_session) FILTER (listed AND NOT s12) AS sessions_any_different, round(count(*) FILTER (listed AND s12) * 100 / count(*) FILTER (listed), 4) AS same_l2_pct,
       round(count(DISTINCT user_session) FILTER (listed AND NOT s12) * 100 / (SELECT count(*) FROM sess_stats WHERE v > 0 AND p > 0 AND neg > 0), 4) AS any_different_pct FROM x""")
def _(t):
    return negatives.session_negative_overlap(t.click_splits[0], t.click_items)


cte("risk", """
SELECT user_idx, sum(pool)::BIGINT AS candidates, sum(least(hr, pool))::BIGINT AS high_risk, sum(least(hr, pool)) * 100 / sum(pool) AS risk_pct FROM (
  SELECT p.user_idx, p.item_idx, any_value(s.n) - 1 AS pool, coalesce(sum(greatest(c.n - CASE WHEN c.brand = i.brand THEN 1 ELSE 0 END, 0)), 0) AS hr
  FROM ctp p JOIN citems i USING (item_idx) JOIN (SELECT cat_l2, count(*) AS n FROM citems GROUP BY 1) s USING (cat_l2)
  LEFT JOIN (SELECT u.user_idx, k.cat_l2, k.brand, k.n FROM (SELECT DISTINCT p.user_idx, i.brand FROM ctp p JOIN citems i USING (item_idx) WHERE i.brand <> 'unknown') u
             JOIN (SELECT cat_l2, brand, count(*) AS n FROM citems GROUP BY 1, 2) k USING (brand)) c ON c.user_idx = p.user_idx AND c.cat_l2 = i.cat_l2
  GROUP BY 1, 2) WHERE pool > 0 GROUP BY 1""")


@query("neg_09_user_risk", "SELECT user_idx, candidates, high_risk, round(risk_pct, 6) AS risk_pct FROM risk")
def _(t):
    return rounded(negatives.user_risk(t.click_pairs, t.click_items))


@query("neg_09_false_negative_risk", f"""
SELECT count(*) AS n_users, sum(candidates)::BIGINT AS candidates, sum(high_risk)::BIGINT AS high_risk, round(sum(high_risk) * 100 / sum(candidates), 6) AS overall_pct, round(avg(risk_pct), 6) AS mean,
       round(count(*) FILTER (risk_pct > 20) * 100 / count(*), 4) AS pct_users_above_20, round(count(*) FILTER (risk_pct < 5) * 100 / count(*), 4) AS pct_users_below_5,
       {', '.join(f"round(quantile_cont(risk_pct, {p}), 6) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))} FROM risk""")
def _(t):
    return negatives.false_negative_risk(t.click_pairs, t.click_items)


@query("neg_10_popularity_risk", f"""
WITH top AS (SELECT i.cat_l2, count(*) AS c FROM (SELECT item_idx FROM tp GROUP BY 1 ORDER BY count(*) DESC, item_idx LIMIT 2000) JOIN items i USING (item_idx) GROUP BY 1),
     u AS (SELECT t.user_idx, coalesce(sum(top.c), 0) * 100 / (SELECT sum(c) FROM top) AS s FROM (SELECT DISTINCT p.user_idx, i.cat_l2 FROM tp p JOIN items i USING (item_idx)) t LEFT JOIN top USING (cat_l2) GROUP BY 1)
SELECT count(*)::BIGINT AS n_users, round(avg(s), 6) AS mean, {', '.join(f"round(quantile_cont(s, {p}), 6) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM u""")
def _(t):
    return negatives.popularity_risk(t.pairs, t.items, 2000)


cte("freqs", "SELECT item_idx, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, item_idx) AS pop_rank FROM tp GROUP BY 1")


@query("neg_11_popularity_profile", f"""
SELECT count(*)::BIGINT AS trained_items, sum(freq)::BIGINT AS pairs, max(freq) AS max, {', '.join(f"round(quantile_cont(freq, {p}), 6) AS p{round(p * 100)}" for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))},
       count(*) FILTER (freq < 15)::BIGINT AS rare_items, count(*) FILTER (freq = 1)::BIGINT AS once_items, (SELECT count(*) FROM items) AS catalog_items,
       sum(freq) FILTER (pop_rank <= 1000)::BIGINT AS top_pairs, (SELECT count(*) FROM items) - count(*)::BIGINT AS never_trained, round(sum(freq) FILTER (pop_rank <= 1000) * 100 / sum(freq), 4) AS top_pct FROM freqs""")
def _(t):
    return negatives.popularity_profile(t.pairs, t.items, 1000, 15)


@query("neg_11_top_items", """
SELECT CAST(pop_rank AS INT) AS pop_rank, item_idx, freq, round(sum(freq) OVER (ORDER BY pop_rank) * 100 / (SELECT count(*) FROM tp), 4) AS cum_pct FROM freqs WHERE pop_rank <= 10""")
def _(t):
    return negatives.top_items(t.pairs)


cte("big_batches", f"SELECT *, (row_number() OVER (ORDER BY {draw_sql(42, 'user_idx', 'item_idx')}, user_idx, item_idx) - 1) // 2048 AS batch FROM tp")


@query("neg_12_batch_popularity", """
SELECT batch, count(*) AS pairs, round(count(*) FILTER (pop_rank <= 1000) * 100 / count(*), 4) AS top_pct, round(count(*) FILTER (freq < 15) * 100 / count(*), 4) AS rare_pct,
       round(avg(pop_rank), 6) AS mean_rank, round(median(pop_rank), 6) AS median_rank FROM big_batches JOIN freqs USING (item_idx) WHERE batch < 10 GROUP BY 1""")
def _(t):
    return negatives.batch_popularity(t.pairs, 2048, 10, 1000, 15)


def same_sql(level: str) -> str:
    return f"(SELECT batch, round(sum(c * (c - 1)) * 100 / (sum(c) * (sum(c) - 1)), 6) AS same_{level}_pct FROM (SELECT batch, {level}, count(*) AS c FROM big_batches JOIN items USING (item_idx) GROUP BY 1, 2) GROUP BY 1)"


@query("neg_13_batch_same_category", f"""
SELECT batch, n.pairs, a.same_cat_l1_pct, b.same_cat_l2_pct FROM (SELECT batch, count(*) AS pairs FROM big_batches WHERE batch < 10 GROUP BY 1) n JOIN {same_sql('cat_l1')} a USING (batch) JOIN {same_sql('cat_l2')} b USING (batch)""")
def _(t):
    return negatives.batch_same_category(t.pairs, t.items, 2048, 10)


@query("neg_14_collision_probability", """
SELECT 'cat_l1' AS level, round(sum(c * c) / (sum(c) * sum(c)) * 100, 6) AS collision_pct FROM (SELECT count(*)::DOUBLE AS c FROM items GROUP BY cat_l1)
UNION ALL SELECT 'cat_l2', round(sum(c * c) / (sum(c) * sum(c)) * 100, 6) FROM (SELECT count(*)::DOUBLE AS c FROM items GROUP BY cat_l2)""")
def _(t):
    return negatives.collision_probability(t.items)


cte("sim_items", "SELECT item_idx, cat_l2, row_number() OVER (ORDER BY cat_l2, item_idx) - 1 AS pos FROM citems WHERE item_idx IN (SELECT item_idx FROM vecs)")
cte("sim_spans", "SELECT cat_l2, min(pos) AS start, count(*) AS size, sum(count(*)) OVER ()::BIGINT AS total FROM sim_items GROUP BY 1")
cte("sim_slots", f"""
SELECT p.user_idx, p.item_idx, k.kind, CASE WHEN k.kind = 'same' THEN CASE WHEN s.start + a >= i.pos THEN s.start + a + 1 ELSE s.start + a END ELSE CASE WHEN a >= s.start THEN a + s.size ELSE a END END AS pos
FROM (SELECT user_idx, item_idx FROM ctp ORDER BY {draw_sql(42, 'user_idx', 'item_idx')}, user_idx, item_idx LIMIT 1000) p JOIN sim_items i USING (item_idx) JOIN sim_spans s USING (cat_l2),
  (SELECT 'same' AS kind, unnest(range(3)) AS j UNION ALL SELECT 'diff', unnest(range(3))) k,
  LATERAL (SELECT CASE WHEN k.kind = 'same' THEN (({draw_sql(42, 'p.user_idx', 'p.item_idx', 'k.kind')}) + k.j * ((s.size - 1) // 3)) % greatest(s.size - 1, 1)
           ELSE (({draw_sql(42, 'p.user_idx', 'p.item_idx', 'k.kind')}) + k.j * ((s.total - s.size) // 3)) % (s.total - s.size) END AS a)
WHERE s.size - 1 >= 3 AND s.total - s.size >= 3""")
cte("sim_scores", """
SELECT x.user_idx, x.item_idx, round(avg(list_dot_product(i.v, o.v)) FILTER (kind = 'same'), 9) AS item_same, round(avg(list_dot_product(i.v, o.v)) FILTER (kind = 'diff'), 9) AS item_diff,
       round(max(list_dot_product(u.v, i.v)), 9) AS user_pos, round(avg(list_dot_product(u.v, o.v)) FILTER (kind = 'same'), 9) AS user_same, round(avg(list_dot_product(u.v, o.v)) FILTER (kind = 'diff'), 9) AS user_diff
FROM sim_slots x JOIN sim_items s USING (pos) JOIN units o ON o.item_idx = s.item_idx JOIN units i ON i.item_idx = x.item_idx JOIN uvecs u ON u.user_idx = x.user_idx GROUP BY 1, 2""")


def similarity(t):
    return negatives.intra_category_scores(t.click_pairs, t.click_items, t.vectors, user_vectors(t), 1000, 3, 3)


@query("neg_15_intra_category_scores", "SELECT user_idx, item_idx, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("item_same", "item_diff", "user_pos", "user_same", "user_diff")) + " FROM sim_scores")
def _(t):
    return rounded(similarity(t))


@query("neg_15_intra_category_report", "SELECT a.*, b.*, c.*, d.*, e.*, (SELECT count(*) FROM sim_scores) AS pairs, round(item_same_mean - item_diff_mean, 6) AS item_gap, round(user_same_mean - user_diff_mean, 6) AS user_gap FROM "
       + ", ".join(f"({spread_sql(c, 'sim_scores', c + '_')}) {n}" for c, n in zip(("item_same", "item_diff", "user_pos", "user_same", "user_diff"), "abcde")))
def _(t):
    return rounded(negatives.intra_category_report(similarity(t)))
