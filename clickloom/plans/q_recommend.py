"""Recommender and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom import scale
from clickloom.functions import unit
from clickloom.operators import clean, eda, evaluate, features, recommend, sequences, tables
from clickloom.plans.q_clean import draw_sql
from clickloom.plans.q_features import DIM, rounded
from clickloom.plans.registry import cte, query
from clickloom.sources import files

RECS = ("user_idx", "rank", "item_idx", "score")

cte("popular", "SELECT item_idx, sum(confidence_score)::DOUBLE AS score, row_number() OVER (ORDER BY sum(confidence_score) DESC, item_idx) AS prank FROM tp GROUP BY 1")
cte("users", "SELECT DISTINCT user_idx FROM truth")
cte("unseen_popular", """
SELECT u.user_idx, p.item_idx, p.score, p.prank FROM users u, popular p WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.user_idx = u.user_idx AND tp.item_idx = p.item_idx)""")
cte("rec_pop", "SELECT user_idx, rank, item_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY prank) AS rank FROM unseen_popular) WHERE rank <= 20")
cte("user_top_cat", """
SELECT user_idx, cat_l2 FROM (SELECT user_idx, cat_l2, row_number() OVER (PARTITION BY user_idx ORDER BY sum(confidence_score) DESC, cat_l2) AS rn
FROM tp JOIN items USING (item_idx) GROUP BY 1, 2) WHERE rn = 1""")
cte("rec_cat", """
SELECT user_idx, rank, item_idx, CASE WHEN tier = 0 THEN score ELSE 0.0 END AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY tier, prank) AS rank FROM (
    SELECT p.*, CASE WHEN i.cat_l2 = c.cat_l2 THEN 0 ELSE 1 END AS tier FROM unseen_popular p JOIN items i USING (item_idx) LEFT JOIN user_top_cat c USING (user_idx))) WHERE rank <= 20""")
cte("co_top", "SELECT rep, item_idx, n, crank FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY n DESC, item_idx) AS crank FROM co_counts) WHERE crank <= 500")
cte("rec_co", """
SELECT user_idx, rank, item_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY tier, o) AS rank FROM (
  SELECT p.user_idx, p.item_idx, CASE WHEN c.n IS NULL THEN 0.0 ELSE c.n::DOUBLE END AS score, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS tier,
         coalesce(c.crank, p.prank) AS o FROM unseen_popular p LEFT JOIN reps r USING (user_idx) LEFT JOIN co_top c ON c.rep = r.rep AND c.item_idx = p.item_idx)) WHERE rank <= 20""")


def popular(t, n=20):
    return recommend.rec_popular(t.pairs, t.truth, n)


@query("rec_01_popular", "SELECT * FROM rec_pop")
def _(t):
    return popular(t)


@query("rec_01_popular_joined", "SELECT * FROM rec_pop")
def _(t):
    # Short rank blocks, so that users walk over several of them.
    return recommend.rec_popular(t.pairs, t.truth, 20, block=7)


@query("rec_02_category", "SELECT * FROM rec_cat")
def _(t):
    return recommend.rec_category(t.pairs, t.items, t.truth)


@query("rec_03_cooccurrence", "SELECT * FROM rec_co")
def _(t):
    return recommend.rec_cooccurrence(t.pairs, t.truth)


@query("win_09_representative", "SELECT user_idx, rep FROM reps")
def _(t):
    return recommend.representative_item(t.pairs)


@query("top_06_neighbours", "SELECT rep, item_idx, n, crank AS rank FROM co_top")
def _(t):
    return recommend.top_neighbours(recommend.co_counts(t.pairs, recommend.representative_item(t.pairs)), 500)


# --------------------------------------------------------------------------- vectors

cte("units", "SELECT item_idx, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM vecs")


def rec_sql(k: int, dot: str, src: str) -> str:
    return f"""
SELECT query_id, rank, item_idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_idx) AS rank FROM (
  SELECT a.item_idx AS query_id, b.item_idx, {dot} AS score FROM {src} a JOIN {src} b ON a.item_idx <> b.item_idx)) WHERE rank <= {k}"""


def as_queries(t):
    return t.vectors.select(F.col("item_idx").alias("query_id"), "vec")


@query("rec_04_topk_cosine", rec_sql(50, "list_dot_product(a.v, b.v)", "units"))
def _(t):
    return rounded(recommend.topk_similar(as_queries(t), t.vectors, 50, exclude_self=True))


@query("rec_04_topk_inner_product", rec_sql(10, "list_dot_product(a.vec, b.vec)", "vecs"))
def _(t):
    return rounded(recommend.topk_similar(as_queries(t), t.vectors, 10, normalize=False, exclude_self=True, block=200))


@query("rec_05_restrict_index", "SELECT item_idx FROM vecs WHERE item_idx IN (SELECT item_idx FROM tp) AND item_idx <> 0")
def _(t):
    return recommend.restrict_index(t.vectors, t.pairs).select("item_idx")


cte("uvecs", """
SELECT user_idx, CASE WHEN sqrt(list_dot_product(centroid, centroid)) > 0 THEN list_transform(centroid, lambda x: x / sqrt(list_dot_product(centroid, centroid))) ELSE centroid END AS v FROM centroids""")
cte("ctruth", "SELECT DISTINCT user_id AS user_idx, product_id + 1 AS item_idx FROM ctest WHERE event_type IN ('cart', 'purchase')")
cte("vec_scores", "SELECT u.user_idx, i.item_idx, list_dot_product(u.v, i.v) AS score FROM uvecs u JOIN units i ON TRUE WHERE i.item_idx IN (SELECT item_idx FROM ctp)")
cte("vec_recs", "SELECT user_idx, item_idx, score, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS rank FROM vec_scores")


def user_vectors(t):
    return features.user_centroid(t.click_pairs, t.vectors, DIM).select("user_idx", F.col("centroid").alias("vec"))


def click_truth(t):
    return clean.high_intent(t.click_splits[2]).select(F.col("user_id").alias("user_idx"), (F.col("product_id") + 1).alias("item_idx")).distinct()


def vector_recs(t, k):
    index = recommend.restrict_index(t.vectors, t.click_pairs)
    out = recommend.topk_similar(user_vectors(t).withColumnRenamed("user_idx", "query_id"), index, k)
    return out.withColumnRenamed("query_id", "user_idx")


@query("rec_06_filter_seen", """
SELECT user_idx, row_number() OVER (PARTITION BY user_idx ORDER BY rank) AS rank, item_idx, round(score, 6) AS score FROM vec_recs r
WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM ctp WHERE ctp.user_idx = r.user_idx AND ctp.item_idx = r.item_idx)
QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY rank) <= 20""")
def _(t):
    return rounded(recommend.filter_seen(vector_recs(t, 50), t.click_pairs, 20))


cte("sess_known", """
SELECT e.*, row_number() OVER (PARTITION BY user_session ORDER BY event_time DESC, event_id DESC, item_idx DESC) AS age FROM (
  SELECT *, product_id AS item_idx FROM baskets) e WHERE item_idx IN (SELECT item_idx FROM vecs)""")
cte("sess_vec", f"""
SELECT user_session, list(m ORDER BY i) AS v FROM (SELECT s.user_session, g.i, avg(v.vec[g.i]) AS m FROM sess_known s JOIN vecs v USING (item_idx), (SELECT unnest(range(1, {DIM + 1})) AS i) g
WHERE s.age <= 20 GROUP BY 1, 2) GROUP BY 1""")


@query("rec_07_session_vectors", """
SELECT b.user_session, count(*) AS session_length, count(*) FILTER (b.product_id IN (SELECT item_idx FROM vecs)) AS known_items, round(any_value(s.v[1]), 6) AS d1, round(any_value(s.v[64]), 6) AS d64
FROM baskets b JOIN sess_vec s USING (user_session) GROUP BY 1""")
def _(t):
    out = recommend.session_vectors(t.baskets.withColumn("item_idx", F.col("product_id")), t.vectors, DIM)
    return rounded(out.select("user_session", "session_length", "known_items", F.get("vec", F.lit(0)).alias("d1"), F.get("vec", F.lit(63)).alias("d64")))


cte("click_sess", """
SELECT user_session, list(m ORDER BY i) AS v, any_value(n) AS n FROM (SELECT s.user_session, g.i, avg(v.vec[g.i]) AS m, count(*) AS n FROM (
  SELECT user_session, product_id AS item_idx, row_number() OVER (PARTITION BY user_session ORDER BY event_time DESC, event_id DESC, product_id DESC) AS age FROM mapped_once) s
  JOIN vecs v USING (item_idx), (SELECT unnest(range(1, 65)) AS i) g WHERE s.age <= 20 GROUP BY 1, 2) GROUP BY 1""")


@query("rec_07_recommend_sessions", """
WITH z AS (SELECT user_session, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM click_sess),
     n AS (SELECT user_session, count(*) AS session_length, count(*) AS known_items FROM mapped_once GROUP BY 1)
SELECT user_session, rank, item_idx, round(score, 6) AS score, session_length, known_items FROM (
  SELECT *, row_number() OVER (PARTITION BY user_session ORDER BY score DESC, item_idx) AS rank FROM (
    SELECT z.user_session, u.item_idx, list_dot_product(z.v, u.v) AS score FROM z JOIN units u ON TRUE)) JOIN n USING (user_session) WHERE rank <= 10""")
def _(t):
    events = t.mapped.select("user_session", "event_time", "event_id", F.col("product_id").alias("item_idx"))
    return rounded(recommend.recommend_sessions(events, t.vectors, 10, DIM))


KNN = """
WITH n AS (SELECT item_idx, sqrt(sum(confidence_score * confidence_score)) AS w FROM ctp GROUP BY 1 HAVING sum(confidence_score * confidence_score) > 0),
     p AS (SELECT a.item_idx, b.item_idx AS neighbour, sum(a.confidence_score * b.confidence_score) AS ab FROM ctp a JOIN ctp b ON a.user_idx = b.user_idx AND a.item_idx <> b.item_idx GROUP BY 1, 2)
SELECT item_idx, rank, neighbour, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY round(score, 12) DESC, neighbour) AS rank FROM (
  SELECT p.item_idx, p.neighbour, ab / (x.w * y.w) AS score FROM p JOIN n x ON x.item_idx = p.item_idx JOIN n y ON y.item_idx = p.neighbour)) WHERE rank <= 20"""


@query("rec_08_item_knn", KNN)
def _(t):
    return rounded(recommend.item_knn(t.click_pairs, 20))


@query("rec_08_item_knn_tiles", KNN)
def _(t):
    # Tiles of ten: every user of the click log has several.
    return rounded(recommend.item_knn(t.click_pairs, 20, tile=10))


@query("rec_09_als")
def _(t):
    model = recommend.als_fit(t.click_pairs)
    return recommend.als_recommend(model, t.click_pairs.select("user_idx").distinct(), 10)


# --------------------------------------------------------------------------- evaluation


def metric_ctes(name: str, recs: str, gt: str) -> None:
    """Per-user hits and discounted gains of one recommender."""
    cte(name, f"""
SELECT g.user_idx, count(*) AS n_gt, count(*) FILTER (r.rank <= 10) AS h10, count(*) FILTER (r.rank <= 20) AS h20,
       coalesce(sum(1 / log2(r.rank + 1)) FILTER (r.rank <= 10), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS n10,
       coalesce(sum(1 / log2(r.rank + 1)) FILTER (r.rank <= 20), 0) / list_sum(list_transform(range(1, least(count(*), 20) + 1), lambda i: 1 / log2(i + 1))) AS n20
FROM {gt} g LEFT JOIN {recs} r ON r.user_idx = g.user_idx AND r.item_idx = g.item_idx GROUP BY 1""")


metric_ctes("m_pop", "rec_pop", "truth")
metric_ctes("m_cat", "rec_cat", "truth")
metric_ctes("m_co", "rec_co", "truth")


def averages_sql(denominator: str = "min") -> str:
    d = (lambda k: f"least(n_gt, {k})") if denominator == "min" else (lambda k: "n_gt")
    return (f"count(*) AS n_users, round(avg(h10 / {d(10)}), 6) AS recall_10, round(avg(h20 / {d(20)}), 6) AS recall_20, round(avg(n10), 6) AS ndcg_10, round(avg(n20), 6) AS ndcg_20, "
            "round(avg(CAST(h10 > 0 AS INT)), 6) AS hit_rate_10, round(avg(CAST(h20 > 0 AS INT)), 6) AS hit_rate_20")


@query("ev_01_ground_truth", """
SELECT DISTINCT u.user_idx, i.item_idx FROM btest b JOIN uvoc u USING (user_id) JOIN ivoc i USING (product_id) WHERE b.event_type IN ('cart', 'purchase')""")
def _(t):
    users, items = features.id_vocab(t.im, "user_id"), features.id_vocab(t.item_features, "product_id", 1)
    return evaluate.ground_truth(t.test, users, items, featured=users.select(F.col("idx").alias("user_idx")))


@query("ev_02_user_coverage", """
WITH b AS (SELECT DISTINCT user_id FROM btest WHERE event_type IN ('cart', 'purchase')), f AS (SELECT user_idx FROM uvoc JOIN userf USING (user_id) WHERE total_events >= 10),
     r AS (SELECT count(*) AS test_buyers, count(u.user_idx) AS in_vocab, count(f.user_idx) AS with_features FROM b LEFT JOIN uvoc u USING (user_id) LEFT JOIN f ON f.user_idx = u.user_idx)
SELECT *, test_buyers - in_vocab AS lost_no_vocab, in_vocab - with_features AS lost_no_features, round(with_features * 100 / test_buyers, 4) AS coverage_pct FROM r""")
def _(t):
    users = features.id_vocab(t.im, "user_id", name="user_idx")
    featured = t.user_features.where("total_events >= 10").join(users, "user_id").select("user_idx")
    return evaluate.user_coverage(t.test, users, featured)


@query("ev_03_recall_min", "SELECT user_idx, round(h10 / least(n_gt, 10), 6) AS recall_10, round(h20 / least(n_gt, 20), 6) AS recall_20 FROM m_pop")
def _(t):
    return rounded(evaluate.recall_at_k(popular(t), t.truth))


@query("ev_04_recall_gt", "SELECT user_idx, round(h10 / n_gt, 6) AS recall_10, round(h20 / n_gt, 6) AS recall_20 FROM m_pop")
def _(t):
    return rounded(evaluate.recall_at_k(popular(t), t.truth, denominator="gt"))


@query("ev_05_ndcg", "SELECT user_idx, round(n10, 6) AS ndcg_10, round(n20, 6) AS ndcg_20 FROM m_pop")
def _(t):
    return rounded(evaluate.ndcg_at_k(popular(t), t.truth))


@query("ev_06_precision", "SELECT user_idx, round(h10 / 10, 6) AS precision_10, round(h20 / 20, 6) AS precision_20 FROM m_pop")
def _(t):
    return rounded(evaluate.precision_at_k(popular(t), t.truth))


@query("ev_07_hit_rate", "SELECT round(avg(CAST(h10 > 0 AS INT)), 6) AS hit_rate_10, round(avg(CAST(h20 > 0 AS INT)), 6) AS hit_rate_20 FROM m_pop")
def _(t):
    return evaluate.hit_rate(popular(t), t.truth)


@query("ev_08_evaluate", f"SELECT {averages_sql()} FROM m_pop")
def _(t):
    return evaluate.evaluate(popular(t), t.truth)


cte("cohorts", """
SELECT user_idx, n_seen, CASE WHEN n_seen BETWEEN 3 AND 10 THEN 'cold' WHEN n_seen BETWEEN 11 AND 50 THEN 'medium' WHEN n_seen >= 51 THEN 'warm' END AS cohort
FROM (SELECT user_idx, count(*) AS n_seen FROM tp GROUP BY 1)""")


@query("ev_09_evaluate_stratified", f"""
SELECT cohort, {averages_sql()} FROM m_pop JOIN cohorts USING (user_idx) WHERE cohort IS NOT NULL GROUP BY 1 UNION ALL SELECT 'overall', {averages_sql()} FROM m_pop""")
def _(t):
    return evaluate.evaluate_stratified(popular(t), t.truth, t.pairs)


@query("rec_10_compare", "\nUNION ALL ".join(
    f"SELECT '{n}' AS model, {averages_sql('gt')} FROM {m}" for n, m in (("popular", "m_pop"), ("category", "m_cat"), ("cooccurrence", "m_co"))))
def _(t):
    return evaluate.compare(models(t), t.stored_truth)


@query("rec_09_als_solved", "SELECT count(DISTINCT user_idx) AS users, count(DISTINCT user_idx) AS solved FROM ctp WHERE confidence_score > 0")
def _(t):
    # Half an epoch is float work on 64 factors; a wrong weighting is off by more than a tenth.
    gaps = recommend.als_residuals(recommend.als_fit(t.click_pairs), t.click_pairs)
    return gaps.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("residual") <= 1e-3 * F.col("size")).alias("solved"))


EPOCHS = (1996, 1997, 1998, 1999)


def runs_sql(weight: str, run: str) -> str:
    return "\nUNION ALL ".join(f"""
SELECT '{run}' AS run, {k} AS epoch, round(-avg(ln((coalesce(c.n, 0) + 1) / ((SELECT sum({weight}) FROM dated WHERE y <= {y}) + (SELECT count(*) FROM items)))), 6) AS loss,
       round(avg(CASE WHEN r <= 50 THEN 1.0 ELSE 0 END), 6) AS recall
FROM held LEFT JOIN (SELECT item_idx, n, row_number() OVER (ORDER BY n DESC, item_idx) AS r FROM (SELECT item_idx, sum({weight})::DOUBLE AS n FROM dated WHERE y <= {y} GROUP BY 1)) c USING (item_idx)""" for k, y in enumerate(EPOCHS, 1))


cte("dated", "SELECT i.item_idx, year(b.event_time) AS y, CASE b.event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2 ELSE 4 END AS w FROM baskets b JOIN items i USING (product_id)")
cte("held", "SELECT item_idx FROM dated WHERE y = 2000")
cte("runs", f"{runs_sql('1', 'events')}\nUNION ALL {runs_sql('w', 'weighted')}")


@query("ev_24_table_of_runs", """
SELECT run, pearson_r, n_epochs, CAST(best_epoch AS INT) AS best_epoch, CASE WHEN pearson_r < -0.7 THEN 'strong negative' WHEN pearson_r < -0.3 THEN 'weak negative' ELSE 'decoupled' END AS verdict
FROM (SELECT run, round(corr(loss, recall), 6) AS pearson_r, count(*) AS n_epochs, max_by(epoch, recall - epoch * 1e-9) AS best_epoch FROM runs GROUP BY 1)""")
def _(t):
    path = scale.scratch_path(t.spark, "runs")
    weight = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "cart", 2).otherwise(4)
    dated = t.baskets.join(t.items.select("product_id", "item_idx"), "product_id").select("item_idx", F.year("event_time").alias("y"), weight.alias("w"))
    dated, n_items = scale.cut_lineage(dated), t.items.count()
    for run, value in (("events", F.lit(1)), ("weighted", F.col("w"))):
        for epoch, year in enumerate(EPOCHS, 1):
            row = evaluate.popularity_epoch(dated.where(F.col("y") <= year), dated.where("y = 2000"), n_items, value)
            files.append_metrics(row.select(F.lit(run).alias("run"), F.lit(epoch).alias("epoch"), "loss", "recall"), path)
    return evaluate.run_correlations(files.read_metrics(t.spark, path))


def models(t):
    return {
        "popular": recommend.rec_popular(t.pairs, t.stored_truth),
        "category": recommend.rec_category(t.pairs, t.items, t.stored_truth),
        "cooccurrence": recommend.rec_cooccurrence(t.pairs, t.stored_truth),
    }


BEST = ("SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS model, {averages_sql('gt')} FROM {m}" for n, m in (("popular", "m_pop"), ("category", "m_cat"), ("cooccurrence", "m_co")))
    + ") ORDER BY recall_10 DESC, model LIMIT 1")


@query("ev_23_best_run", BEST)
def _(t):
    return evaluate.best_run(evaluate.compare(models(t), t.stored_truth))


@query("top_07_arg_max", "SELECT max_by(cohort, recall) AS best FROM (SELECT cohort, round(avg(h10 / least(n_gt, 10)), 6) AS recall FROM m_pop JOIN cohorts USING (user_idx) WHERE cohort IS NOT NULL GROUP BY 1)")
def _(t):
    rows = evaluate.evaluate_stratified(popular(t), t.truth, t.pairs).where(F.col("cohort") != "overall")
    return rows.agg(F.max_by("cohort", "recall_10").alias("best"))


@query("ev_24_loss_recall_corr", """
SELECT round(corr(loss, recall), 6) AS pearson_r, count(*) AS n_points,
       CASE WHEN corr(loss, recall) < -0.7 THEN 'strong negative' WHEN corr(loss, recall) < -0.3 THEN 'weak negative' ELSE 'decoupled' END AS verdict
FROM (SELECT n_gt AS loss, h10 / least(n_gt, 10) AS recall FROM m_pop)""")
def _(t):
    users = evaluate.per_user(popular(t), t.truth).select(F.col("n_gt").cast("double").alias("loss"), F.col("recall_10").alias("recall"))
    return evaluate.loss_recall_corr(users)


cte("item_freq_sessions", "SELECT i AS target, row_number() OVER (ORDER BY count(*) DESC, i) AS rank FROM (SELECT unnest(item_seq) AS i FROM split_sessions WHERE split = 'train') WHERE i <> 0 GROUP BY 1")
SESSION_METRICS = """
SELECT count(*) AS n_sessions, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hr_10, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS hr_20,
       round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10, round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_20 FROM """


def session_targets(t):
    return sequences.prefix_target(sequences.add_contiguous_id(t.sessions["test"]), 20)


def session_recs(t, k):
    """Top items by the mean vector of each test prefix."""
    pre = session_targets(t).select(F.col("session_idx").alias("query_id"), F.explode("prefix_items").alias("item_idx")).where("item_idx <> 0")
    means = pre.join(t.vectors, "item_idx").groupBy("query_id").agg(*[F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(DIM)])
    queries = means.select("query_id", F.array(*[F.col(f"d{i}") for i in range(DIM)]).alias("vec"))
    return recommend.topk_similar(queries, t.vectors, k).withColumnRenamed("query_id", "session_idx")


cte("prefix_vec", """
SELECT session_idx, list(m ORDER BY i) AS v FROM (SELECT p.session_idx, g.i, avg(v.vec[g.i]) AS m FROM (SELECT session_idx, unnest(prefix_items) AS item_idx FROM test_targets) p
JOIN vecs v USING (item_idx), (SELECT unnest(range(1, 65)) AS i) g WHERE p.item_idx <> 0 GROUP BY 1, 2) GROUP BY 1""")
cte("prefix_recs", """
SELECT session_idx, item_idx, row_number() OVER (PARTITION BY session_idx ORDER BY score DESC, item_idx) AS rank FROM (
  SELECT p.session_idx, u.item_idx, list_dot_product(list_transform(p.v, lambda x: x / sqrt(list_dot_product(p.v, p.v))), u.v) AS score FROM prefix_vec p JOIN units u ON TRUE)""")


@query("ev_10_evaluate_sessions", SESSION_METRICS + "test_targets t LEFT JOIN prefix_recs r ON r.session_idx = t.session_idx AND r.item_idx = t.target")
def _(t):
    return evaluate.evaluate_sessions(session_recs(t, 20), session_targets(t))


@query("ev_11_session_popularity", SESSION_METRICS + "test_targets t LEFT JOIN item_freq_sessions f USING (target)")
def _(t):
    return evaluate.session_popularity(t.sessions["train"], session_targets(t))


@query("ev_12_seen_overlap", """
WITH r AS (SELECT count(*) AS gt_items, count(tp.user_idx) AS gt_seen FROM truth g LEFT JOIN tp ON tp.user_idx = g.user_idx AND tp.item_idx = g.item_idx)
SELECT *, round(gt_seen * 100 / gt_items, 4) AS seen_pct, gt_seen * 100 / gt_items > 80 AS warning FROM r""")
def _(t):
    return evaluate.seen_overlap(t.truth, t.pairs)


@query("ev_13_cold_warm", """
WITH u AS (SELECT c.cohort, m.user_idx, m.h10 / least(m.n_gt, 10) AS r, s.g, s.s FROM m_pop m JOIN cohorts c USING (user_idx) JOIN (
    SELECT g.user_idx, count(*) AS g, count(tp.user_idx) AS s FROM truth g LEFT JOIN tp ON tp.user_idx = g.user_idx AND tp.item_idx = g.item_idx GROUP BY 1) s USING (user_idx)
  WHERE c.cohort IS NOT NULL),
 b AS (SELECT * FROM u UNION ALL SELECT 'overall', user_idx, r, g, s FROM u)
SELECT cohort, count(*) AS n_users, sum(g)::BIGINT AS gt_items, sum(s)::BIGINT AS gt_seen, round(sum(s) * 100 / greatest(sum(g), 1), 4) AS filtered_pct, round(avg(r), 6) AS popularity_recall_10
FROM b GROUP BY 1""")
def _(t):
    return evaluate.cold_warm(t.pairs, t.truth)


@query("ev_14_user_diagnostics", """
WITH u AS (SELECT n_gt, h10 / least(n_gt, 10) AS r, coalesce(n_seen, 0) AS n FROM m_pop LEFT JOIN cohorts USING (user_idx))
SELECT count(*)::BIGINT AS n_users, min(n_gt) AS gt_min, max(n_gt) AS gt_max, round(avg(n_gt), 6) AS gt_mean, round(quantile_cont(n_gt, 0.5), 6) AS gt_p50, round(quantile_cont(n_gt, 0.9), 6) AS gt_p90,
  round(count(*) FILTER (n_gt = 1) * 100 / count(*), 4) AS pct_one_gt, count(*) FILTER (r > 0) AS hit_users, round(count(*) FILTER (r > 0) * 100 / count(*), 4) AS hit_pct,
  round(avg(r) FILTER (r > 0), 6) AS hit_recall_mean, round(quantile_cont(r, 0.5) FILTER (r > 0), 6) AS hit_recall_p50, round(quantile_cont(r, 0.75) FILTER (r > 0), 6) AS hit_recall_p75,
  round(avg(n_gt) FILTER (r = 0), 6) AS zero_gt_mean, round(avg(n) FILTER (r = 0), 6) AS zero_train_mean, round(quantile_cont(n, 0.5) FILTER (r = 0), 6) AS zero_train_p50,
  count(*) FILTER (r = 0 AND n <= 5) AS zero_cold, count(*) FILTER (r = 0 AND n > 5) AS zero_warm FROM u""")
def _(t):
    return evaluate.user_diagnostics(popular(t), t.truth, t.pairs)


COLLAPSE = """
WITH c AS (SELECT item_idx, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_idx) AS rk FROM rec_pop WHERE rank <= 10 GROUP BY 1)
SELECT sum(n)::BIGINT AS total_slots, count(*) AS unique_items, """ + ", ".join(
    f"sum(n) FILTER (rk <= {m})::BIGINT AS top_{m}_slots, round(sum(n) FILTER (rk <= {m}) * 100 / sum(n), 4) AS top_{m}_pct" for m in evaluate.COLLAPSE_STEPS
) + ", sum(n) FILTER (rk <= 50) * 100 / sum(n) > 20 AS collapsed FROM c"


@query("ev_15_popularity_collapse", COLLAPSE)
def _(t):
    return evaluate.popularity_collapse(popular(t))


@query("win_14_cumulative_slots", """
SELECT item_idx, slots, CAST(sum(slots) OVER (ORDER BY slots DESC, item_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
       row_number() OVER (ORDER BY slots DESC, item_idx) AS place FROM (SELECT item_idx, count(*) AS slots FROM rec_pop GROUP BY 1)""")
def _(t):
    slots = popular(t).groupBy("item_idx").agg(F.count(F.lit(1)).alias("slots"))
    return scale.add_running_total(slots, [F.desc("slots"), F.asc("item_idx")], "slots", "upto", "place")


@query("ev_16_test_item_coverage", """
WITH g AS (SELECT DISTINCT i.item_idx FROM btest b JOIN ivoc i USING (product_id) WHERE b.event_type = 'purchase'),
     r AS (SELECT count(*) AS gt_items, count(*) FILTER (item_idx IN (SELECT item_idx FROM tpenc)) AS seen FROM g)
SELECT *, gt_items - seen AS never_seen, round(seen * 100 / gt_items, 4) AS seen_pct FROM r""")
def _(t):
    users, items = features.id_vocab(t.im, "user_id"), features.id_vocab(t.item_features, "product_id", 1)
    return evaluate.test_item_coverage(t.test, items, features.train_pairs(t.im, users, items))


@query("ev_17_gt_quality", """
WITH p AS (SELECT b.user_id, b.product_id, u.user_idx FROM btest b LEFT JOIN uvoc u USING (user_id) WHERE b.event_type = 'purchase'),
     s AS (SELECT user_idx, count(DISTINCT product_id) AS g FROM p WHERE user_idx IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS purchases, (SELECT count(DISTINCT user_id) FROM p) AS buyers, (SELECT count(user_idx) FROM p) AS known_rows,
  (SELECT round(avg(g), 6) FROM s) AS items_per_user, (SELECT count(*) FROM s WHERE g = 1) AS one_item, (SELECT count(*) FROM s WHERE g >= 2) AS two_or_more,
  (SELECT count(DISTINCT product_id) FROM p WHERE user_idx IS NOT NULL) AS gt_items,
  (SELECT count(DISTINCT product_id) FROM p WHERE user_idx IS NOT NULL AND product_id IN (SELECT product_id FROM im)) AS in_vocab""")
def _(t):
    return evaluate.gt_quality(t.test, features.id_vocab(t.im, "user_id"), features.id_vocab(t.im, "product_id", 1))


def spread_sql(col: str, src: str, prefix: str = "") -> str:
    points = ", ".join(f"round(quantile_cont({col}, {p}), 6) AS {prefix}p{round(p * 100)}" for p in (0.1, 0.5, 0.9))
    return f"SELECT round(avg({col}), 6) AS {prefix}mean, round(stddev_pop({col}), 6) AS {prefix}std, {points} FROM {src}"


@query("ev_18_pairwise_cosine", spread_sql("s", f"""(SELECT list_dot_product(a.v, b.v) AS s FROM (SELECT * FROM units ORDER BY {draw_sql(42, 'item_idx')}, item_idx LIMIT 1000) a
JOIN (SELECT * FROM units ORDER BY {draw_sql(42, 'item_idx')}, item_idx LIMIT 1000) b ON a.item_idx <> b.item_idx)"""))
def _(t):
    return evaluate.pairwise_cosine(t.vectors, 1000)


@query("ev_18_paired_cosine", "SELECT p.user_idx, p.item_idx, round(list_dot_product(u.v, i.v), 6) AS score FROM ctp p JOIN uvecs u USING (user_idx) JOIN units i USING (item_idx)")
def _(t):
    return rounded(evaluate.paired_cosine(t.click_pairs.select("user_idx", "item_idx"), user_vectors(t), t.vectors))


@query("ev_18_paired_stats", spread_sql("s", "(SELECT list_dot_product(u.v, i.v) AS s FROM ctp p JOIN uvecs u USING (user_idx) JOIN units i USING (item_idx))"))
def _(t):
    return evaluate.paired_cosine_stats(t.click_pairs.select("user_idx", "item_idx"), user_vectors(t), t.vectors)


cte("batched", f"""
SELECT user_idx, item_idx, (row_number() OVER (ORDER BY {draw_sql(42, 'user_idx', 'item_idx')}, user_idx, item_idx) - 1) // 2048 AS batch FROM ctp""")
cte("batch_pairs", """
SELECT a.user_idx = b.user_idx AND a.item_idx = b.item_idx AS positive, list_dot_product(u.v, i.v) AS s FROM batched a JOIN batched b ON a.batch = b.batch
JOIN uvecs u ON u.user_idx = a.user_idx JOIN units i ON i.item_idx = b.item_idx WHERE a.batch < 5""")


@query("ev_19_batch_scores", f"""
SELECT p.*, n.*, round(p.pos_mean - n.neg_mean, 6) AS gap, (SELECT count(*) FROM batch_pairs WHERE positive) AS n_positive, (SELECT count(*) FROM batch_pairs WHERE NOT positive) AS n_negative
FROM ({spread_sql('s', 'batch_pairs WHERE positive', 'pos_')}) p, ({spread_sql('s', 'batch_pairs WHERE NOT positive', 'neg_')}) n""")
def _(t):
    return evaluate.batch_scores(t.click_pairs, user_vectors(t), t.vectors, 2048, 5)


@query("ev_20_gt_vs_random", f"""
WITH pool AS (SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT item_idx FROM ctp WHERE item_idx IN (SELECT item_idx FROM vecs))),
     d AS (SELECT user_idx, (({draw_sql(42, 'user_idx')}) + k * greatest((SELECT max(n) FROM pool) // 10, 1)) % (SELECT max(n) FROM pool) AS pos FROM (SELECT DISTINCT user_idx FROM ctruth), range(10) r(k)),
     r AS (SELECT d.user_idx, round(avg(list_dot_product(u.v, i.v)), 9) AS r FROM d JOIN pool USING (pos) JOIN uvecs u USING (user_idx) JOIN units i USING (item_idx) GROUP BY 1),
     g AS (SELECT g.user_idx, round(avg(list_dot_product(u.v, i.v)), 9) AS g FROM ctruth g JOIN uvecs u USING (user_idx) JOIN units i USING (item_idx) GROUP BY 1),
     b AS (SELECT * FROM g JOIN r USING (user_idx))
SELECT x.*, y.*, z.* FROM ({spread_sql('g', 'b', 'gt_')}) x, ({spread_sql('r', 'b', 'random_')}) y, (SELECT count(*) AS n_users, round(avg(g - r), 6) AS gap FROM b) z""")
def _(t):
    return evaluate.gt_vs_random(click_truth(t), t.click_pairs, user_vectors(t), t.vectors)


@query("ev_21_first_hit_rank", """
SELECT g.user_idx, min(r.rank) AS first_rank, coalesce(min(r.rank) <= 10, FALSE) AS in_top_10, coalesce(min(r.rank) <= 100, FALSE) AS in_top_100, coalesce(min(r.rank) <= 1000, FALSE) AS in_top_1000
FROM ctruth g LEFT JOIN vec_recs r ON r.user_idx = g.user_idx AND r.item_idx = g.item_idx AND r.rank <= 1000 GROUP BY 1""")
def _(t):
    return evaluate.first_hit_rank(vector_recs(t, 1000), click_truth(t))


@query("ev_22_score_profile", """
WITH s AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_idx) AS rk FROM vec_scores WHERE user_idx = (SELECT min(user_idx) FROM uvecs))
SELECT count(*) AS n_items, round(max(score), 6) AS max, round(min(score), 6) AS min, round(stddev_pop(score), 6) AS std, round(avg(score) FILTER (rk <= 10), 6) AS top_10_mean,
       round(avg(score) FILTER (rk <= 100), 6) AS top_100_mean, round(median(score), 6) AS median FROM s""")
def _(t):
    # The profile describes one query: the first user.
    users = user_vectors(t)
    one = users.orderBy("user_idx").limit(1)
    index = recommend.restrict_index(t.vectors, t.click_pairs)
    vec = one.select(unit("vec").alias("v")).scalar()
    from clickloom.functions import dot

    scores = index.withColumn("_q", vec).select("item_idx", dot("_q", unit("vec")).alias("score"))
    return evaluate.score_profile(scores)


@query("ev_25_leave_one_out", """
WITH l AS (SELECT user_id, max(event_time) AS event_time FROM clicks WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2)
SELECT c.event_id, c.user_id, count(*) AS copies FROM clicks c JOIN l ON l.user_id = c.user_id AND l.event_time = c.event_time WHERE c.event_type = 'purchase' GROUP BY 1, 2""")
def _(t):
    held = tables.leave_one_out(t.clicks)[1]
    return held.groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("copies"))
