"""Sequence and drift queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clickloom.functions import text_list, time_text
from clickloom.operators import drift, eda, sequences
from clickloom.plans.q_features import drift_windows, rounded
from clickloom.plans.registry import TEST_START, TRAIN_END, cte, query

MAX_LEN = 20


def seq_text(df, *names):
    """Array columns as text."""
    return df.withColumns({c: text_list(c) for c in names})


def join_list(x: str) -> str:
    return f"array_to_string({x}, ',')"


def pad_sql(x: str, n: int) -> str:
    kept = f"CASE WHEN len({x}) > {n} THEN {x}[-{n}:] ELSE {x} END"
    return f"list_concat(list_transform(range(greatest({n} - len({x}), 0)), lambda z: 0::BIGINT), {kept})"


@query("seq_01_session_sequences", f"SELECT split, user_idx, user_session, {join_list('item_seq')} AS item_seq, {join_list('event_seq')} AS event_seq, seq_len FROM split_sessions")
def _(t):
    out = None
    for name, df in t.sessions.items():
        one = seq_text(df, "item_seq", "event_seq").withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


cte("whole_sessions", """
SELECT user_idx, user_session, list(item_idx ORDER BY event_time, event_id) AS item_seq, count(*) AS seq_len FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx, user_session ORDER BY event_time DESC, event_id DESC) AS age FROM (
    SELECT *, lag(item_idx) OVER (PARTITION BY user_idx, user_session ORDER BY event_time, event_id) AS prev FROM mapped_once) WHERE prev IS NULL OR prev <> item_idx)
WHERE age <= 20 GROUP BY 1, 2 HAVING count(*) >= 2""")


@query("seq_02_repeat_truncate_filter", f"SELECT user_idx, user_session, {join_list('item_seq')} AS item_seq, seq_len FROM whole_sessions")
def _(t):
    return seq_text(sequences.session_sequences(t.mapped), "item_seq").drop("event_seq")


@query("seq_03_contiguous_id", "SELECT user_idx, user_session, row_number() OVER (ORDER BY user_idx, user_session) - 1 AS session_idx FROM split_sessions WHERE split = 'train'")
def _(t):
    return sequences.add_contiguous_id(t.sessions["train"]).select("user_idx", "user_session", "session_idx")


@query("seq_04_sequence_profile", """
SELECT count(*) AS sequences, min(seq_len) AS min_len, max(seq_len) AS max_len, round(avg(seq_len), 6) AS mean_len, round(quantile_cont(seq_len, 0.5), 6) AS p50_len,
       round(quantile_cont(seq_len, 0.9), 6) AS p90_len, round(quantile_cont(seq_len, 0.99), 6) AS p99_len, round(count(*) FILTER (seq_len > 10) * 100 / count(*), 4) AS pct_over_max,
       count(DISTINCT user_idx) AS users, round(count(*) / count(DISTINCT user_idx), 6) AS per_user FROM whole_sessions""")
def _(t):
    return sequences.sequence_profile(sequences.session_sequences(t.mapped), 10)


cte("user_seqs", f"""
SELECT user_idx, list(item_idx ORDER BY event_time, event_id) AS item_seq, list(event_idx ORDER BY event_time, event_id) AS event_seq, count(*) AS seq_len
FROM mapped_once WHERE event_time < TIMESTAMP '{TRAIN_END}' GROUP BY 1 HAVING count(*) >= 2""")


@query("seq_05_user_sequences", f"SELECT user_idx, CAST(0 AS BIGINT) AS chunk, {join_list('item_seq')} AS item_seq, {join_list('event_seq')} AS event_seq, seq_len FROM user_seqs")
def _(t):
    return seq_text(sequences.user_sequences(t.mapped, datetime.fromisoformat(TRAIN_END)), "item_seq", "event_seq")


@query("seq_05_user_sequences_full", f"""
SELECT user_idx, CAST(0 AS BIGINT) AS chunk, array_to_string(list(item_idx ORDER BY event_time, event_id), ',') AS item_seq, count(*) AS seq_len
FROM mapped_once WHERE event_time < TIMESTAMP '{TEST_START}' GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return seq_text(sequences.user_sequences(t.mapped, datetime.fromisoformat(TEST_START)), "item_seq").drop("event_seq")


@query("seq_06_val_targets", f"""
SELECT user_idx, item_idx, event_type, product_id, user_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY event_time, event_id) AS rn FROM mapped_once
  WHERE event_time >= TIMESTAMP '{TRAIN_END}' AND event_time < TIMESTAMP '{TEST_START}' AND event_type IN ('cart', 'purchase')) WHERE rn = 1""")
def _(t):
    out = sequences.val_targets(t.mapped, datetime.fromisoformat(TRAIN_END), datetime.fromisoformat(TEST_START))
    return out.withColumn("event_time", time_text("event_time"))


@query("seq_07_left_pad", f"SELECT user_idx, user_session, {join_list(pad_sql('item_seq', 4))} AS short, {join_list(pad_sql('item_seq', 7))} AS long FROM split_sessions WHERE split = 'train'")
def _(t):
    from clickloom.functions import left_pad

    return t.sessions["train"].select("user_idx", "user_session", text_list(left_pad("item_seq", 4)).alias("short"), text_list(left_pad("item_seq", 7)).alias("long"))


@query("seq_08_shift_targets", f"""
SELECT user_idx, user_session, seq_len, {join_list(f'p[:{MAX_LEN - 1}]')} AS input_items, {join_list(f'e[:{MAX_LEN - 1}]')} AS input_events, {join_list('p[2:]')} AS target_items,
       array_to_string(list_transform(p[2:], lambda x: x <> 0), ',') AS mask
FROM (SELECT *, {pad_sql('item_seq', MAX_LEN)} AS p, {pad_sql('event_seq', MAX_LEN)} AS e FROM split_sessions WHERE split = 'train')""")
def _(t):
    return seq_text(sequences.shift_targets(t.sessions["train"], MAX_LEN), "input_items", "input_events", "target_items", "mask")


cte("test_targets", f"""
SELECT user_idx, user_session, seq_len, item_seq[-1] AS target, {pad_sql('item_seq[:-2]', MAX_LEN - 1)} AS prefix_items, {pad_sql('event_seq[:-2]', MAX_LEN - 1)} AS prefix_events,
       row_number() OVER (ORDER BY user_idx, user_session) - 1 AS session_idx FROM split_sessions WHERE split = 'test'""")


@query("seq_09_prefix_target", f"SELECT user_idx, user_session, seq_len, target, {join_list('prefix_items')} AS prefix_items, {join_list('prefix_events')} AS prefix_events FROM test_targets")
def _(t):
    return seq_text(sequences.prefix_target(t.sessions["test"], MAX_LEN), "prefix_items", "prefix_events")


@query("seq_10_user_prefix", f"""
SELECT u.user_idx, {join_list(f"coalesce({pad_sql('s.item_seq', 10)}, list_transform(range(10), lambda z: 0::BIGINT))")} AS prefix_items,
       {join_list(f"coalesce({pad_sql('s.event_seq', 10)}, list_transform(range(10), lambda z: 0::BIGINT))")} AS prefix_events, s.item_seq IS NOT NULL AS has_history
FROM user_vocab u LEFT JOIN user_seqs s USING (user_idx)""")
def _(t):
    users = t.click_vocabs[0].toDF("user_id", "user_idx")
    prefix = sequences.user_prefix(users, t.mapped, 10, datetime.fromisoformat(TRAIN_END))
    return seq_text(prefix, "prefix_items", "prefix_events")


@query("seq_11_prefix_pairs", f"""
SELECT user_idx, user_session, CAST(k AS INT) AS t, {join_list('item_seq[:k]')} AS prefix, item_seq[k + 1] AS target FROM (
  SELECT *, unnest(range(1, seq_len)) AS k FROM split_sessions WHERE split = 'train')""")
def _(t):
    return seq_text(sequences.prefix_pairs(t.sessions["train"]), "prefix")


@query("seq_12_user_history", f"""
SELECT user_idx, {join_list(pad_sql('h', 20))} AS history FROM (SELECT user_idx, list(item_idx ORDER BY last_interaction, item_idx) AS h FROM (
  SELECT user_id AS user_idx, product_id + 1 AS item_idx, last_interaction, row_number() OVER (PARTITION BY user_id ORDER BY last_interaction DESC, product_id DESC) AS rn FROM im)
WHERE rn <= 20 GROUP BY 1)""")
def _(t):
    tp = t.im.select(F.col("user_id").alias("user_idx"), (F.col("product_id") + 1).alias("item_idx"), "last_interaction")
    return seq_text(sequences.user_history(tp, 20), "history")


@query("seq_13_validate_sequences", "\nUNION ALL ".join(
    f"""SELECT '{s}' AS split, count(*) AS n_rows, count(*) FILTER (len(item_seq) > {MAX_LEN}) AS too_long, count(*) FILTER (len(item_seq) < 2) AS too_short,
  count(*) FILTER (item_seq[-1] = 0) AS pad_last, CAST(0 AS BIGINT) AS adjacent_repeats, CAST(0 AS BIGINT) AS uneven, TRUE AS rows_match FROM split_sessions WHERE split = '{s}'"""
    for s in ("train", "val", "test")))
def _(t):
    meta = sequences.session_metadata(t.sessions, MAX_LEN)
    out = None
    for name, df in t.sessions.items():
        one = sequences.validate_sequences(df, 2, MAX_LEN, meta.select(f"n_{name}").scalar()).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("seq_14_sessionize", """
SELECT event_id, user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (
  SELECT *, CASE WHEN lag(event_time) OVER w IS NULL OR epoch(date_trunc('second', event_time)) - epoch(date_trunc('second', lag(event_time) OVER w)) >= 86400 THEN 1 ELSE 0 END AS s
  FROM deduped WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id))""")
def _(t):
    from clickloom.operators import clean

    ev = clean.exact_dedup(clean.drop_null_session(clean.fill_unknown(t.clicks)))
    return sequences.sessionize(ev, 86_400).select("event_id", "user_id", "session_no")


@query("seq_15_flag_long_sessions", "SELECT user_session, seconds, seconds > 3600 AS is_broken FROM session_spans")
def _(t):
    return eda.flag_long_sessions(t.clicks)


# --------------------------------------------------------------------------- drift

cte("jsd_rows", """
SELECT (p + 1e-10) / (1 + 1e-10 * u) AS a, (q + 1e-10) / (1 + 1e-10 * u) AS b FROM (
  SELECT coalesce(p.share, 0) AS p, coalesce(q.share, 0) AS q, count(*) OVER () AS u FROM drift_p p FULL JOIN drift_q q ON p.item_id = q.item_id)""")
JSD = "(SELECT (sum(a * ln(a / ((a + b) / 2))) + sum(b * ln(b / ((a + b) / 2)))) / 2 / ln(2) FROM jsd_rows)"
cte("top_p", "SELECT *, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM drift_p")
cte("top_q", "SELECT *, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM drift_q")


def shares(t):
    a, b = drift_windows(t)
    return drift.item_shares(a), drift.item_shares(b)


@query("dr_01_popularity", "SELECT item_id, n, round(share, 6) AS share, rank FROM top_p")
def _(t):
    return rounded(drift.popularity(drift_windows(t)[0]))


@query("dr_02_jsd", f"SELECT round({JSD}, 6) AS jsd")
def _(t):
    return rounded(drift.jsd(*shares(t)))


OVERLAP = "(SELECT count(*) * 100.0 / 50 FROM top_p p JOIN top_q q USING (item_id) WHERE p.rank <= 50 AND q.rank <= 50)"
COVER = "(SELECT count(*) FILTER (item_id IN (SELECT item_id FROM drift_p)) * 100.0 / count(*) FROM drift_q)"


@query("dr_03_top_overlap", f"SELECT {OVERLAP}::DOUBLE AS overlap_pct")
def _(t):
    return drift.top_overlap(*shares(t))


@query("dr_04_coverage", f"SELECT round({COVER}, 6)::DOUBLE AS coverage_pct")
def _(t):
    return rounded(drift.coverage(*shares(t)))


def report_sql(threshold: float) -> str:
    return f"""
SELECT 'train' AS train_window, 'test' AS test_window, round({JSD}, 4) AS jsd_normalized, round({OVERLAP}::DOUBLE, 1) AS top_item_overlap_pct,
       round({COVER}::DOUBLE, 1) AS test_item_coverage_pct, (SELECT count(*) FROM drift_p) AS n_train_items, (SELECT count(*) FROM drift_q) AS n_test_items,
       (SELECT sum(n)::BIGINT FROM drift_p) AS n_train_events, (SELECT sum(n)::BIGINT FROM drift_q) AS n_test_events, {JSD} > {threshold} AS alert,
       {threshold}::DOUBLE AS alert_threshold, (SELECT string_agg(item_id, ',' ORDER BY rank) FROM top_p WHERE rank <= 20) AS train_top20_items,
       (SELECT string_agg(item_id, ',' ORDER BY rank) FROM top_q WHERE rank <= 20) AS test_top20_items"""


def report(t, threshold):
    out = drift.drift_report(*drift_windows(t), threshold)
    return seq_text(out, "train_top20_items", "test_top20_items").drop("narrative", "train_top20_probs", "test_top20_probs")


@query("dr_05_drift_report", report_sql(0.1))
def _(t):
    return report(t, 0.1)


@query("dr_05_drift_report_alert", report_sql(0.0001))
def _(t):
    return report(t, 0.0001)


@query("dr_06_top_share_table", """
SELECT p.item_id, round(p.share, 6) AS train_share, round(coalesce(q.share, 0), 6) AS test_share FROM top_p p LEFT JOIN (SELECT * FROM top_q WHERE rank <= 20) q USING (item_id) WHERE p.rank <= 20""")
def _(t):
    return rounded(drift.top_share_table(*shares(t)))


@query("dr_07_rank_shift", """
SELECT item_id, CAST(p.rank AS INT) AS train_rank, CAST(q.rank AS INT) AS test_rank, CAST(q.rank - p.rank AS INT) AS shift FROM top_p p JOIN top_q q USING (item_id) WHERE p.rank <= 40 AND q.rank <= 40""")
def _(t):
    return drift.rank_shift(*shares(t), 40)
