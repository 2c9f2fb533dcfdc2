"""Near-dedup on tables with repeated and missing ids."""

from clickloom.llm import simhash

A, B = "the calm sea under a bright moon tonight", "seven engineers rebuilt an old bridge of iron"


def test_repeated_ids_are_decided_by_row(spark):
    # Id 5 is a copy of 2 in one component and the smallest of another.
    rows = [(2, A), (5, A), (5, B), (9, B), (None, A), (None, A), (None, B)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.fingerprint(A) != simhash.fingerprint(B)
    kept = sorted(map(tuple, simhash.near_dedup(docs).collect()), key=str)
    # A row without id is a copy like any other.
    assert kept == [(2, A), (5, B)]


def test_one_row_stays_of_rows_that_differ_in_case(spark):
    docs = spark.createDataFrame([(5, A), (5, A.upper()), (7, A), (None, B), (None, B), (None, B.upper())], "doc_id long, text string")
    kept = simhash.near_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.text.lower()) for r in kept) == [(False, A), (True, B)]


def test_columns_named_like_the_keys_stay(spark):
    rows = [(1, A, 10, "x", True), (2, A, 20, "y", False), (3, B, 30, "z", True), (3, B, 30, "z", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, _row_key string, stays boolean")
    assert sorted(map(tuple, simhash.near_dedup(docs).collect())) == [rows[0], rows[2]]
