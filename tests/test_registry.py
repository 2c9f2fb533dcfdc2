"""Every key runs beside its SQL. A sample by default; set CLICKLOOM_ALL=1 for all keys."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUICK = ("src_06", "flt_05", "cln_02", "cln_04_k_core_report", "agg_02", "agg_06", "win_01", "fe_02", "seq_01", "rec_01_popular", "ev_09", "neg_07", "dr_05")
ORACLES = entry.oracle_sql()
KEYS = [k for k in ORACLES if os.environ.get("CLICKLOOM_ALL") or k.startswith(QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    problem = difference(entry.queries()[key](spark, SF), con, ORACLES[key])
    assert problem is None, problem


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
