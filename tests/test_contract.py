"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import sys

import pytest

import __spark_entry__ as entry
from contract.oracles import all_oracles
from contract.queries import all_queries
from tests import seed
from tianguis.operators import sales
from tianguis.sources import sinks
from tianguis.sources.tables import read_table
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, con, name):
    state, _, _, _, note = compare(spark, con, name, SF)
    # The whole nested row carries a time stamp: its sections, and the order in its lists, have SQL of their own.
    assert state == ("rows" if name == "report_nested" else "ok"), note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) - set(all_oracles()) == {"report_nested"}


def test_a_missing_package_of_the_optional_part_leaves_the_rest(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tianguis.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert set(entry.queries()) == set(all_queries()) and set(entry.oracle_sql()) == set(all_oracles())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5]


def plan(spark, name, mode="formatted"):
    df = entry.queries()[name](spark, SF)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


LAZY = [n for n in all_queries() if not n.startswith("stream_") and not n.endswith(("_kept", "_in_place"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_crossing_and_no_python_in_plans(spark, name):
    text = plan(spark, name, "simple")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "top_products")
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text
    assert "TakeOrderedAndProject" in text


def test_state_filter_reaches_the_scan(spark, tmp_path):
    """On the canonical tables, where the state is a stored column."""
    sinks.export_table(seed.frames(spark)["ordenes"], str(tmp_path), "ordenes")
    df = sales.revenue_by_month(read_table(spark, str(tmp_path), "ordenes"))
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(estado,pagada)" in text and "ReadSchema: struct<total:decimal(10,2),estado:string,fecha:timestamp>" in text


def test_history_limits_before_the_shuffle(spark):
    text = plan(spark, "movement_history", "simple")
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")
