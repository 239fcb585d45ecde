"""Every query with a statement agrees with DuckDB on the given tables."""

from pathlib import Path

import pytest
from compare import check, connect
from conftest import SMALL

import __spark_entry__ as entry
from touchline.operators import profile

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert check(spark, con, QUERIES[name], ORACLE[name], SMALL) == ""


@pytest.mark.parametrize("name", ["plays", "match_features", "team_profile",
                                  "passing_breakdown", "heat_map_us"])
def test_plan_is_one_scan_without_python_or_cross_joins(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint" in plan
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_statements_do_not_share_code_with_the_operators():
    plans = Path(entry.__file__).parent / "touchline" / "plans"
    for path in plans.glob("oracle_*.py"):
        text = path.read_text()
        assert "touchline.operators" not in text and "plans.registry" not in text
    assert "oracle" not in (plans / "catalogue.py").read_text()


def test_a_wrong_denominator_is_noticed(spark, con, monkeypatch):
    top, _ = profile.RATIOS["crossfieldPlay_pcnt"]
    monkeypatch.setitem(profile.RATIOS, "crossfieldPlay_pcnt", (top, ["totalPasses"]))
    assert check(spark, con, QUERIES["team_profile"], ORACLE["team_profile"], SMALL) != ""
