"""Registered queries against their SQL on the smallest tables, and plan checks."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, cell, key, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
SAMPLE = (
    "fun01_funnel ses02_summary pat07_event_flow jou05_stage_drop_off att07_compare_models fea09_rfm coh08_retention sco03_health "
    "sur03_kaplan_meier rea03_scores ano04_users mer02_health pro02_performance sea02_top_searches del03_by_hour aff03_association_rules "
    "rec06_recommend_all eva08_user_metrics crm03_lapsed tre08_repeat_favorites mlb20_ltv_features src27_order_lines dsh11_hourly_table"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(cell(x) for x in r) for r in df.select(*sorted(df.columns)).collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = [tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()]
    assert sorted(cols) == sorted(df.columns) and len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


NO_JOIN_WITHOUT_KEY = "fun01_funnel fun03_drop_off ses01_sessions jou09_time_between_stages att07_compare_models fea09_rfm rec05_item_similarity rec04_recommend_popular aff02_product_pairs".split()


@pytest.mark.parametrize("name", NO_JOIN_WITHOUT_KEY)
def test_plans_have_no_keyless_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 4
