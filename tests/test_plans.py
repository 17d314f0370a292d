"""Plan checks: no Python in native operators, no nested-loop joins, pruned scans."""

import pytest

from webgleaner.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
NATIVE = (
    "p2_url_normalize p5_url_resolve p8_domain_rules j3_rule_join p10_private_host p13_request_violations g1_link_edges c1_markdown c2_script_noise "
    "c3_tier_route s3_sitemap_urls l2_summary_prompt l4_combined_prompt l5_recover_json l7_schema_check s14_fetch_outcome w4_failure_runs a13_inflight_over_time r6_task_status"
).split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = plan_of(all_queries()[name](spark, SF))
    for node in ("EvalPython", "MapInPandas", "NestedLoopJoin", "CartesianProduct"):
        assert node not in plan, node


def test_scans_are_pruned(spark):
    plan = plan_of(all_queries()["p2_url_normalize"](spark, SF))
    assert "html" not in plan.split("ReadSchema")[1]


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
