"""Plan assertions: no Python on the hot path, no cartesian products, pushdown and pruning reach the scan."""

import pytest

from agrispark.plans.registry import load_all
from conftest import SF_SMALL

REG = load_all()
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if e.sql))
def test_sql_checked_queries_stay_in_the_jvm(spark, name):
    p = plan(REG[name].fn(spark, SF_SMALL))
    assert not [k for k in FORBIDDEN if k in p]


def test_column_pruning_reaches_parquet(spark):
    p = plan(REG["S2_scan_columns"].fn(spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_filters_pushed_to_scan(spark):
    p = plan(REG["F8_in_box"].fn(spark, SF_SMALL))
    assert "PushedFilters: []" not in p and "PushedFilters: [IsNotNull(" in p
    from agrispark.plans import views as V
    from pyspark.sql import functions as F
    df = V.read(spark, SF_SMALL, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    assert "GreaterThan(l_quantity,10.0)" in plan(df)


def test_scenarios_are_a_generator_not_a_join(spark):
    p = plan(REG["J8_apply_scenarios"].fn(spark, SF_SMALL))
    assert "Generate" in p and "Join" not in p


def test_nearest_centroid_is_a_projection(spark):
    p = plan(REG["J9_nearest_centroid_emb"].fn(spark, SF_SMALL))
    assert "Join" not in p


def test_timeline_window_shares_one_sort(spark):
    p = plan(REG["ML17_build_timeline"].fn(spark, SF_SMALL))
    assert p.count("Window [") == 1


@pytest.mark.parametrize("name", ["F7_allowed_labels", "ML10_recommend_hybrid", "ML11_classify_with_constraints", "ML12_recommend_zone", "Q6_forbidden_label_check",
                                  "X5_climate_weight", "X19_renormalise", "X22_insight_text", "X23_confidence_gate", "X27_merge_results"])
def test_rows_and_their_scores_are_never_broadcast(spark, name):
    # the customer file is far below the broadcast threshold here, as a well-packed one of a million rows is
    df = REG[name].fn(spark, SF_SMALL)
    lines = plan(df).splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            below = []
            for x in lines[i + 1:]:
                if len(x) - len(x.lstrip(" :+-*()0123456789")) <= depth:
                    break
                below.append(x)
            assert not [x for x in below if "FileScan" in x], line
