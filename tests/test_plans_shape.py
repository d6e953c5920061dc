"""Plans keep to the shuffles that they need."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from spanforge import catalogue
from spanforge.shared import worked_out
from tests.conftest import DATA


@pytest.mark.parametrize(("name", "most"), [("hit_filter", 0), ("gap_islands", 1), ("two_level_gap_groups", 1), ("interval_union", 1), ("keyed_interval_merge", 1), ("persist_tracks", 1), ("hopping_text_windows", 1), ("class_pattern_score", 0), ("suppressed_top_k", 1)])
def test_shuffles(spark, name, most):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_no_catalogue_query_joins_without_an_equality(spark):
    for name, query in catalogue.QUERIES.items():
        plan = query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan, name


@pytest.mark.parametrize("name", ["context_before_span_after", "span_hits_top_n"])
def test_interval_joins_have_the_bucket_in_their_equality(spark, name):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan.split("Join Inner", 1)[1].split("\n")[0]


@pytest.mark.parametrize("name", ["refine_start", "overlap_semi_filter", "padded_overlap"])
def test_sweeps_repeat_no_row_and_deal_by_bucket(spark, name):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
    assert "__bucket" in plan.split("Join LeftOuter", 1)[1].split("\n")[0]


@pytest.mark.parametrize("name", ["nearest_snap", "tolerance_anti"])
def test_nearest_instants_are_swept_and_not_joined(spark, name):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "__bucket" in plan.split("Window", 1)[1].split("\n")[0]
    assert "unboundedfollowing" not in plan


def test_a_column_worked_out_once_is_not_copied_into_filters(spark):
    df = worked_out(spark.range(9), h=F.sha2(F.col("id").cast("string"), 256)).where("h > 'a' AND h < 'b'").withColumn("g", F.concat("h", "h"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and df.count() == sum("a" < sha256(str(i).encode()).hexdigest() < "b" for i in range(9))
