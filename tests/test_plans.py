"""Shape of the physical plans."""

import pytest

from paths import SMALL
from farewheel.plans.inspect import plan_shape
from farewheel.plans.registry import TABLE_QUERIES
from farewheel.sources.warehouse import open_tables

ML = {"cluster_k_sweep", "cluster_profiles", "cluster_centres", "cluster_continuous", "cluster_labels", "cluster_projection", "persona_feature_profile"}


@pytest.mark.parametrize("name", sorted(set(TABLE_QUERIES) - ML))
def test_no_cross_join_and_no_python(spark, name):
    shape = plan_shape(TABLE_QUERIES[name](open_tables(spark, SMALL)))
    assert shape.cartesian_products == 0 and shape.python_nodes == 0
    assert shape.nested_loop_joins == 0
    # several distinct aggregates side by side would multiply rows before the shuffle
    assert shape.row_expansions == (name in {"breakeven", "north_star_90d"})


def test_funnel_reads_only_what_it_needs(spark):
    tables = open_tables(spark, SMALL)
    shape = plan_shape(TABLE_QUERIES["funnel_daily"](tables))
    assert sorted(shape.read_schemas) == [
        "struct<user_id:bigint,event_type:string,event_at:timestamp_ntz>",
        "struct<user_id:bigint,started_at:timestamp_ntz,user_type:string>",
    ]
    assert all(">= 2023-12-01" in f for f in shape.partition_filters)
    assert all("GreaterThanOrEqual" in f for f in shape.pushed_filters)
    # rider-days of both sides, riders per date, dates, one window, one sort
    assert shape.exchanges <= 6


@pytest.mark.parametrize("name", [
    "funnel_by_persona", "signup_step_dropoff", "churn_early_warning", "classify_riders", "persona_summary",
    "ebike_savings", "priority_nudge_targets", "member_ytd_savings", "nudge_eligibility",
])
def test_windows_of_time_prune_months(spark, name):
    shape = plan_shape(TABLE_QUERIES[name](open_tables(spark, SMALL)))
    assert any("_month" in f and ">=" in f for f in shape.partition_filters)


def test_classification_needs_one_shuffle_and_a_sort(spark):
    shape = plan_shape(TABLE_QUERIES["classify_riders"](open_tables(spark, SMALL)))
    assert shape.exchanges == 2


def test_top_k_is_no_full_sort(spark):
    from farewheel.plans.inspect import explain_text

    text = explain_text(TABLE_QUERIES["priority_nudge_targets"](open_tables(spark, SMALL)))
    assert "TakeOrderedAndProject" in text
