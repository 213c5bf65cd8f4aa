"""Plans: filters and columns reach the scan, no products of tables, no Python where built-ins do."""

import re

import pytest

from millrace.plans import catalogue, monitoring, patterns

QUERIES = catalogue.QUERIES | monitoring.QUERIES
FOLDS = {
    "inbox_dedup_ttl", "inbox_redelivery_ttl", "idempotent_responses", "rate_limit_sliding_check_first", "rate_limit_anchored_counter",
    "circuit_breaker_transitions", "endpoint_breaker_outcomes", "checkpoint_cas", "aggregate_user_fold",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FOLDS))
def test_built_ins_only(spark, sf, name):
    text = plan(QUERIES[name][0](spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_shuffle_once_and_never_collect(spark, sf, name):
    text = plan(QUERIES[name][0](spark, sf))
    assert "MapInArrow" in text and text.count("Exchange hashpartitioning") == 1 and "collect_list" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    relay = plan(catalogue.outbox_relay_batch(spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in relay and "TakeOrderedAndProject" in relay
    assert "o_clerk" not in relay
    prefix = plan(monitoring.autocomplete_prefix(spark, sf))
    assert "GreaterThanOrEqual(p_name,re)" in prefix and "ReadSchema: struct<p_name:string>" in prefix
    views = plan(catalogue.feature_point_in_time(spark, sf))
    assert "Join" not in views and views.count("Exchange hashpartitioning") == 1


def test_aggregates_combine_before_the_shuffle(spark, sf):
    for name in ("cdc_latest_state", "saga_status", "tumbling_daily", "topic_lag", "histogram_buckets", "latency_p95_nearest_rank"):
        assert "partial_" in plan(QUERIES[name][0](spark, sf)), name


def test_bounds_are_literals_at_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts,2", plan(monitoring.leaderboard_7d(spark, sf)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts,2", plan(catalogue.idempotency_unexpired(spark, sf)))
    for name in ("outbox_reap", "feature_freshness", "leaderboard_7d"):
        assert "Nested" not in plan(QUERIES[name][0](spark, sf)) and "Join" not in plan(QUERIES[name][0](spark, sf)), name


def test_one_read_and_one_shuffle(spark, sf):
    for name in ("eos_outcomes", "aggregate_counter_fold"):
        assert plan(QUERIES[name][0](spark, sf)).count("Exchange hashpartitioning") == 1, name
    assert plan(monitoring.aggregate_counter_fold(spark, sf)).count("FileScan") == 1
    assert "Python" not in plan(patterns.inbox_two_tier(spark, sf)) and "Python" not in plan(patterns.kv_hset(spark, sf))
