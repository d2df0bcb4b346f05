"""Every registered query against its SQL, in the default setting and with all range partitions kept apart."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from cartlens.plans import catalog

QUERIES = {key: function for key, function in entry.queries().items() if key in catalog.QUERIES}
ORACLES = catalog.ORACLES
# Queries built on the ordered scan.
ORDERED = [
    "pareto",
    "pareto_flagged",
    "revenue_share",
    "concentration_stats",
    "product_performance",
    "aggregate_by_ranked",
    "aggregate_by_stats",
    "distribution_stats",
    "key_surrogate",
    "growth_rate_rows",
    "growth_rate_pad",
    "rolling_avg_rows",
    "rolling_avg_by_group",
    "growth_rows_by_group",
    "clean_fill_median",
    "box_summary",
    "delivery_by_group",
    "composite_score",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_matches_sql(spark, sf_dir, duck, key):
    got = QUERIES[key](spark, sf_dir).toArrow()
    assert compare(got, duck.sql(ORACLES[key]).to_arrow_table()) is None


@pytest.mark.parametrize("key", ORDERED)
def test_matches_sql_with_many_ranges(spark, sf_dir, duck, key):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.QUERIES[key](spark, sf_dir).toArrow()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert compare(got, duck.sql(ORACLES[key]).to_arrow_table()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
