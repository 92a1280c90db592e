"""Every registered query against its SQL, and rules that hold on any log."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cartrail.operators import commerce, traces
from cartrail.plans.registry import QUERIES
from cartrail.sources import bindings
from check_oracle import compare

SMALL = "/root/testdata/sf0.001"
MANY_JOBS = {"mlp_next_activity", "process_tree", "bpmn_flows"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MANY_JOBS))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, SMALL, name)
    assert ok, note


@pytest.mark.parametrize(
    "name, operator",
    [
        ("dfg_collapsed", traces.directly_follows),
        ("variants", lambda log: traces.with_paths(log, traces.variants(log))),
        ("variant_steps", lambda log: traces.variant_steps(log, traces.variants(log))),
        ("session_order", commerce.session_order),
    ],
)
def test_hot_users_and_sessions_match_sql(spark, name, operator):
    ok, note = compare(
        spark, SMALL, name, lambda s, folder: operator(bindings.session_log(s, folder, hot_rows=6))
    )
    assert ok, note


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["src", "dst", "weight"]


def test_counts_add_up(spark):
    log = bindings.session_log(spark, SMALL)
    edges = traces.directly_follows(log).agg(F.sum("weight")).first()[0]
    sizes = traces.variants(log).agg(F.sum(F.col("cases") * (F.col("steps") - 1)), F.sum("cases")).first()
    assert edges == sizes[0]
    assert sizes[1] == log.df.select("user_session").distinct().count()


def test_purchases_are_part_of_all(spark):
    log = bindings.shop_log(spark, SMALL)
    every = {r.price_bin: r.session_count for r in commerce.price_distribution(log).collect()}
    bought = {r.price_bin: r.session_count for r in commerce.price_distribution(log, purchases=True).collect()}
    assert all(every[b] >= n for b, n in bought.items())
    rates = commerce.purchase_rate_by_category(log).select("purchase_rate").collect()
    assert all(0 <= r[0] <= 100 for r in rates)
