"""Every query of the engine against the SQL that stands beside it."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want and want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cdv_round_robin", "cdv_adaptive"])
def test_budgets_are_never_exceeded(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(r.spent <= 300 and r.n_chains > 0 for r in rows)


def test_bca_brackets_the_mean(spark, sf):
    for r in QUERIES["bca_ci_mean"](spark, sf).collect():
        assert r.ci_low < r.point < r.ci_high


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_ranks_no_whole_group_in_one_task(spark, sf):
    windows = [line for line in plan_of(QUERIES["audit_sample"](spark, sf)).splitlines() if "Exchange hashpartitioning" in line]
    assert len(windows) == 3 and "_part" in windows[1] and "_part" not in windows[0]


@pytest.mark.parametrize(("name", "exchanges"), [("sc_budget_draw", 1), ("early_stop_vote", 1), ("budget_curves", 2), ("cdv_round_robin", 2), ("cdv_adaptive", 2)])
def test_draws_vote_within_their_row(spark, sf, name, exchanges):
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("Exchange hashpartitioning") == exchanges and "Join" not in plan


def test_chains_move_before_replicates_multiply_them(spark, sf):
    plan = plan_of(QUERIES["transferred_allocation"](spark, sf))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chains" in line]
    assert all("replicate" not in line for line in moved) and plan.index("Generate") < plan.index("Join")


def test_scores_of_configurations_come_from_draws_without_a_vote_join(spark, sf):
    assert "posexplode" not in plan_of(QUERIES["compare_to_reference"](spark, sf))


def test_curve_orders_samples_once_for_all_sizes(spark, sf):
    plan = plan_of(QUERIES["majority_accuracy_curve"](spark, sf))
    assert plan.count("Scan parquet") == 1 and plan.count("Window") <= 2 and "Union" not in plan


def test_predictions_read_the_samples_once(spark, sf):
    assert plan_of(QUERIES["predictions"](spark, sf)).count("Scan parquet") == 1
