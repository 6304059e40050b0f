"""Every query against its SQL counterpart on the provided tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as driver
from checks.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    assert not differences(ours, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 11


def test_estimates_are_near(spark, read):
    from plumbline.operators.frequencies import distinct_counts, unique_approx
    from plumbline.operators.quantiles import quartiles, quartiles_approx

    lineitem = read("lineitem")
    exact = {r["column"]: r["distinct"] for r in distinct_counts(lineitem).collect()}
    for row in unique_approx(lineitem).collect():
        assert abs(row["unique_approx"] - exact[row["column"]]) <= 0.1 * exact[row["column"]] + 1
    near, sharp = ({r["column"]: r for r in f(lineitem).collect()} for f in (quartiles_approx, quartiles))
    for name, row in sharp.items():
        assert abs(near[name]["q50"] - row["q50"]) <= 0.01 * max(1, abs(row["q50"]))
