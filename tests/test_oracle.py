"""Every query with a SQL twin gives the twin's whole result."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert differences(contract.queries()[name](spark, sf_dir), duck, contract.oracle_sql()[name]) == []


PLAIN = sorted(set(contract.queries()) - set(contract.oracle_sql()) - {n for n in contract.queries() if n.startswith("op") or n == "pipeline"})


#: Support rules of these leave nothing of the smallest tables.
WIDER = {"reference_targets", "support_scenarios", "shared_reference_gap", "training_population_contrast", "screened_training"}


@pytest.mark.parametrize("name", PLAIN)
def test_query_without_sql_runs(name, spark, sf_dir):
    """Its columns and rows come out whole; values are tested with the operators."""
    df = contract.queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01") if name in WIDER else sf_dir)
    assert df.collect() and len(set(df.columns)) == len(df.columns)


def test_every_sql_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    rows = contract.entry(spark).collect()
    assert {r["singleton"] for r in rows} == {"adjust", "average", "zero"}
