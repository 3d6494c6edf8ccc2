"""Every monitoring query against its SQL, and all others for their rows."""

import pytest

import oracle
from driftlane import plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert oracle.differences(plans.queries()[name](spark, sf), oracle.connect(sf), plans.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql()) - {"classifier_drift_gbt"}))
def test_gives_rows(spark, name):
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
