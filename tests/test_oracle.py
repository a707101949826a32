"""Every core query against its SQL twin on the smallest tables."""

import pytest

from swatchwork.plans import catalog
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    # The smallest table has no arcs that make up a ring.
    folder = SF.replace("0.001", "0.01") if name in ("rank_annuli", "ring_candidates") else SF
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_flagship(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"doc_id", "cells", "p10", "mean", "hot", "status"}
    assert set(e.oracle_sql()) <= set(e.queries())
