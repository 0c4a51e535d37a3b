"""Every registered query of the engine on the smallest tables."""

import pytest
from oracle import SF, same_rows

from strandline.plans import catalogue


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_query_equals_its_sql(spark, name):
    same_rows(spark, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_module_registers_the_catalogue(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
