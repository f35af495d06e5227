"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest
from compare import differences

from lectern.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if name == "raster_denoise_pipeline":
        assert QUERIES[name](spark, SF).schema.names == ["id", "width", "height", "pixels", "status", "error"]
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
