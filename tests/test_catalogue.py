"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from relomap.plans.diff_catalogue import ORACLE_SQL, QUERIES
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    frame = QUERIES[name](spark, small).toPandas()
    assert len(frame.columns)
    if name in ORACLE_SQL:
        same(frame, connect(small).sql(ORACLE_SQL[name]).df())


def test_entry(spark, small):
    import __spark_entry__

    frame = __spark_entry__.entry(spark).toPandas()
    assert len(frame) > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
