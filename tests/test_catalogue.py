"""Every catalogue query against its SQL."""

import pytest

from flowseq.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.helpers import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        same_rows(got, duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["len", "word", "cnt"]
