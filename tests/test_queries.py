"""Every registered query against its SQL on the small tables, and the queries without SQL."""

import pytest

from kinesieve.plans import registry
from tests.conftest import SMALL

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck):
    ours = QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours).equals(rows_of(theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).limit(5).count()
