"""The operators' queries with SQL, against it."""

import pytest

from kinesieve.llm.queries import oracle_sql, queries
from tests.conftest import SMALL
from tests.test_queries import rows_of

NAMES = sorted(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, duck):
    ours, theirs = queries()[name](spark, SMALL).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours).equals(rows_of(theirs))
