"""Means that lie on a limit, of tables in many files, against the SQL on one thread."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinesieve.plans import boards


def dealt(rng, low, high, n, total):
    """n whole numbers of a given sum in any order."""
    x = rng.integers(low, high + 1, n)
    while x.sum() != total:
        i = rng.integers(n)
        x[i] = min(max(x[i] + np.sign(total - x.sum()), low), high)
    return x


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """40 suppliers of 200 lines each: the tax is 0.0405 on average, the discount 0.049; seven files."""
    folder, rng = tmp_path_factory.mktemp("tied"), np.random.default_rng(8)
    mix = rng.permutation(40 * 200)
    column = lambda low, high, total: pa.array(np.concatenate([dealt(rng, low, high, 200, total) for _ in range(40)])[mix] / 100)
    lines = pa.table({
        "l_suppkey": pa.array(np.repeat(np.arange(40), 200)[mix]), "l_quantity": pa.array(np.full(8000, 20.0)), "l_extendedprice": pa.array(np.full(8000, 10.0)),
        "l_discount": column(0, 10, 980), "l_tax": column(0, 8, 810), "l_returnflag": pa.array(["N"] * 8000),
    })
    (folder / "lineitem.parquet").mkdir()
    for i, part in enumerate(np.array_split(np.arange(8000), 7)):
        pq.write_table(lines.slice(part[0], len(part)), folder / "lineitem.parquet" / f"part-{i}.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(np.arange(40)), "s_nationkey": pa.array(np.arange(40, dtype=np.int32) % 5)}), folder / "supplier.parquet")
    return folder


@pytest.mark.parametrize("name", ["board_fails", "board_summary", "offset_reasons"])
def test_sums_are_in_stored_order(name, spark, tied):
    found = boards.QUERIES[name](spark, str(tied)).toPandas()
    one = duckdb.connect()
    one.execute("SET threads = 1")
    one.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tied}/lineitem.parquet/*.parquet'")
    one.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tied}/supplier.parquet'")
    want = one.execute(boards.SQL[name]).df()
    plain = lambda frame: sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()))
    assert plain(found) == plain(want)
