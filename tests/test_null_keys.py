"""Null and extreme keys of a "first wins" merge: ordered as in the SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same

from tomeflow.plans import queries


@pytest.mark.parametrize("name", ["merged_parts", "merged_params"])
def test_null_keys_come_after_all_others(spark, tmp_path, name):
    draw, n = np.random.default_rng(4), 4000
    some = lambda k, part, kind: pa.array([None if draw.random() < part else int(x) for x in draw.integers(0, k, n)], kind)
    order = some(30, 0.2, pa.int64()).to_pylist()
    order[:3] = [-(1 << 63), (1 << 63) - 1, -5]
    flags = pa.array([None if draw.random() < 0.1 else x for x in draw.choice(["A", "N", "R"], n)])
    lines = pa.table({
        "l_orderkey": pa.array(order, pa.int64()), "l_partkey": some(900, 0.05, pa.int64()), "l_suppkey": some(1000, 0.1, pa.int64()),
        "l_linenumber": some(4, 0.2, pa.int32()), "l_returnflag": flags, "l_linestatus": pa.array([None if draw.random() < 0.1 else x for x in draw.choice(["F", "O"], n)]),
    })
    pq.write_table(lines, tmp_path / "lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert_same(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE[name])
