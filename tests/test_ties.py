"""Rows that repeat the keys they are merged by: the one read first decides, as in SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same

from tomeflow.plans import queries


# the SQL of merged_params does not skip empty names, and lineitem has none
@pytest.mark.parametrize("name, some", [("merged_parts", ["", "A", "N", "R"]), ("merged_params", ["A", "N", "R", "S"])])
def test_repeated_sequences_go_by_input_order(spark, tmp_path, name, some):
    draw, n = np.random.default_rng(3), 6000
    pick = lambda k: draw.integers(0, k, n)
    flags = np.array(some)
    lines = pa.table({
        "l_orderkey": pick(30), "l_partkey": pick(40), "l_suppkey": pick(1000), "l_linenumber": pa.array(pick(4), pa.int32()),
        "l_returnflag": flags[pick(4)], "l_linestatus": np.array(["F", "O"])[pick(2)],
    })
    pq.write_table(lines, tmp_path / "lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert_same(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE[name])
