"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import assert_same, connect

from tomeflow.plans import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE[name])


def test_flagship_has_every_mode(spark, sf_dir):
    got = queries.QUERIES["modes_per_kind"](spark, sf_dir).collect()
    assert {r["mode"] for r in got} == {"regular", "see-below", "implementation-defined", "dependency"}
