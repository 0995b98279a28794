"""The last comparison of near-dedup: blocks of a list's members."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import blocks, near_dedup
from tomeflow.llm.common import union_find


def test_cells_bring_every_open_pair_together_once(spark):
    # list 1 has a large component, list 2 has none
    mixed = spark.createDataFrame(
        [(1, n, 0 if n < 40 else n, 0) for n in range(60)] + [(2, n, n, 3) for n in range(50)] + [(3, 1, 1, 1), (3, 2, 2, 1)], "key long, node long, comp long, major long")
    cell = blocks.cells(mixed, 8)
    x, y = cell.where("left").alias("x"), cell.where("right").alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.r") == F.col("y.r")) & (F.col("x.comp") != F.col("y.comp"))
    met = x.join(y, on).where("not y.minor or x.node < y.node").select("x.key", F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    got = sorted(tuple(r) for r in met.collect())
    comp = {1: lambda n: 0 if n < 40 else n}
    want = sorted([(k, a, b) for k, m in ((1, 60), (2, 50)) for a in range(m) for b in range(a + 1, m) if comp.get(k, lambda n: n)(a) != comp.get(k, lambda n: n)(b)] + [(3, 1, 2)])
    assert got == want
    assert cell.groupBy("key", "i", "r").count().agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("threshold", [80, 85])
def test_a_group_of_near_copies_is_linked_as_by_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(blocks.cells, "__defaults__", (block,))
    draw = np.random.default_rng(threshold)
    texts = []
    for size in (60, 260):  # sets that travel whole, and sets that do not
        base = [f"w{k}" for k in draw.integers(0, 10**6, size)]
        for _ in range(45):
            own = list(base)
            for at in draw.integers(0, size, draw.integers(0, size // 20)):
                own[at] = f"x{draw.integers(0, 10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, threshold=threshold).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    root = union_find(iter(links))
    assert got == {k: root.get(k, k) for k in range(len(texts))}
