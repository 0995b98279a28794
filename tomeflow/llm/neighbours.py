"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt to index blocks. A block's forest has, for each tree, the
sorted array of its vectors' long hash strings (signs of random directions). A
query descends every tree to its longest matching prefix and then ascends all
trees together, one bit at a time, until enough entries share its prefix;
entries under the prefix are never cut short. Those candidates are ranked by
exact distance, and the blocks' nearest are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tomeflow.llm.common import small_batches


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to ``v``; where squares would leave the range of a
    double, of rows scaled by their largest component."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = np.sqrt(((x - v) ** 2).sum(1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
        if odd.size:
            most = np.maximum(np.abs(x[odd]).max(1), np.abs(v).max())[:, None]
            apart = x[odd] / most - v / most
            # the difference itself may be small against the components
            scale = np.abs(apart).max(1, keepdims=True)
            scale[scale == 0] = 1.0
            d[odd] = (np.sqrt(((apart / scale) ** 2).sum(1)) * scale[:, 0]) * most[:, 0]
    return d


class Forest:
    """Sorted hash strings of ``bits`` bits in ``trees`` trees over float64 rows."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int) -> None:
        self.x, self.bits = x, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, x.shape[1], bits))
        keys = self.keys(x)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, 1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): hash strings as integers, first bit highest."""
        x = x / np.abs(x).max(1, keepdims=True)  # no square leaves a double's range
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([((unit @ p) > 0).astype(np.uint64) @ weights for p in self.planes])

    def candidates(self, q: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query, the entries under its synchronous prefix: the longest
        with ``enough`` entries over all trees, or all entries."""
        keys, n = self.keys(q), len(self.x)
        trees = len(keys)
        lo = np.zeros((trees, len(q)), np.int64)
        hi = np.full((trees, len(q)), n, np.int64)
        open_ = np.arange(len(q))
        for depth in range(self.bits, 0, -1):  # ascend from whole strings
            if not open_.size:
                break
            s = np.uint64(self.bits - depth)
            a = np.empty((trees, len(open_)), np.int64)
            b = np.empty_like(a)
            for t in range(trees):
                prefix = keys[t, open_] >> s
                a[t] = np.searchsorted(self.sorted[t], prefix << s, "left")
                b[t] = np.searchsorted(self.sorted[t], (prefix << s) | np.uint64((1 << int(s)) - 1), "right")
            done = (b - a).sum(0) >= enough
            lo[:, open_[done]], hi[:, open_[done]] = a[:, done], b[:, done]
            open_ = open_[~done]
        out = []
        for j in range(len(q)):
            mark = np.zeros(n, bool)
            for t in range(trees):
                mark[self.order[t, lo[t, j] : hi[t, j]]] = True
            out.append(np.flatnonzero(mark))
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is neither null, empty nor zero
    and has neither null nor non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.forall("v", good) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 40, bits: int = 32, share: float = 0.6, block: int = 8192, query_block: int = 1024, seed: int = 29, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: (query_id, rank, id, score).

    ``score`` is the Euclidean distance of the original vectors in double
    precision; ties go to the smaller id; a query's own id is no candidate; fewer
    than ``k`` candidates give fewer rows. Rows without an id take no part. Of several
    vectors of one id the nearest counts, as query and as candidate, so that a
    query's ids and ranks occur once. Rows of another width than a query's are no
    candidates of it. ``share`` times the block's size is how many entries
    (over all trees, repeats counted) end the ascent: raise it for recall. It ends
    with more than ``k`` entries at least, or with all.

    Finite components of any magnitude have their distance; one beyond a double is
    infinite. An empty table gives no row.

    Index blocks of about ``block`` rows and query blocks of ``query_block`` bound a
    task's memory; every query block meets every index block.
    """
    small_batches(vectors.sparkSession, 2000)
    index = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"])
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "v"])
    n, m = index.count(), asked.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // query_block))
    side = lambda df, own, other, count, name: df.withColumn(own, F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(name - 1)))).select("id", "v", F.col("ib").cast("long"), F.col("qb").cast("long"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for width, own in right.groupby(right["v"].map(len)):
            base = left[left["v"].map(len) == width]
            if not len(base):
                continue
            base = base.sort_values("id", kind="stable")
            x, ids = np.stack(base["v"].to_numpy()), base["id"].to_numpy()
            q = np.stack(own["v"].to_numpy())
            forest = Forest(x, trees, bits, seed)
            for qid, v, near in zip(own["id"].to_numpy(), q, forest.candidates(q, max(trees * (k + 1), int(share * len(x))))):
                near = near[ids[near] != qid]
                d = distances(x[near], v)
                # ids ascend, so a stable sort gives ties to the smaller one
                order = np.argsort(d, kind="stable")
                _, once = np.unique(ids[near[order]], return_index=True)
                for i in order[np.sort(once)[:k]]:
                    found.append((qid, ids[near[i]], d[i]))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    left = side(index, "ib", "qb", blocks, parts).groupBy("ib", "qb")
    right = side(asked, "qb", "ib", parts, blocks).groupBy("ib", "qb")
    found = left.cogroup(right).applyInPandas(search, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
