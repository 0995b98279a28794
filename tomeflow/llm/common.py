"""Helpers shared by the training-data operators.

Nothing here collects rows: lineage is cut by writing Parquet to the folder
all executors share, ranks come from bounded bucket counts, and components
come from star contraction over an edge table.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import discard, fresh_path, materialize  # noqa: F401 (used by the operators)


def reclaim(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more, so that Spark
    deletes their shuffle files now and not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*cols, seed: int = 0):
    """Uniform double in (0, 1) from a seeded 64-bit hash of ``cols``."""
    h = F.xxhash64(F.lit(seed).cast("long"), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


#: Up to so many keys (of a few numbers each) are broadcast to filter a large table.
BROADCAST_KEYS = 400_000


def only(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``big`` whose ``on`` columns occur in ``keys``: by a broadcast of
    counted keys up to a bound, else by a shuffled semi join."""
    keys = materialize(keys.select(*on).distinct(), "keys")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return big.join(F.broadcast(keys) if few else keys, on, "left_semi")


def gapless(df: DataFrame, order_key: str, ties: list[str], out: str, group: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``out``: position from 0 without gaps, per ``group``, in order of the
    unsigned 64-bit ``order_key`` then ``ties``.

    Each group is cut in ``buckets`` ranges of the key; only the bucket counts
    (at most groups x buckets rows, both parameters) are accumulated, so no
    group has to meet in one task.
    """
    group = group or []
    n = buckets or max(16, 2 * partitions(df.sparkSession))
    bits = max(1, (n - 1).bit_length())
    df = df.withColumn("__bucket", F.shiftrightunsigned(F.col(order_key), 64 - bits).cast("int"))
    counts = df.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(order_key, *ties)
    ranked = df.withColumn("__rank", F.row_number().over(inside))
    return (
        ranked.join(F.broadcast(offsets), [*group, "__bucket"])
        .withColumn(out, F.col("__before") + F.col("__rank") - 1)
        .drop("__bucket", "__before", "__rank")
    )


#: Up to so many links (of two integers each) one task contracts by union-find.
TASK_LINKS = 1_000_000


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Root (the smallest node) of every node of the pairs."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for u, v in pairs:
        up.setdefault(u, u)
        up.setdefault(v, v)
        x, y = find(u), find(v)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, native: bool = False, task_links: int = TASK_LINKS) -> DataFrame:
    """Connected components of links between integer nodes ``a`` and ``b``: (node,
    root) for every node of a link, root being the component's smallest node.

    Links up to a counted bound are contracted in one task. More of them (or any,
    if ``native``) go through alternating large-star and small-star contraction:
    degrees are reduced by partial minima before any shuffle, and each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    if not native and e.limit(task_links + 1).count() <= task_links:

        def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            root = union_find((u, v) for b in batches for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], names=["node", "root"])

        return materialize(e.coalesce(1).mapInArrow(contract, "node long, root long"), "cc")
    for _ in range(max_rounds):
        # large star: larger neighbours of u point at the smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself point at the smallest
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u")
        nxt = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(m2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = materialize(nxt, "cc")
        # a forest of stars: no root is itself a child, and each child has one root
        done = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and new.join(
            new.select(F.col("u").alias("v")).distinct(), "v", "left_semi"
        ).isEmpty()
        discard(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
