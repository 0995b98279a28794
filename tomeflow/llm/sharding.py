"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A key descends region -> rack -> shard. At each level every child draws
-ln(u) / weight, u being a hash of the key and the child's name; the smallest
draw wins, so a child is chosen with probability proportional to its weight and
a changed weight moves keys only into or out of that child's subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import gapless, uniform

Topology = list[tuple[str, str, int, float]]  # (region, rack, shard, weight)


def topology(shards: int, base: int = 40, racks: int = 2, per_rack: int = 5) -> Topology:
    """``shards`` shards of weight 1: the first ``base`` fill regions of ``racks``
    x ``per_rack``; each later one is a region of its own, so that growing by one
    changes the weight of the new subtree alone."""
    region = racks * per_rack
    return [
        (f"region{s // region}", f"rack{s // per_rack % racks}", s, 1.0) if s < base else (f"extra{s}", "rack0", s, 1.0)
        for s in range(shards)
    ]


def _children(pairs: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in pairs if w > 0])


def _draw(key: list[Column], children: Column, seed: int) -> Column:
    """Name of the child with the smallest draw; ties go to the smaller name."""
    draws = F.transform(children, lambda c: F.struct((-F.log(uniform(c["name"], *key, seed=seed)) / c["weight"]).alias("d"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def assign(df: DataFrame, key: list[str], tree: Topology, out: str, seed: int = 17) -> DataFrame:
    """Add ``out``: the shard of each row, by key columns and topology alone.
    Equal keys (nulls too) share a shard. Shards of weight 0 receive nothing."""
    cols = [F.col(k) for k in key]
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for region, rack, shard, w in tree:
        name = f"{region}/{rack}"
        racks.setdefault(region, {}).setdefault(name, 0.0)
        racks[region][name] += w
        shards.setdefault(name, {})[f"{name}/{shard}"] = w
    regions = [(r, sum(x.values())) for r, x in racks.items()]
    below = lambda level: F.create_map(*[c for node, x in level.items() if sum(x.values()) > 0 for c in (F.lit(node), _children(list(x.items())))])
    return (
        df.withColumn("__node", _draw(cols, _children(regions), seed))
        .withColumn("__node", _draw(cols, F.element_at(below(racks), F.col("__node")), seed))
        .withColumn("__node", _draw(cols, F.element_at(below(shards), F.col("__node")), seed))
        .withColumn(out, F.element_at(F.split("__node", "/"), -1).cast("int"))
        .drop("__node")
    )


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per document: (id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the text's UTF-8 bytes (null: none) plus 16; ``slot`` is the
    row's place in its shard, gapless from 0; ``grown_shard`` is the shard with
    one more shard in the tree. Rows of one id (null is one) go to one shard;
    empty tables give empty results; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(rows, ["__id"], topology(shards), "shard", seed)
    rows = assign(rows, ["__id"], topology(shards + 1), "grown_shard", seed)
    rows = rows.withColumn("__key", F.xxhash64(F.lit(seed + 1), "__id", "text_crc32", "size"))
    rows = gapless(rows, "__key", ["__id", "text_crc32", "size"], "slot", ["shard"])
    return rows.select(F.col("__id").alias(id_col), "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
