"""Hierarchy and graph operators over (id, parent) and edge tables.

Paths and ancestors are found by pointer doubling: a tree of depth n takes log2(n)
rounds, each written to the shared folder. Other closures walk a frontier (see
``core.fixpoint``), so work is linear in the closure's size. Nothing is cut off:
cyclic parents raise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import discard, fixpoint, materialize

#: Rounds of pointer doubling: 2 ** 16 levels are no tree, but a cycle.
MOST_ROUNDS = 16


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ancestors(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, ancestor, dist), a node being its own ancestor at distance 0. Parents
    that are not rows end a path; cyclic parents raise."""
    line = paths(nodes, F.col(id_col), id_col, parent_col)
    return line.select("id", F.posexplode(F.reverse("path")).alias("dist", "ancestor")).select("id", "ancestor", "dist")


def paths(nodes: DataFrame, name: Column, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, path, depth): names and sort keys from root to node. ``name`` is any column
    expression over the nodes. Rows whose parent is missing or null are roots; cyclic
    parents raise. Only nodes that have children climb, the first three levels in one
    step and then by doubling; every node takes its parent's path at last."""
    named = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.array(name).alias("path"), F.lit(0).alias("depth"))
    inner = named.join(named.select(F.col("up").alias("__k")).distinct(), F.col("id") == F.col("__k"), "left_semi")

    def climbed(cur: DataFrame, by: DataFrame) -> DataFrame:
        top = by.select(F.col("id").alias("__i"), F.col("up").alias("__u"), F.col("path").alias("__path"), F.col("depth").alias("__d"))
        moved = cur.join(top, F.col("up") == F.col("__i"), "left")
        path = F.when(F.col("__i").isNull(), F.col("path")).otherwise(F.concat("__path", "path"))
        return moved.select("id", F.col("__u").alias("up"), path.alias("path"), (F.col("depth") + F.coalesce(F.col("__d") + 1, F.lit(0))).alias("depth"))

    inner = materialize(inner, "inner")
    cur = inner
    for _ in range(3):
        cur = climbed(cur, inner)
    cur = materialize(cur, "paths")
    for _ in range(MOST_ROUNDS):
        if cur.where("up is not null").isEmpty():
            discard(inner)
            return climbed(named, cur).select("id", "path", "depth")
        last, cur = cur, materialize(climbed(cur, cur), "paths")
        discard(last)
    raise RuntimeError("paths: cyclic parents")


def display_name(name: Column, kind: Column) -> Column:
    """``<unnamed kind>`` for a nameless symbol."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("<unnamed "), kind, F.lit(">"))).otherwise(name)


def qualified_names(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", kind_col: str = "kind", sep: str = "::") -> DataFrame:
    """G1: (id, qualified_name, depth)."""
    p = paths(nodes, display_name(F.col(name_col), F.col(kind_col)), id_col, parent_col)
    return p.select("id", F.array_join("path", sep).alias("qualified_name"), "depth")


def relative_name(target: Column, context: Column, sep: str = "::") -> Column:
    """A qualified name as written inside a context: shared leading components are
    dropped; '::' goes before a name that shares none."""
    t, c = F.split(target, sep), F.split(context, sep)
    shared = F.aggregate(
        F.sequence(F.lit(0), F.size(t)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, k: F.struct(
            (acc["n"] + F.when(acc["on"] & (F.get(t, k) == F.get(c, k)), 1).otherwise(0)).alias("n"),
            (acc["on"] & F.coalesce(F.get(t, k) == F.get(c, k), F.lit(False))).alias("on"),
        ),
        lambda acc: F.least(acc["n"], F.size(t) - 1),
    )
    rest = F.array_join(F.slice(t, shared + 1, F.size(t)), sep)
    return F.when(shared == 0, F.concat(F.lit(sep), rest)).otherwise(rest)


def traverse(members: DataFrame, symbols: DataFrame, ordered: bool = False, skip_inherited: bool = False, recursive: bool = False) -> DataFrame:
    """(scope_id, child_id, depth[, idx]) over ``members`` (parent_id, grp, pos,
    child_id). ``skip_inherited`` keeps children whose own parent is the scope;
    ``ordered`` numbers a scope's members by (name, id). Members that contain each
    other raise."""
    own = symbols.select(F.col("id").alias("__id"), F.col("parent_id").alias("__owner"), F.col("name").alias("__name"))
    step = members.join(own, F.col("child_id") == F.col("__id"))
    if skip_inherited:
        step = step.where(F.col("__owner") == F.col("parent_id"))
    step = step.select(F.col("parent_id").alias("__from"), "child_id", "__name")
    out = step.select(F.col("__from").alias("scope_id"), "child_id", "__name", F.lit(1).alias("depth"))
    if recursive:
        nxt = step.select("__from", F.col("child_id").alias("__c"), F.col("__name").alias("__n"))

        def deeper(front: DataFrame) -> DataFrame:
            j = front.join(nxt, F.col("child_id") == F.col("__from"))
            return j.select("scope_id", F.col("__c").alias("child_id"), F.col("__n").alias("__name"), (F.col("depth") + 1).alias("depth"))

        out = _union(fixpoint(out, deeper, tag="traverse"))
    if ordered:
        out = out.withColumn("idx", F.row_number().over(Window.partitionBy("scope_id", "depth").orderBy("__name", "child_id")))
    return out.drop("__name")


def transitive(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (source, target) closure of an edge table. Paths are squared: what
    the last round found is joined with all pairs so far, to either side, so a path of
    n edges takes about log2(n) rounds; pairs seen before do not go on, which ends
    cycles. All pairs are one table, written once for each round."""
    every = materialize(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct(), "closure")
    front = every
    while True:
        right = lambda df: df.select(F.col("s").alias("__s"), F.col("t").alias("__t"))
        joined = lambda a, b: a.join(right(b), F.col("t") == F.col("__s")).select("s", F.col("__t").alias("t"))
        found = joined(front, every) if front is every else joined(front, every).union(joined(every, front))
        new = materialize(found.distinct().join(every, ["s", "t"], "left_anti"), "closure-front")
        if new.isEmpty():
            return every.select(F.col("s").alias(source), F.col("t").alias(target))
        last, before = every, front
        every = materialize(every.union(new), "closure")
        discard(last)
        if before is not last:
            discard(before)
        front = new


def page_order(nodes: DataFrame, order: Column, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, sort_path, depth): sorting by the path of member positions gives the
    depth-first order, without a global counter."""
    return paths(nodes, order, id_col, parent_col).withColumnRenamed("path", "sort_path")
