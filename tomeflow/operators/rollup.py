"""Namespace roll-ups and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.core import materialize
from tomeflow.operators.filters import DEPENDENCY, IMPLEMENTATION, REGULAR, SEE_BELOW
from tomeflow.operators.hierarchy import paths


def roll_up_modes(symbols: DataFrame) -> DataFrame:
    """(id, extraction) of namespaces, from the leaves up. Regular namespaces
    that have members but no doc change: to dependency or implementation-defined if
    all members are, else to see-below if any is and none is regular. Others keep
    their mode.

    Only namespaces that can change wait for others: what their settled members say
    is summed once, and rounds (one for each level of such namespaces in each other)
    pass a few flags up."""
    own = materialize(symbols.select("id", "parent_id", "kind", "has_doc", "extraction"), "rollup")
    e = F.col("extraction")
    members = own.select(F.col("parent_id").alias("__p")).where("__p is not null").distinct()
    open_ = own.where((F.col("kind") == "namespace") & (e == REGULAR) & ~F.col("has_doc")).join(members, F.col("id") == F.col("__p"), "left_semi")
    waiting = materialize(paths(open_, F.lit(0)).select("id", "depth").join(own.select("id", "parent_id"), "id"), "waiting")
    settled = own.join(waiting.select(F.col("id").alias("__w")), F.col("id") == F.col("__w"), "left_anti")
    deepest = waiting.agg(F.max("depth")).first()[0]
    rest = settled.where("kind = 'namespace'").select("id", "extraction")
    if deepest is None:
        return rest

    def said(rows: DataFrame) -> DataFrame:
        flags = [F.bool_or(e == REGULAR).alias("reg"), F.bool_and(e == DEPENDENCY).alias("dep"), F.bool_and(e == IMPLEMENTATION).alias("imp"), F.bool_or(e == SEE_BELOW).alias("see")]
        return rows.groupBy(F.col("parent_id").alias("__p")).agg(*flags)

    known = materialize(said(settled.join(waiting.select(F.col("id").alias("__w")), F.col("parent_id") == F.col("__w"), "left_semi")), "said")
    out, below = [rest], None
    for depth in range(deepest, -1, -1):
        heard = known if below is None else known.union(said(below))
        heard = heard.groupBy("__p").agg(F.bool_or("reg").alias("reg"), F.bool_and("dep").alias("dep"), F.bool_and("imp").alias("imp"), F.bool_or("see").alias("see"))
        mode = F.when(F.col("reg"), REGULAR).when(F.col("dep"), DEPENDENCY).when(F.col("imp"), IMPLEMENTATION).when(F.col("see"), SEE_BELOW).otherwise(REGULAR)
        level = waiting.where(F.col("depth") == depth).join(heard, F.col("id") == F.col("__p"))
        below = materialize(level.select("id", "parent_id", mode.alias("extraction")), "rolled")
        out.append(below.select("id", "extraction"))
    return reduce(DataFrame.union, out)


def prune_empty(symbols: DataFrame, scopes: list[str] = ["namespace"], documented: str = "has_doc") -> DataFrame:
    """``symbols`` without scopes that have no doc and no members, repeated
    upward until none is left. Only ids travel between rounds."""
    alive = materialize(symbols.select("id", "parent_id", "kind", F.col(documented).alias("__doc")), "prune")
    while True:
        kids = alive.select(F.col("parent_id").alias("__p")).where("__p is not null").distinct()
        hollow = alive.where(F.col("kind").isin(scopes) & ~F.col("__doc")).join(kids, F.col("id") == F.col("__p"), "left_anti").select(F.col("id").alias("__h"))
        hollow = materialize(hollow, "hollow")
        if hollow.isEmpty():
            break
        alive = materialize(alive.join(hollow, F.col("id") == F.col("__h"), "left_anti"), "prune")
    return symbols.join(alive.select(F.col("id").alias("__a")), F.col("id") == F.col("__a"), "left_semi")


def counts_by_mode(symbols: DataFrame) -> DataFrame:
    """Symbols per kind and extraction mode."""
    return symbols.groupBy("kind", "extraction").agg(F.count(F.lit(1)).alias("n"))


def extraction_totals(symbols: DataFrame) -> DataFrame:
    """One row of totals."""
    at = lambda m: F.count_if(F.col("extraction") == m)
    return symbols.agg(F.count(F.lit(1)).alias("declarations"), at(REGULAR).alias("regular"), at(SEE_BELOW).alias("see_below"), at(IMPLEMENTATION).alias("implementation_defined"), at(DEPENDENCY).alias("dependencies"))


def diagnostic_totals(diagnostics: DataFrame) -> DataFrame:
    """Distinct messages, errors and warnings."""
    level = F.col("level")
    return diagnostics.agg(
        F.count_distinct("message").alias("messages"), F.count_distinct(F.when(level == "error", F.col("message"))).alias("errors"), F.count_distinct(F.when(level == "warning", F.col("message"))).alias("warnings"),
    )


def only_namespaces(members: DataFrame) -> DataFrame:
    """(parent_id, only_namespaces)."""
    return members.groupBy("parent_id").agg(F.bool_and(F.col("kind") == "namespace").alias("only_namespaces"))
