"""Overload sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import materialize


def fold_overloads(functions: DataFrame, keys: list[str], order: list[Column], id_col: str = "id") -> DataFrame:
    """Functions with equal keys (scope, access tranche, static, name), two or
    more, become one row with ordered member ids. Singles are left out."""
    big = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = [c.alias(f"o{k}") for k, c in enumerate(order)]
    members = F.array_sort(F.collect_list(F.struct(*named, F.col(id_col).alias("__id"))))
    sets = functions.join(big, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.transform(members, lambda m: m["__id"]).alias("members"))
    return sets.withColumn("set_id", F.sha1(F.concat_ws("-", *keys)))


def consensus_brief(briefs: DataFrame, set_col: str = "set_id", brief_col: str = "brief") -> DataFrame:
    """Brief of a set: that of the members that have one, if it is the same; else
    the text of their class, else of their operator, else, if their briefs differ,
    '<name> overloads'. A set of plain functions without any brief has none. Columns:
    set, brief, func_class, readable_name (operator), name."""
    own = F.when(F.col(brief_col) != "", F.col(brief_col))
    g = briefs.groupBy(set_col).agg(
        F.count_distinct(own).alias("__n"), F.min(own).alias("__b"),
        F.min("func_class").alias("__c"), F.min("readable_name").alias("__o"), F.min("name").alias("__name"),
    )
    by_class = F.when(F.col("__c") == "constructor", "Constructors").when(F.col("__c") == "destructor", "Destructors").when(F.col("__c") == "conversion", "Conversion operators")
    text = F.coalesce(
        F.when(F.col("__n") == 1, F.col("__b")), by_class, F.concat(F.col("__o"), F.lit(" operators")),
        F.when(F.col("__n") > 1, F.concat(F.col("__name"), F.lit(" overloads"))),
    )
    return g.select(set_col, text.alias("brief"))


def union_docs(blocks: DataFrame, sets: DataFrame, set_col: str = "set_id") -> DataFrame:
    """A10: doc rows of a set's members, first occurrence of each key wins, in order
    of (member position, pos). ``sets``: set_id, members (ordered ids)."""
    member = sets.select(set_col, F.posexplode("members").alias("__mp", "__m"))
    key = F.when(F.col("section").isin("params", "tparams"), F.col("name")).otherwise(F.col("literal"))
    rows = blocks.join(member, F.col("symbol_id") == F.col("__m"))
    w = Window.partitionBy(set_col, "section", key).orderBy("__mp", "pos")
    first = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    order = Window.partitionBy(set_col, "section").orderBy("__mp", "pos")
    return first.select(set_col, "section", (F.row_number().over(order) - 1).alias("pos"), "name", "literal")


def set_fingerprints(members: DataFrame, set_col: str = "set_id", member_col: str = "member") -> DataFrame:
    """(set, n, f1, f2) of distinct (set, member) rows: the number of members and a
    commutative 128-bit fingerprint, combined before the shuffle."""
    return members.select(set_col, member_col).distinct().groupBy(set_col).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), member_col)).alias("f1"), F.bit_xor(F.xxhash64(F.lit(2), member_col)).alias("f2")
    )


def equivalent_sets(own: DataFrame, others: DataFrame) -> DataFrame:
    """(set_id, same_as): sets whose member set another table has too (of a base
    class or a using target), the smallest such id. Both tables are rows (set_id,
    member), so a set without members has none here; null members are ignored and
    repeated rows count once.

    Fingerprints find the sets, members confirm them: no row holds all members of a
    set. Sets that a fingerprint misled are compared with every set that has it."""
    own, others = own.where("member is not null"), others.where("member is not null")
    print_ = ["n", "f1", "f2"]
    a, b = set_fingerprints(own), set_fingerprints(others)
    first = b.groupBy(*print_).agg(F.min("set_id").alias("same_as"))
    hits = materialize(a.join(first, print_).where("set_id <> same_as"), "set-hits")
    mine, theirs = own.select("set_id", "member").distinct(), others.select(F.col("set_id").alias("same_as"), "member").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.select("set_id", "same_as", "n").join(mine, "set_id").join(theirs, ["same_as", "member"])
        return both.groupBy("set_id", "same_as", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n").select("set_id", "same_as")

    sure = materialize(confirmed(hits), "set-links")
    misled = hits.join(sure, "set_id", "left_anti")
    if misled.isEmpty():
        return sure
    every = misled.drop("same_as").join(b.withColumnRenamed("set_id", "same_as"), print_).where("set_id <> same_as")
    return sure.union(confirmed(every).groupBy("set_id").agg(F.min("same_as").alias("same_as")))


def resolve_shadows(shadows: DataFrame, symbols: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(using_id, pos, target_id, kind): targets of using declarations; a
    function in an overload set stands for the set, once."""
    s = symbols.select(F.col("id").alias("__s"), "kind")
    j = shadows.join(s, F.col("shadow_id") == F.col("__s"))
    if sets is not None:
        m = sets.select("set_id", F.explode("members").alias("__m"))
        j = j.join(m, F.col("shadow_id") == F.col("__m"), "left").withColumn("__t", F.coalesce("set_id", "shadow_id"))
        j = j.withColumn("kind", F.when(F.col("set_id").isNotNull(), "overloads").otherwise(F.col("kind")))
    else:
        j = j.withColumn("__t", F.col("shadow_id"))
    return j.groupBy("using_id", F.col("__t").alias("target_id"), "kind").agg(F.min("pos").alias("pos"))
