"""Inheritance: base members, derived index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.core import fixpoint, fresh_path, materialize
from tomeflow.operators.filters import DEPENDENCY, REGULAR


def member_signature(kind: str = "kind", name: str = "name", params: str = "signature"):
    """What shadowing compares: kind and name; for functions the full signature."""
    return F.concat_ws("|", F.col(kind), F.col(name), F.when(F.col(kind) == "function", F.col(params)))


def inherited_access(base_access, member_access):
    """Access matrix: public bases keep public and protected, protected ones make
    both protected, private ones private; private members are not inherited."""
    return (
        F.when(member_access == "private", None)
        .when(base_access == "public", member_access)
        .when(base_access == "protected", F.lit("protected"))
        .when(base_access == "private", F.lit("private"))
    )


#: Layers that one round of ``layers`` walks.
STRIDE = 3


def layers(edges: DataFrame) -> DataFrame:
    """(rec, layer) of every record of ``edges`` (derived, base): the longest way down
    to a record without bases. Fronts of records are walked by distinct ids, a few of
    them in each round, so work follows records and not paths; bases that form a cycle
    raise."""
    up = materialize(edges.select(F.col("derived").alias("__d"), F.col("base").alias("__b")).distinct(), "base-edges")
    first = up.select(F.col("__b").alias("rec")).join(up.select(F.col("__d").alias("rec")), "rec", "left_anti").distinct()

    def stride(found: DataFrame) -> DataFrame:
        last = found.agg(F.max("layer").alias("layer"))
        front = found.join(F.broadcast(last), "layer", "left_semi").select("rec", "layer")
        fronts = []
        for _ in range(STRIDE):
            front = front.join(up, F.col("rec") == F.col("__b")).select(F.col("__d").alias("rec"), (F.col("layer") + 1).alias("layer")).distinct()
            fronts.append(front)
        return reduce(DataFrame.union, fronts)

    records = up.select("__d").distinct().count()
    each = fixpoint(first.withColumn("layer", F.lit(0)), stride, max_iter=records // STRIDE + 2, tag="layers")
    found = materialize(reduce(DataFrame.union, each).groupBy("rec").agg(F.max("layer").alias("layer")), "layers")
    if not up.join(found, F.col("__d") == F.col("rec"), "left_anti").isEmpty():
        raise RuntimeError("layers: cyclic bases")
    return found


def base_members(bases: DataFrame, members: DataFrame, private: bool = False) -> DataFrame:
    """(derived_id, child_id, access, kind, name, depth): members inherited from
    base records. ``bases``: derived_id, base_id, access and pos, the base's place
    (by base_id, if there is no such column); ``members``: parent_id, child_id,
    access, kind, name, signature, func_class. Constructors and destructors are
    skipped, private bases count only if ``private``.

    Bases are taken in their order, public members of each before protected ones: within an access of the derived
    record, what it or an earlier base has shadows a later member of that signature.

    Records are settled in topological layers. A layer's records hand what is left of
    their members to their derived records, stored by layer; so a member travels each
    edge once, however many paths there are. Bases that form a cycle raise."""
    spark = bases.sparkSession
    pos = F.col("pos") if "pos" in bases.columns else F.col("base_id")
    edges = bases.select(F.col("derived_id").alias("derived"), F.col("base_id").alias("base"), F.col("access").alias("base_access"), pos.alias("pos"))
    edges = edges if private else edges.where("base_access != 'private'")
    level = layers(edges)
    height = level.agg(F.max("layer")).first()[0]
    target = level.select(F.col("rec").alias("derived"), F.col("layer").alias("to_layer"))
    edges = materialize(edges.join(target, "derived").join(level.select(F.col("rec").alias("base"), F.col("layer").alias("from_layer")), "base"), "base-edges")
    own = members.select(
        F.col("parent_id").alias("rec"), "child_id", "access", "kind", "name", member_signature().alias("sig"), F.coalesce("func_class", F.lit("normal")).alias("cls"), F.lit(0).alias("depth")
    )
    own = materialize(own.join(level, "rec"), "own-members")
    mine = own.select(F.col("rec").alias("derived"), "access", "sig").distinct()
    order = F.struct("pos", (F.col("was") != "public").alias("later"), "child_id")
    stored = own.where("false").select(
        F.col("rec").alias("derived"), "access", "sig", F.col("access").alias("was"), "child_id", "kind", "name", "cls", "depth", F.lit(None).cast(edges.schema["pos"].dataType).alias("pos"), F.col("layer").alias("to_layer")
    )
    folder = fresh_path(spark, "inherited")
    stored.write.partitionBy("to_layer").parquet(folder)

    def settled() -> DataFrame:
        """The first of what a record's bases have handed to it, by access and signature."""
        handed = spark.read.schema(stored.schema).parquet(folder)
        return handed.groupBy("to_layer", "derived", "access", "sig").agg(F.min_by(F.struct("child_id", "kind", "name", "cls", "depth"), order).alias("m"))

    for k in range(height or 0):
        have = own.where(F.col("layer") == k).drop("layer")
        if k:
            have = have.union(settled().where(F.col("to_layer") == k).select(F.col("derived").alias("rec"), "m.child_id", "access", "m.kind", "m.name", "sig", "m.cls", "m.depth"))
        j = edges.where(F.col("from_layer") == k).join(have, F.col("base") == F.col("rec")).where(~F.col("cls").isin("constructor", "destructor"))
        j = j.withColumn("was", F.col("access")).withColumn("access", inherited_access(F.col("base_access"), F.col("was"))).where("access is not null")
        j = j.join(mine, ["derived", "access", "sig"], "left_anti").withColumn("depth", F.col("depth") + 1)
        j.select(stored.columns).write.mode("append").partitionBy("to_layer").parquet(folder)
    return settled().select(F.col("derived").alias("derived_id"), "m.child_id", "access", "m.kind", "m.name", "m.depth")


def copied_id(parent, original):
    """Id of a member copied into another record."""
    return F.sha1(F.concat_ws("-", parent, original))


def inherit(inherited: DataFrame, symbols: DataFrame, mode: str = "copy-dependencies") -> DataFrame:
    """``inherited`` with a final id: 'reference' keeps the original except for
    dependency members, which are not referenced; 'copy-dependencies' copies those;
    'copy-all' copies every member. Copies of dependencies take the derived record's
    mode, others keep theirs."""
    s = symbols.select(F.col("id").alias("__c"), F.col("extraction").alias("__ce"))
    d = symbols.select(F.col("id").alias("__d"), F.col("extraction").alias("__de"))
    j = inherited.join(s, F.col("child_id") == F.col("__c")).join(d, F.col("derived_id") == F.col("__d"))
    if mode == "reference":
        j = j.where(F.col("__ce") != DEPENDENCY)
    copy = {"reference": F.lit(False), "copy-dependencies": F.col("__ce") == DEPENDENCY, "copy-all": F.lit(True)}[mode]
    return j.select(
        "derived_id", "child_id", "access", copy.alias("copied"), F.when(copy, copied_id(F.col("derived_id"), F.col("child_id"))).otherwise(F.col("child_id")).alias("member_id"),
        F.when(copy & (F.col("__ce") == DEPENDENCY), F.col("__de")).otherwise(F.col("__ce")).alias("extraction"),
    )


def derived_index(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(base_id, derived): ids of regular records with a public base edge to a
    regular record, unique, by (name, id)."""
    regular = symbols.where(F.col("extraction") == REGULAR)
    b = regular.select(F.col("id").alias("base_id"))
    d = regular.select(F.col("id").alias("derived_id"), F.col("name").alias("__n"))
    edges = bases.where("access = 'public'").select("base_id", "derived_id").distinct().join(b, "base_id").join(d, "derived_id")
    return edges.groupBy("base_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("__n", "derived_id"))), lambda x: x["derived_id"]).alias("derived"))
