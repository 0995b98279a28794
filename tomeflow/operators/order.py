"""Member, traversal and report orders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import materialize
from tomeflow.functions.names import OPERATORS, RELATIONAL


@dataclass(frozen=True)
class MemberOrder:
    """Switches of the member sort."""

    constructors_first: bool = True
    destructors_first: bool = True
    assignment_first: bool = True
    relational_last: bool = True
    conversion_last: bool = True
    by: str = "name"  # or "location"


def operator_rank(op: Column) -> Column:
    """Place of an operator in the fixed operator order; 0 for none."""
    table = F.create_map(*[x for k, row in enumerate(OPERATORS) for x in (F.lit(row[0]), F.lit(k + 1))])
    return F.coalesce(F.try_element_at(table, op), F.lit(0))


def member_sort_keys(o: MemberOrder = MemberOrder()) -> list[Column]:
    """Sort columns over func_class, operator, param_count, first_param_kind,
    first_param_symbol, parent_id, name, short_path, line, col, is_template,
    targ_count, tparam_count, params_text and id."""
    cls, op = F.coalesce("func_class", F.lit("")), F.coalesce("operator", F.lit(""))
    last = lambda c: c.cast("int")
    first = lambda c: (~c).cast("int")
    keys: list[Column] = []
    ctor, assign, relational = cls == "constructor", op == "operator=", op.isin(RELATIONAL)
    if o.constructors_first:
        keys.append(first(ctor))
    if o.destructors_first:
        keys.append(first(cls == "destructor"))
    if o.assignment_first:
        keys.append(first(assign))
    if o.relational_last:
        keys += [last(relational), F.when(relational, operator_rank(op)).otherwise(0)]
    if o.conversion_last:
        keys.append(last(cls == "conversion"))
    single = (ctor | assign) & (F.col("param_count") == 1)
    own = single & F.col("first_param_kind").isin("lref", "rref") & (F.col("first_param_symbol") == F.col("parent_id"))
    own = F.coalesce(own, F.lit(False))
    keys += [F.when(single, F.when(own, F.when(F.col("first_param_kind") == "lref", 0).otherwise(1)).otherwise(2)).otherwise(0)]
    keys += [F.col("name")] if o.by == "name" else [F.col("short_path"), F.col("line"), F.col("col")]
    return keys + tie_break_keys()


def tie_break_keys() -> list[Column]:
    """Name, number of parameters, template-ness, argument and parameter
    counts, parameter texts, id."""
    return [F.col("name"), F.col("param_count"), F.col("is_template").cast("int"), F.col("targ_count"), F.col("tparam_count"), F.col("params_text"), F.col("id")]


#: Rows of a group beyond which its ranks are made from ranges.
HOT_GROUP = 1_000_000


def number_members(members: DataFrame, keys: list[Column], scope: list[str], hot: int = HOT_GROUP) -> DataFrame:
    """``idx`` from 0 within a scope's group. Groups of up to ``hot`` rows share
    one window; larger ones are cut in ranges of the sort keys (sampled by the range
    shuffle), each range is ranked by itself and shifted by the counts of those before
    it, so no task gets a whole hot group. Keys should tell rows apart: rows that are
    equal in all of them stay in one range."""
    sizes = members.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(scope)]).agg(F.count(F.lit(1)).alias("__n"))
    large = materialize(sizes.where(F.col("__n") > hot), "hot-groups")  # at most rows / hot groups
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(scope)])
    number = F.row_number().over(Window.partitionBy(*scope).orderBy(*keys)) - 1
    if large.isEmpty():
        return members.withColumn("idx", number)
    names = [f"__k{k}" for k in range(len(keys))]
    rows = members.join(F.broadcast(large), same, "left_semi").select("*", *[k.alias(n) for k, n in zip(keys, names)])
    parts = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(parts, *scope, *names).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*scope, "__part").agg(F.count(F.lit(1)).alias("__n"))  # at most groups + parts rows
    before = Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(scope)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*scope, "__part").orderBy(*names)))
    spread = ranked.join(F.broadcast(shift), same & (F.col("__part") == F.col("__p"))).withColumn("idx", (F.col("__before") + F.col("__r") - 1).cast("int"))
    rest = members.join(F.broadcast(large), same, "left_anti").withColumn("idx", number)
    return rest.unionByName(spread.select(*members.columns, "idx"))


def traversal_order(symbols: DataFrame) -> DataFrame:
    """T5: by name, then the per-kind tie-break."""
    return symbols.orderBy(*tie_break_keys())


def warning_order(warnings: DataFrame) -> DataFrame:
    """Path ascending, line and column descending."""
    return warnings.orderBy(F.asc("full_path"), F.desc("line"), F.desc("col"), F.asc("message"))


def related_order(text: Column, id_: Column) -> list[Column]:
    """Texts without '::' first, fewer ':' first, then text and id."""
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    return [F.contains(text, F.lit("::")).cast("int"), colons, text, id_]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (a report's limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def iteration_variables(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Index, first and last of rows within a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("index", F.row_number().over(w) - 1).withColumn("first", F.col("index") == 0).withColumn("last", F.lead(F.lit(1)).over(w).isNull())


def first_entry(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
