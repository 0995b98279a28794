"""Merging rows of one id from many units.

"First wins" needs an order: every operator takes a sequence column, which has to
tell the rows of an id apart (``core.placed`` gives rows their place in the input).
Aggregates are partial on the map side, so a hot id moves one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nonempty(c: Column) -> Column:
    """A text unless it is '' (other types: the value itself)."""
    return F.when(c.cast("string") != "", c)


def first_of(value: Column, seq: Column) -> Column:
    """A1: the first non-empty value in sequence order."""
    v = nonempty(value)
    return F.min_by(v, F.when(v.isNotNull(), seq))


def last_of(value: Column, seq: Column) -> Column:
    """The later non-empty value (parent, return type)."""
    v = nonempty(value)
    return F.max_by(v, F.when(v.isNotNull(), seq))


def rising(*keys: str) -> list[Column]:
    """Fields of a sequence in which ``keys`` rise, nulls after all values, as in a row of SQL."""
    return [x for k in keys for x in (F.col(k).isNull(), F.col(k))]


def falling(*keys: str) -> list[Column]:
    """Fields of the reverse of ``rising`` for whole numbers, the least one too."""
    return [x for k in keys for x in (F.col(k).isNotNull(), -1 - F.col(k))]


def merge_symbols(units: DataFrame, seq: str, first: list[str] = [], last: list[str] = [], flags: list[str] = [], mode: str | None = None, id_col: str = "id", back: str | None = None) -> DataFrame:
    """One row per id: ``first`` and ``last`` columns by sequence,
    ``flags`` or-ed, ``mode`` the least specific (smallest). ``back`` is the reverse
    order, where one is needed: the last is the row with the smallest ``back``."""
    s = F.col(seq)
    end = (lambda v: first_of(v, F.col(back))) if back else (lambda v: last_of(v, s))
    aggs = [first_of(F.col(c), s).alias(c) for c in first] + [end(F.col(c)).alias(c) for c in last]
    aggs += [F.bool_or(c).alias(c) for c in flags] + ([F.min(mode).alias(mode)] if mode else [])
    return units.groupBy(id_col).agg(*aggs)


def merge_locations(locations: DataFrame, id_col: str = "id") -> DataFrame:
    """A3: (id, def, decl) of rows (id, is_def, documented, loc): the documented
    definition first, else the smallest; declarations sorted without repeats."""
    key = F.struct(~F.col("documented"), F.col("loc"))
    return locations.groupBy(id_col).agg(
        F.min_by(F.when(F.col("is_def"), F.col("loc")), F.when(F.col("is_def"), key)).alias("def"),
        F.array_sort(F.collect_set(F.when(~F.col("is_def"), F.col("loc")))).alias("decl"),
    )


def merge_children(lists: DataFrame, seq: str, array: str, id_col: str = "id") -> DataFrame:
    """Union of id arrays in order of (sequence, position), first place kept."""
    each = lists.select(id_col, F.struct(seq, F.lit(0)).alias("__s"), F.posexplode(array).alias("__pos", "__child"))
    once = each.groupBy(id_col, "__child").agg(F.min(F.struct("__s", "__pos")).alias("__at"))
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__child")))
    return once.groupBy(id_col).agg(F.transform(ordered, lambda x: x["__child"]).alias(array))


def merge_params(params: DataFrame, seq: str, fields: list[str], id_col: str = "id", pos: str = "pos") -> DataFrame:
    """Parameters by position; a longer list extends; first non-empty field."""
    return params.groupBy(id_col, pos).agg(*[first_of(F.col(c), F.col(seq)).alias(c) for c in fields])


# What makes two doc rows of a section the same when docs are merged.
DOC_KEYS = {
    "returns": ["literal"], "sees": ["literal"], "pre": ["literal"], "post": ["literal"],
    "params": ["name", "direction"], "tparams": ["name"], "exceptions": ["literal"],
}


def merge_docs(blocks: DataFrame, seq: str, id_col: str = "symbol_id") -> DataFrame:
    """Doc blocks (id, section, seq, pos, name, direction, literal) of many units:
    document blocks are appended, other sections keep the first row of their key."""
    field = lambda c: F.when(F.col("section").isin([s for s, k in DOC_KEYS.items() if c in k]), F.col(c))
    keys = [field(c) for c in ("name", "direction", "literal")]
    body = F.when(~F.col("section").isin(*DOC_KEYS), F.struct(seq, "pos"))
    w = Window.partitionBy(id_col, "section", *keys, body).orderBy(seq, "pos")
    return blocks.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def same_members(a: Column, b: Column) -> Column:
    """U4: permutation equality."""
    return F.array_sort(a) == F.array_sort(b)


def sorted_distinct(a: Column) -> Column:
    """U5."""
    return F.array_sort(F.array_distinct(a))


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(*on), on, "left_anti")


def contains(a: Column, item: Column) -> Column:
    """U6."""
    return F.coalesce(F.array_contains(a, item), F.lit(False))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
