"""Related functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.operators.filters import REGULAR
from tomeflow.operators.hierarchy import transitive
from tomeflow.operators.order import related_order


def auto_relates(functions: DataFrame, records: DataFrame, bases: DataFrame, friends: DataFrame) -> DataFrame:
    """Distinct (function_id, record_id) of free functions and the regular records
    or enums of their first parameter, of records derived from it if it is a
    reference or pointer, of the return type and of its first template argument;
    friends of the record are left out. Functions count if they are regular,
    documented, no methods and members of a namespace. ``functions``: id, extraction,
    has_doc, is_record_method, parent_kind, first_param_symbol, first_param_kind,
    return_symbol, return_targ_symbol; ``records``: id, kind, extraction."""
    free = (F.col("extraction") == REGULAR) & F.col("has_doc") & ~F.col("is_record_method") & (F.col("parent_kind") == "namespace")
    functions = functions.where(F.coalesce(free, F.lit(False)))
    known = records.where((F.col("extraction") == REGULAR) & F.col("kind").isin("record", "enum")).select(F.col("id").alias("record_id"))
    first = functions.select(F.col("id").alias("function_id"), F.col("first_param_symbol").alias("record_id"), "first_param_kind")
    derived = transitive(bases, "derived_id", "base_id")
    indirect = first.where(F.col("first_param_kind").isin("lref", "rref", "pointer")).join(derived, F.col("record_id") == F.col("base_id")).select("function_id", F.col("derived_id").alias("record_id"))
    returned = functions.select(F.col("id").alias("function_id"), F.col("return_symbol").alias("record_id"))
    types = records.where(F.col("kind").isin("record", "enum")).select(F.col("id").alias("return_symbol"))
    argument = functions.join(types, "return_symbol", "left_semi").select(F.col("id").alias("function_id"), F.col("return_targ_symbol").alias("record_id"))
    pairs = first.drop("first_param_kind").union(indirect).union(returned).union(argument).where("record_id is not null").distinct().join(known, "record_id", "left_semi")
    f = friends.select("record_id", F.col("friend_id").alias("function_id"))
    return pairs.join(f, ["record_id", "function_id"], "left_anti").select("function_id", "record_id")


def related_back_edges(relates: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, function_id, text) back edges, unique, resolved targets only,
    and the rows whose source is no function (to be warned about and cleared).
    ``relates``: symbol_id, target_id, literal."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("kind").alias("__k"), F.col("name").alias("__n"))
    j = relates.join(s, "symbol_id")
    bad = j.where("__k <> 'function'").select("symbol_id", "literal")
    good = j.where("__k = 'function' and target_id is not null").select(F.col("target_id").alias("record_id"), F.col("symbol_id").alias("function_id"), F.col("__n").alias("text"))
    return good.dropDuplicates(["record_id", "function_id"]), bad


def related_lists(back: DataFrame) -> DataFrame:
    """(record_id, related): function ids in the order of T7."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(related_order(F.col("text"), F.col("function_id")))]
    return back.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys))), lambda x: x["k3"]).alias("related"))
