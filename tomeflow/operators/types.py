"""Type texts from flattened type nodes (P9) and specifier texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cv(node: Column, before: bool) -> Column:
    words = F.concat_ws(" ", F.when(node["is_const"], "const"), F.when(node["is_volatile"], "volatile"))
    glued = F.concat(words, F.lit(" ")) if before else F.concat(F.lit(" "), words)
    return F.when(words == "", F.lit("")).otherwise(glued)


def type_texts(nodes: DataFrame, key: str = "type_id") -> DataFrame:
    """(key, type_text, innermost) of type nodes: key, depth (0 is outermost), kind
    (named, pointer, lref, rref, array, function), name, is_const, is_volatile,
    bound, args. A chain is folded from its innermost node outward into the text
    before and after a declared name; pointers to arrays and functions get
    parentheses. A chain is a few nodes long, so it is folded within a row."""
    fields = ["kind", "name", "is_const", "is_volatile", "bound", "args"]
    chain = F.sort_array(F.collect_list(F.struct("depth", *fields)), asc=False)
    start = F.struct(F.lit("").alias("before"), F.lit("").alias("after"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("innermost"))

    def fold(acc: Column, node: Column) -> Column:
        kind = node["kind"]
        sign = F.when(kind == "pointer", "*").when(kind == "lref", "&").when(kind == "rref", "&&")
        wrap = sign.isNotNull() & acc["kind"].isin("array", "function")
        name = F.coalesce(node["name"], F.lit(""))
        before = (
            F.when(sign.isNotNull(), F.concat(acc["before"], F.when(wrap, "(").otherwise(""), sign, _cv(node, False)))
            .when(kind == "named", F.concat(_cv(node, True), name))
            .otherwise(acc["before"])
        )
        bound = F.concat(F.lit("["), F.coalesce(node["bound"], F.lit("")), F.lit("]"))
        args = F.concat(F.lit("("), F.coalesce(node["args"], F.lit("")), F.lit(")"), _cv(node, False))
        after = (
            F.when(wrap, F.concat(F.lit(")"), acc["after"]))
            .when(kind == "array", F.concat(bound, acc["after"]))
            .when(kind == "function", F.concat(args, acc["after"]))
            .otherwise(acc["after"])
        )
        return F.struct(before.alias("before"), after.alias("after"), kind.alias("kind"), F.coalesce(acc["innermost"], F.when(kind == "named", name)).alias("innermost"))

    folded = nodes.groupBy(key).agg(chain.alias("__c")).select(key, F.aggregate("__c", start, fold).alias("__t"))
    return folded.select(key, F.concat("__t.before", "__t.after").alias("type_text"), F.col("__t.innermost").alias("innermost"))


def specifier_text(word: str, kind: Column, operand: Column, implicit: Column) -> Column:
    """Text of noexcept or explicit: nothing if implicit or false, the bare word if
    true, else the word with its operand."""
    none = implicit | (kind == "false") & (operand == "") | (kind == "dependent") & (operand == "")
    return F.when(none, F.lit("")).when((kind == "true") & (operand == ""), F.lit(word)).otherwise(F.concat(F.lit(f"{word}("), operand, F.lit(")")))


def template_head(params: Column) -> Column:
    """'template<typename T, int N = 3>' of an array of (kind, key, type, name, default)."""
    one = lambda p: F.concat_ws(" ", F.when(p["kind"] == "type", p["key"]).when(p["kind"] == "template", F.lit("template<...> typename")).otherwise(p["type"]), F.when(p["name"] != "", p["name"]), F.concat(F.lit("= "), p["default"]))
    return F.concat(F.lit("template<"), F.array_join(F.transform(params, one), ", "), F.lit(">"))


def template_args(args: Column) -> Column:
    """'T, 3, list...' of an array of (kind, text, is_pack): a type's text, a constant as
    written or a template's name, with dots after a pack expansion."""
    return F.array_join(F.transform(args, lambda a: F.concat(F.coalesce(a["text"], F.lit("")), F.when(a["is_pack"], "...").otherwise(""))), ", ")
