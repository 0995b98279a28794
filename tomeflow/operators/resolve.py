"""Name resolution and reference maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import fixpoint, materialize
from tomeflow.operators.filters import transparent


def attach(ids: DataFrame, symbols: DataFrame, id_col: str) -> DataFrame:
    """Symbol columns for every id; missing ids are skipped."""
    return ids.join(symbols.withColumnRenamed("id", "__sid"), F.col(id_col) == F.col("__sid")).drop("__sid")


def existing(ids: DataFrame, symbols: DataFrame, id_col: str) -> DataFrame:
    """J2."""
    return ids.join(symbols.select(F.col("id").alias("__sid")), F.col(id_col) == F.col("__sid"), "left_semi")


#: Id of the global scope where it is no row itself.
GLOBAL = "::"


def name_index(symbols: DataFrame, aliases: DataFrame | None = None, overloads: DataFrame | None = None) -> DataFrame:
    """(scope_id, name, id, via): members by scope and name. Symbols whose parent is
    null or no row are members of ``GLOBAL``. Members of transparent scopes are found
    in the enclosing scope too (J6, ``via`` = levels skipped), those of a typedef's
    target under the typedef (J4: aliases id -> target_id), and an overload set stands
    for its members (overloads set_id -> member_id)."""
    rows = symbols.select(F.col("id").alias("__k"))
    owned = symbols.join(rows, F.col("parent_id") == F.col("__k"), "left").withColumn("parent_id", F.coalesce("__k", F.lit(GLOBAL))).drop("__k")
    index = owned.select(F.col("parent_id").alias("scope_id"), "name", "id", F.lit(0).alias("via"))
    clear = owned.where(transparent()).select(F.col("id").alias("__t"), F.col("parent_id").alias("__up"))

    def outward(part: DataFrame) -> DataFrame:
        return part.join(clear, F.col("scope_id") == F.col("__t")).select(F.col("__up").alias("scope_id"), "name", "id", (F.col("via") + 1).alias("via"))

    index = reduce(DataFrame.union, fixpoint(index, outward, tag="names"))
    if aliases is not None:
        a = aliases.select(F.col("id").alias("__a"), "target_id")
        index = index.union(index.join(a, F.col("scope_id") == F.col("target_id")).select(F.col("__a").alias("scope_id"), "name", "id", "via"))
    if overloads is not None:
        o = overloads.select(F.col("set_id").alias("__o"), "member_id")
        index = index.join(o, F.col("id") == F.col("__o"), "left").select("scope_id", "name", F.coalesce("member_id", "id").alias("id"), "via")
    return index


def resolve_scoped(refs: DataFrame, closure: DataFrame, index: DataFrame, root: str | None = None) -> DataFrame:
    """(context_id, name) pairs of ``refs`` with the found id: the context is
    tried first, then each enclosing scope outward, the global scope at last; a leading
    '::' starts at the global scope and goes no further; 'a::b' is walked component by
    component inside the scope. ``dist`` is the number of scopes left, 0 for a leading
    '::'. ``root`` is the id of the global scope, if that is a row (with or without
    its members' parent being it); a context that is no row finds '::' names only.

    Distinct pairs are resolved once and joined back. Names with a first or last
    component that nothing has are dropped before scopes are multiplied."""
    top = F.lit(GLOBAL if root is None else root)
    once = refs.select("context_id", "name").distinct()
    parts = F.split(F.regexp_replace("name", "^::", ""), "::")
    asked = once.select("context_id", "name", parts.alias("__parts"), F.startswith("name", F.lit("::")).alias("__abs"))
    known = index.select(F.col("name").alias("__known")).distinct()
    for part in (F.get("__parts", F.lit(0)), F.element_at("__parts", -1)):
        asked = asked.join(known, part == F.col("__known"), "left_semi")
    asked = materialize(asked, "asked")
    relative = asked.where("not __abs").drop("__abs")
    scopes = closure.select(F.col("id").alias("__c"), F.col("ancestor").alias("__scope"), "dist")
    inside = relative.join(scopes, F.col("context_id") == F.col("__c")).select("context_id", "name", "__parts", "dist", F.col("__scope").alias("__at"))
    depth = closure.join(relative.select(F.col("context_id").alias("__k")).distinct(), F.col("id") == F.col("__k"), "left_semi").groupBy(F.col("id").alias("__c")).agg(F.max("dist").alias("dist"))
    outside = relative.join(depth, F.col("context_id") == F.col("__c")).select("context_id", "name", "__parts", (F.col("dist") + 1).alias("dist"), F.lit(GLOBAL).alias("__at"))
    # a root row and the virtual scope are one: members of either are found from both
    absolute = asked.where("__abs").select("context_id", "name", "__parts", F.lit(0).alias("dist"), F.explode(F.array_distinct(F.array(top, F.lit(GLOBAL)))).alias("__at"))
    walk = inside.union(outside).union(absolute).withColumn("via", F.lit(0))
    most = asked.agg(F.max(F.size("__parts"))).first()[0] or 0
    done = walk.limit(0)
    i = index.select(F.col("scope_id").alias("__s"), F.col("name").alias("__n"), F.col("id").alias("__i"), F.col("via").alias("__v"))
    for k in range(most):
        walk = walk.join(i, (F.col("__at") == F.col("__s")) & (F.get("__parts", F.lit(k)) == F.col("__n")))
        walk = walk.select("context_id", "name", "__parts", "dist", F.col("__i").alias("__at"), (F.col("via") + F.col("__v")).alias("via"))
        if k % 4 == 3 and k + 1 < most:
            walk = materialize(walk, "walk")
        done = done.union(walk.where(F.size("__parts") == k + 1))
    best = F.min_by(F.struct("__at", "dist"), F.struct("dist", "via", "__at"))
    found = done.groupBy("context_id", "name").agg(best.alias("__b")).select("context_id", "name", F.col("__b.__at").alias("target_id"), F.col("__b.dist").alias("dist"))
    return refs.join(found, ["context_id", "name"], "left")


def decayed(type_text: Column) -> Column:
    """A type's text without top-level const/volatile, an array as a pointer."""
    flat = F.regexp_replace(F.trim(type_text), "\\s+", " ")
    pointer = F.regexp_replace(flat, "\\s*\\[[^\\]]*\\]$", " *")
    suffix = F.regexp_replace(pointer, "(\\*|&)\\s*(const|volatile)(\\s+(const|volatile))*$", "$1")
    plain = ~F.regexp_like(suffix, F.lit("[*&]"))
    return F.trim(F.when(plain, F.regexp_replace(suffix, "\\b(const|volatile)\\b\\s*", "")).otherwise(suffix))


# How well a candidate's parts match a reference, worst to best.
MATCH_RANKS = ["name", "targ-count", "targs", "param-count", "documented", "params", "qualifiers", "noexcept-definition", "noexcept-kind", "noexcept-operand"]


def best_match(candidates: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Of candidates with boolean columns m_targ_count, m_targs, m_param_count,
    m_documented, m_params, m_qualifiers and m_noexcept_definition, m_noexcept_kind and
    m_noexcept_operand, the one of the highest rank; of equal ranks the first. A criterion without a column holds for none. A rank counts only if those below it hold, but
    for ``documented``: it prefers one of those whose parameters do not match."""
    holds = {c: F.coalesce(F.col("m_" + c), F.lit(False)) if "m_" + c in candidates.columns else F.lit(False) for c in ("targ_count", "targs", "param_count", "documented", "params", "qualifiers", "noexcept_definition", "noexcept_kind", "noexcept_operand")}
    rank, chain = F.lit(0), F.lit(True)
    for k, (c, ok) in enumerate(holds.items(), 1):
        rank = F.when(chain & ok, k).otherwise(rank)
        chain = chain & ok if c != "documented" else chain
    w = Window.partitionBy(*keys).orderBy(F.desc("match_rank"), pos)
    ranked = candidates.withColumn("match_rank", rank).withColumn("__r", F.row_number().over(w))
    return ranked.where("__r = 1").drop("__r")


def clean_references(df: DataFrame, symbols: DataFrame, ref_col: str) -> DataFrame:
    """A reference to a missing id becomes null."""
    known = symbols.select(F.col("id").alias("__k")).distinct()
    return df.join(known, F.col(ref_col) == F.col("__k"), "left").withColumn(ref_col, F.col("__k")).drop("__k")


def clean_reference_arrays(df: DataFrame, symbols: DataFrame, key: str, array: str) -> DataFrame:
    """J19, arrays: missing ids are dropped, order is kept."""
    known = symbols.select(F.col("id").alias("__k")).distinct()
    each = df.select(F.col(key).alias("__key"), F.posexplode(array).alias("__p", "__k")).join(known, "__k", "left_semi")
    kept = each.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__k"))), lambda x: x["__k"]).alias("__kept"))
    out = df.join(kept, F.col(key) == F.col("__key"), "left")
    return out.withColumn(array, F.coalesce("__kept", F.slice(array, 1, 0))).drop("__key", "__kept")


def resolve_aliases(aliases: DataFrame, id_col: str = "id", target_col: str = "target_id", max_rounds: int = 20) -> DataFrame:
    """(id, target_id) with the final target that is no alias, by pointer
    doubling: a chain of n links takes log2(n) rounds. Cycles resolve to null."""
    cur = materialize(aliases.select(F.col(id_col).alias("id"), F.col(target_col).alias("target_id")), "aliases")
    for _ in range(max_rounds):
        nxt = cur.select(F.col("id").alias("__i"), F.col("target_id").alias("__t"))
        step = cur.join(nxt, F.col("target_id") == F.col("__i"), "left")
        moved = materialize(step.select("id", F.coalesce("__t", "target_id").alias("target_id"), F.col("__i").isNotNull().alias("__more")), "aliases")
        more = not moved.where("__more").isEmpty()
        cur = moved.drop("__more")
        if not more:
            return cur
    ids = cur.select(F.col("id").alias("__i"))
    return cur.join(ids, F.col("target_id") == F.col("__i"), "left").select("id", F.when(F.col("__i").isNull(), F.col("target_id")).alias("target_id"))


def same_name_in_context(a: Column, b: Column, context: Column, sep: str = "::") -> Column:
    """Names written in a scope are equal if, from the right, their components
    agree and the longer one's extra leading components are the scope's."""
    x, y = F.reverse(F.split(a, sep)), F.reverse(F.split(b, sep))
    scope = F.split(context, sep)
    n = F.least(F.size(x), F.size(y))
    extra = F.reverse(F.when(F.size(x) > F.size(y), F.slice(x, n + 1, F.size(x))).otherwise(F.slice(y, n + 1, F.size(y))))
    tail = F.slice(scope, F.greatest(F.lit(1), F.size(scope) - F.size(extra) + 1), F.size(extra))
    return (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n)) & ((F.size(extra) == 0) | (extra == tail))
