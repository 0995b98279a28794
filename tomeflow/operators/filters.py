"""Filters, predicates and projections over symbols."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.core import materialize
from tomeflow.functions import paths as P
from tomeflow.functions.names import RELATIONAL
from tomeflow.operators.globs import PATH, glob_match, glob_prefix_match, is_literal
from tomeflow.operators.hierarchy import paths

REGULAR, SEE_BELOW, IMPLEMENTATION, DEPENDENCY = 0, 1, 2, 3


@dataclass(frozen=True)
class SymbolRules:
    """Glob lists on qualified names."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    see_below: list[str] = field(default_factory=list)
    implementation_defined: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class TypeRules:
    """Which kinds of declarations are extracted."""

    private: bool = False
    private_virtual: bool = False
    anonymous_namespaces: bool = True
    static: bool = False
    local_classes: bool = True
    implicit: bool = False


@dataclass(frozen=True)
class FileRules:
    input: list[str] = field(default_factory=list)
    recursive: bool = True
    exclude: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    file_patterns: list[str] = field(default_factory=lambda: ["*.hpp", "*.h", "*.cpp", "*.cc", "*.cxx", "*.c"])


def _any(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs, F.lit(False))


def type_filter(rules: TypeRules, file: str = "full_path") -> Column:
    """F2 over columns access, is_virtual, is_anonymous, kind, is_static,
    is_record_member, is_implicit and the file's path. Private members are judged by
    the two private switches alone."""
    in_source = F.regexp_like(F.col(file), F.lit("\\.(cpp|cc|cxx|c)$"))
    dropped = [
        (F.col("kind") == "namespace") & F.col("is_anonymous") & ~F.lit(rules.anonymous_namespaces),
        F.col("kind").isin("function", "variable") & F.col("is_static") & ~F.col("is_record_member") & ~F.lit(rules.static),
        (F.col("kind") == "record") & in_source & ~F.lit(rules.local_classes),
        (F.col("kind") == "record") & F.col("is_anonymous"),
        F.col("is_implicit") & ~F.lit(rules.implicit),
    ]
    private = F.lit(rules.private) | (F.coalesce("is_virtual", F.lit(False)) & F.lit(rules.private_virtual))
    return F.when(F.col("access") == "private", private).otherwise(~_any([F.coalesce(d, F.lit(False)) for d in dropped]))


def file_filter(path: Column, rules: FileRules) -> Column:
    """under an input directory (anywhere, if there is none), not excluded, and a
    wanted name."""
    under = [P.has_prefix(path, F.lit(d)) if rules.recursive else P.parent_dir(path) == P.make_dirsy(F.lit(d)) for d in rules.input]
    excluded = _any([P.has_prefix(path, F.lit(d)) for d in rules.exclude]) | glob_match(path, rules.exclude_patterns, PATH)
    named = glob_match(P.file_name(path), rules.file_patterns, PATH) if rules.file_patterns else F.lit(True)
    return F.coalesce((_any(under) if rules.input else F.lit(True)) & ~excluded & named & path.isNotNull(), F.lit(False))


def symbol_mode(name: Column, rules: SymbolRules) -> Column:
    """mode a name's own patterns give, null without a match. Exclusion first,
    then implementation-defined, see-below, include."""
    return F.coalesce(
        F.when(glob_match(name, rules.exclude), DEPENDENCY),
        F.when(glob_match(name, rules.implementation_defined), IMPLEMENTATION),
        F.when(glob_match(name, rules.see_below), SEE_BELOW),
        F.when(glob_match(name, rules.include), REGULAR),
    )


def literal_mode(name: Column, rules: SymbolRules) -> Column:
    """mode of the literal patterns that a namespace's name equals, else null."""
    kinds = ((rules.implementation_defined, IMPLEMENTATION), (rules.see_below, SEE_BELOW), (rules.include, REGULAR))
    return F.coalesce(F.lit(None).cast("int"), *[F.when(glob_match(name, [g for g in globs if is_literal(g)]), mode) for globs, mode in kinds])


def implied_by_children(own: DataFrame, default: int) -> DataFrame:
    """(id, implied): least specific mode of the children of namespaces that only
    match as a prefix, judged by the patterns alone; null if all are dependencies.
    A mode counts for each namespace of the unbroken chain of such namespaces above
    its symbol; one whose own children are all dependencies counts by default."""
    scopes = own.where("prefix").select("id", "parent_id")
    chain = materialize(paths(scopes, F.col("id")).select(F.col("id").alias("__s"), F.col("path").alias("__chain")), "prefixes")
    mode = F.coalesce("strict", F.lit(default))
    kids = own.where("not prefix").select("parent_id", mode.alias("m")).where(F.col("m") < DEPENDENCY).groupBy("parent_id").agg(F.min("m").alias("m"))
    each = kids.join(chain, F.col("parent_id") == F.col("__s")).select(F.explode("__chain").alias("__p"), "m")
    least = each.groupBy("__p").agg(F.min("m").alias("__m"))
    known = chain.join(least, F.col("__s") == F.col("__p"), "left").select("__s", "__chain", F.col("__m").alias("implied"))
    if default < DEPENDENCY:
        known = materialize(known, "prefixes")
        above = known.where("implied is null").select(F.explode(F.slice("__chain", 1, F.size("__chain") - 1)).alias("__p")).distinct()
        known = known.join(above, F.col("__s") == F.col("__p"), "left").withColumn("implied", F.least("implied", F.when(F.col("__p").isNotNull(), default)))
    return known.select(F.col("__s").alias("id"), "implied")


def classify_symbols(symbols: DataFrame, rules: SymbolRules) -> DataFrame:
    """``symbols`` (id, parent_id, kind, qualified_name, ...) with a column
    ``extraction`` 0..3. A symbol without a parent row is a member of the global
    scope, which is extracted.

    From the root down, the first of these rules decides: excluded itself, or (if
    anything is excluded) its parent is a dependency; implementation-defined itself,
    or its parent is; see-below itself, or its parent is (a record's members are
    dependencies then); included itself; the nearest enclosing namespace that a
    literal pattern names; for a namespace, what its children imply (F7); for
    others, the mode of an extracted parent that did not only match as a prefix;
    regular without any include pattern, else a dependency. Members of a namespace
    that matched as a prefix are judged without their parent.

    What the rules ask of a symbol is a few flags, so each symbol gets those of the
    scopes above it, root first (by pointer doubling, like its name), and folds them:
    the number of jobs does not depend on the depth."""
    name = F.col("qualified_name")
    default = DEPENDENCY if rules.include else REGULAR
    scopes = F.col("kind") == "namespace"
    strict = symbol_mode(name, rules)
    prefix = scopes & strict.isNull() & glob_prefix_match(F.concat(name, F.lit("::")), rules.include + rules.see_below + rules.implementation_defined)
    own = symbols.select("id", "parent_id", scopes.alias("ns"), strict.cast("int").alias("strict"), prefix.alias("prefix"), F.when(scopes, literal_mode(name, rules)).cast("int").alias("literal"))
    own = materialize(own, "own-modes")
    own = own.join(implied_by_children(own, default).withColumnRenamed("id", "__i"), F.col("id") == F.col("__i"), "left").drop("__i")
    flags = F.struct("ns", "strict", "prefix", "literal", F.col("implied").cast("int").alias("implied"))

    def judged(top: Column, x: Column) -> Column:
        parent = lambda mode: (top["mode"] == mode) & ~top["global"]
        bound = F.coalesce(
            F.when(x["strict"] == DEPENDENCY, DEPENDENCY),
            F.when(F.lit(bool(rules.exclude)) & parent(DEPENDENCY), DEPENDENCY),
            F.when(x["strict"] == IMPLEMENTATION, IMPLEMENTATION),
            F.when(F.lit(bool(rules.implementation_defined)) & parent(IMPLEMENTATION), IMPLEMENTATION),
            F.when(x["strict"] == SEE_BELOW, SEE_BELOW),
            F.when(F.lit(bool(rules.see_below)) & parent(SEE_BELOW), F.when(top["ns"], SEE_BELOW).otherwise(DEPENDENCY)),
            F.when(x["strict"] == REGULAR, REGULAR),
            top["above"],
        )
        bound = F.when(top["apart"], x["strict"]).otherwise(bound)
        inherits = ~top["apart"] & ~x["ns"] & (top["mode"] != DEPENDENCY) & ~top["by_prefix"]
        mode = F.coalesce(bound, F.when(x["prefix"], x["implied"]), F.when(inherits, top["mode"]), F.lit(default))
        open_ = bound.isNull() & x["prefix"]
        return state(x["ns"], mode.cast("int"), open_ & x["implied"].isNotNull(), open_, F.coalesce(x["literal"], top["above"]), F.lit(False))

    def state(*fields: Column) -> Column:
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("ns", "mode", "by_prefix", "apart", "above", "global"))])

    root = state(F.lit(False), F.lit(REGULAR), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(True))
    modes = paths(own, flags).select("id", F.aggregate("path", root, judged, lambda s: s["mode"]).alias("extraction"))
    return symbols.join(modes, "id")


def classify(symbols: DataFrame, rules: SymbolRules, types: TypeRules | None = None, files: FileRules | None = None) -> DataFrame:
    """a failed type or file filter makes a symbol a dependency; else F4-F9."""
    out = classify_symbols(symbols, rules)
    ok = F.lit(True)
    if types:
        ok = ok & type_filter(types)
    if files:
        ok = ok & file_filter(F.col("full_path"), files)
    return out.withColumn("extraction", F.when(ok, F.col("extraction")).otherwise(DEPENDENCY))


def visible_page(show_enum_constants: bool = True, show_namespaces: bool = True) -> Column:
    """F13."""
    out = F.col("extraction").isin(REGULAR, SEE_BELOW)
    if not show_enum_constants:
        out = out & (F.col("kind") != "enum-constant")
    if not show_namespaces:
        out = out & (F.col("kind") != "namespace")
    return out


def of_kind(ids: DataFrame, symbols: DataFrame, kind: str, id_col: str = "id") -> DataFrame:
    """rows of ``ids`` whose symbol has a kind."""
    return ids.join(symbols.where(F.col("kind") == kind).select(F.col("id").alias("__k")), F.col(id_col) == F.col("__k"), "left_semi")


def undocumented(symbols: DataFrame, documented: DataFrame, extract_all: bool = False, id_col: str = "id", doc_id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(undocumented rows, rows that stay in the corpus): regular symbols
    other than namespaces without a doc in any unit."""
    docs = documented.select(F.col(doc_id_col).alias("__d"))
    lacking = symbols.where((F.col("kind") != "namespace") & (F.col("extraction") == REGULAR)).join(docs, F.col(id_col) == F.col("__d"), "left_anti")
    kept = symbols if extract_all else symbols.join(lacking.select(F.col(id_col).alias("__l")), F.col(id_col) == F.col("__l"), "left_anti")
    return lacking, kept


def own_members(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """F16: members whose own parent is the scope."""
    own = symbols.select(F.col("id").alias("__id"), F.col("parent_id").alias("__p"))
    return members.join(own, (F.col("child_id") == F.col("__id")) & (F.col("parent_id") == F.col("__p")), "left_semi")


def transparent() -> Column:
    """inline namespace or unscoped enum."""
    return ((F.col("kind") == "namespace") & F.col("is_inline")) | ((F.col("kind") == "enum") & ~F.col("scoped"))


def function_predicates() -> dict[str, Column]:
    """F18 over func_class, operator, param_count, first_param_kind,
    first_param_symbol and parent_id of functions."""
    cls, op = F.col("func_class"), F.coalesce("operator", F.lit(""))
    own = (F.col("first_param_symbol") == F.col("parent_id")) & (F.col("param_count") == 1)
    ctor, assign = cls == "constructor", op == "operator="
    default = ctor & (F.col("param_count") == 0)
    by = lambda base, kind: F.coalesce(base & own & (F.col("first_param_kind") == kind), F.lit(False))
    out = {
        "is_default_ctor": default, "is_copy_ctor": by(ctor, "lref"), "is_move_ctor": by(ctor, "rref"), "is_copy_assign": by(assign, "lref"), "is_move_assign": by(assign, "rref"),
        "is_stream_insertion": (op == "operator<<") & (F.col("param_count") == 2),
        "is_relational": op.isin(RELATIONAL),
    }
    special = (cls == "destructor") | default | out["is_copy_ctor"] | out["is_move_ctor"] | out["is_copy_assign"] | out["is_move_assign"]
    return out | {"is_special": special}


def primary_template() -> Column:
    """F19."""
    return (F.col("tparam_count") > 0) & (F.col("targ_count") == 0)


def primary_location(definition: Column, declarations: Column, prefer_definition: Column) -> Column:
    """The definition if preferred or without declarations, else the first
    documented declaration, else the first one."""
    documented = F.filter(declarations, lambda d: d["documented"])
    none = declarations.isNull() | (F.size(declarations) == 0)
    return F.coalesce(F.when(prefer_definition | none, definition), F.get(documented, F.lit(0)), F.get(declarations, F.lit(0)), definition)


def short_path(full: Column, source_root: str, search_dirs: list[str], path_dirs: list[str] = []) -> Column:
    """Below the first search directory that is a prefix, else the source root,
    else a PATH directory, else the full path."""
    cut = lambda d: F.when(F.startswith(full, F.lit(d.rstrip("/") + "/")), F.substring(full, len(d.rstrip("/")) + 2, 1 << 30))
    return F.coalesce(*[cut(d) for d in [*search_dirs, source_root, *path_dirs]], full)


def page_url(path: Column, ext: str = "html") -> Column:
    """P3, multi-page: '/a/b.ext' of a legible path."""
    return F.concat(F.lit("/"), F.array_join(path, "/"), F.lit("." + ext))


def page_anchor(path: Column) -> Column:
    """P3, single page: '#a-b'."""
    return F.concat(F.lit("#"), F.array_join(path, "-"))


def alternative_urls(symbols: DataFrame, urls: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, alternative_url) of symbols without a page: that of the primary
    sibling (same parent and name), of the sibling of what a typedef or
    specialization resolves to (``targets``: id, target_id), of the visible parent
    that is not a namespace."""
    page = urls.select(F.col("id").alias("__u"), F.col("url").alias("__url"))
    primary = symbols.where(primary_template()).join(page, F.col("id") == F.col("__u")).groupBy(F.col("parent_id").alias("__pp"), F.col("name").alias("__pn")).agg(F.min("__url").alias("u1"))
    base = symbols.join(page.select("__u"), F.col("id") == F.col("__u"), "left_anti")
    a = base.join(primary, (F.col("parent_id") == F.col("__pp")) & (F.col("name") == F.col("__pn")), "left")
    via = targets.join(page, F.col("target_id") == F.col("__u")).select(F.col("id").alias("__t"), F.col("__url").alias("u2"))
    b = a.join(via, F.col("id") == F.col("__t"), "left")
    up = symbols.where("kind <> 'namespace'").join(page, F.col("id") == F.col("__u")).select(F.col("id").alias("__par"), F.col("__url").alias("u3"))
    return b.join(up, F.col("parent_id") == F.col("__par"), "left").select("id", F.coalesce("u1", "u2", "u3").alias("alternative_url"))


def tranche(parent_kind: Column, access: Column, kind: Column, is_static: Column) -> Column:
    """P10: member group of a child."""
    group = (
        F.when(kind == "function", F.when(is_static, "static-functions").otherwise("functions"))
        .when(kind == "variable", F.when(is_static, "static-variables").otherwise("variables"))
        .when(kind == "record", "records").when(kind == "enum", "enums").when(kind == "typedef", "typedefs").when(kind == "namespace", "namespaces")
        .when(kind == "concept", "concepts").when(kind == "guide", "guides").when(kind == "using", "usings").when(kind == "namespace-alias", "namespace-aliases")
        .when(kind == "friend", "friends").otherwise(F.concat(kind, F.lit("s")))
    )
    return F.when(parent_kind == "record", F.concat(access, F.lit("-"), group)).otherwise(group)


def assign_tranches(symbols: DataFrame) -> DataFrame:
    """P10 as a table: distinct (parent_id, grp, child_id)."""
    parent = symbols.select(F.col("id").alias("__p"), F.col("kind").alias("__pk"))
    j = symbols.join(parent, F.col("parent_id") == F.col("__p"))
    grp = tranche(F.col("__pk"), F.col("access"), F.col("kind"), F.coalesce("is_static", F.lit(False)))
    return j.select("parent_id", grp.alias("grp"), F.col("id").alias("child_id")).dropDuplicates(["parent_id", "child_id"])
