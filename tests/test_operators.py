"""Operators on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from tomeflow import core
from tomeflow.operators import docs, filters, hierarchy, inherit, legible, lint, merge, order, overloads, relates, resolve, rollup


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_recursive_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "s string, t string")
    assert len(rows(hierarchy.transitive(e, "s", "t"))) == 9


def test_fixpoint_and_discard(spark):
    levels = core.fixpoint(spark.range(4), lambda f: f.where("id > 0").select((F.col("id") - 1).alias("id")))
    assert [x.count() for x in levels] == [4, 3, 2, 1]
    core.discard(levels[0])


def test_relative_names(spark):
    cases = [("a::b::c", "a::b", "c"), ("a::b", "a::b", "b"), ("x::y", "a::b", "::x::y"), ("a::d", "a::b", "d")]
    df = spark.createDataFrame(cases, "t string, c string, want string")
    got = df.select("want", hierarchy.relative_name(F.col("t"), F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def tree(spark):
    return spark.createDataFrame(
        [("g", None, "namespace", "g"), ("i", "g", "namespace", "i"), ("r", "i", "record", "R"), ("f", "r", "function", "f"), ("e", "g", "enum", "E"), ("v", "e", "enum-constant", "V")],
        "id string, parent_id string, kind string, name string",
    ).withColumn("is_inline", F.col("id") == "i").withColumn("scoped", F.lit(False))


def test_names_through_transparent_scopes(spark):
    t = tree(spark)
    refs = spark.createDataFrame([("f", "R"), ("f", "V"), ("g", "R::f"), ("f", "::R"), ("f", "nothing")], "context_id string, name string")
    found = {(r["context_id"], r["name"]): r["target_id"] for r in resolve.resolve_scoped(refs, hierarchy.ancestors(t), resolve.name_index(t), root="g").collect()}
    assert found == {("f", "R"): "r", ("f", "V"): "v", ("g", "R::f"): "f", ("f", "::R"): "r", ("f", "nothing"): None}


def test_names_from_the_global_scope(spark):
    """'::x' is the global x and not that of a scope around, with and without a root row."""
    part = [("a", None, "namespace", "a"), ("x", None, "record", "x"), ("a.x", "a", "namespace", "x"), ("a.x.y", "a.x", "record", "y"), ("d", "gone", "record", "d")]
    refs = spark.createDataFrame([("a.x.y", n) for n in ("::x", "x", "::a", "a::x", "::a::x::y", "y", "a", "::y", "d", "::gone")] + [("missing", "::x"), ("missing", "x")], "context_id string, name string")
    want = {"::x": "x", "x": "a.x", "::a": "a", "a::x": "a.x", "::a::x::y": "a.x.y", "y": "a.x.y", "a": "a", "::y": None, "d": "d", "::gone": None}
    for root in (None, "root"):
        rows_ = part if root is None else [("root", None, "namespace", ""), *[(i, p or root, k, n) for i, p, k, n in part]]
        t = spark.createDataFrame(rows_, "id string, parent_id string, kind string, name string").withColumn("is_inline", F.lit(False)).withColumn("scoped", F.lit(True))
        out = resolve.resolve_scoped(refs, hierarchy.ancestors(t), resolve.name_index(t), root=root)
        found = {(r["context_id"], r["name"]): r["target_id"] for r in out.collect()}
        assert found == {("a.x.y", n): i for n, i in want.items()} | {("missing", "::x"): "x", ("missing", "x"): None}


def test_long_closures_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(hierarchy, "materialize", lambda df, tag: rounds.append(tag) or core.materialize(df, tag))
    path = spark.range(200).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    assert hierarchy.transitive(path, "s", "t").count() == 200 * 201 // 2
    assert rounds.count("closure-front") <= 10


def test_deep_trees_are_classified_in_few_jobs(spark):
    deep = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("parent_id"), F.lit("namespace").alias("kind"), F.concat(F.lit("n"), "id").alias("name"))
    names = hierarchy.qualified_names(deep).select("id", "qualified_name")
    out = filters.classify_symbols(deep.join(names, "id"), filters.SymbolRules(include=["n0::n1::**"], exclude=["**::n50"]))
    modes = {int(r["id"]): r["extraction"] for r in out.collect()}
    assert [modes[k] for k in (0, 1, 2, 49, 50, 99)] == [0, 0, 0, 0, 3, 3]


def test_diamonds_do_not_multiply_paths(spark):
    """A chain of 12 diamonds has 4096 paths to its top."""
    e, m = [], []
    for k in range(12):
        e += [(f"l{k}", f"t{k}", "public", 0), (f"r{k}", f"t{k}", "public", 0), (f"t{k + 1}", f"l{k}", "public", 0), (f"t{k + 1}", f"r{k}", "public", 1)]
    m = [("t0", "t0.f", "public", "function", "f", "()", "normal"), ("l3", "l3.f", "public", "function", "f", "()", "normal"), ("r7", "r7.g", "public", "function", "g", "()", "normal")]
    members = spark.createDataFrame(m, "parent_id string, child_id string, access string, kind string, name string, signature string, func_class string")
    bases = spark.createDataFrame(e, "derived_id string, base_id string, access string, pos int")
    got = {(r["derived_id"], r["child_id"]): r["depth"] for r in inherit.base_members(bases, members).collect()}
    assert got["t12", "l3.f"] == 17 and got["t12", "r7.g"] == 9 and ("t12", "t0.f") not in got and got["r3", "t0.f"] == 7


def test_cyclic_bases_raise(spark):
    m = spark.createDataFrame([("a", "a.f", "public", "function", "f", "()", "normal")], "parent_id string, child_id string, access string, kind string, name string, signature string, func_class string")
    for cycle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "a"), ("a", "c"), ("d", "c")]):
        e = spark.createDataFrame([(d, b, "public") for d, b in cycle], "derived_id string, base_id string, access string")
        with pytest.raises(RuntimeError, match="cyclic|rounds"):
            inherit.base_members(e, m)


def test_public_members_of_a_base_come_first(spark):
    m = spark.createDataFrame(
        [("t", "t.f", "public", "function", "f", "()", "normal"), ("b", "b.f", "protected", "function", "f", "()", "normal")],
        "parent_id string, child_id string, access string, kind string, name string, signature string, func_class string",
    )
    e = spark.createDataFrame([("b", "t", "public"), ("d", "b", "protected")], "derived_id string, base_id string, access string")
    assert rows(inherit.base_members(e, m), "derived_id", "child_id", "access") == [("b", "t.f", "public"), ("d", "t.f", "protected")]


def test_alias_cycles_resolve_to_null(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (5, 4)], "id long, target_id long")
    assert rows(resolve.resolve_aliases(a, max_rounds=4)) == [(1, 9), (2, 9), (3, 9), (4, None), (5, None)]


def test_first_and_last_wins(spark):
    u = spark.createDataFrame([("x", 2, "b", "q", True, 1), ("x", 1, "", "p", False, 0), ("x", 3, "c", "", False, 2)], "id string, seq int, first string, last string, flag boolean, mode int")
    assert rows(merge.merge_symbols(u, "seq", ["first"], ["last"], ["flag"], "mode")) == [("x", "b", "q", True, 0)]


def test_params_extend(spark):
    p = spark.createDataFrame([("f", 1, 0, "", "int"), ("f", 2, 0, "a", "int"), ("f", 2, 1, "b", None)], "id string, seq int, pos int, name string, type string")
    assert rows(merge.merge_params(p, "seq", ["name", "type"])) == [("f", 0, "a", "int"), ("f", 1, "b", None)]


def test_shadowed_and_special_members_are_not_inherited(spark):
    m = spark.createDataFrame(
        [("b", "b.f", "public", "function", "f", "()", "normal"), ("b", "b.g", "public", "function", "g", "(int)", "normal"), ("b", "b.c", "public", "function", "b", "()", "constructor"), ("b", "b.p", "private", "variable", "p", "", None), ("d", "d.g", "public", "function", "g", "(int)", "normal")],
        "parent_id string, child_id string, access string, kind string, name string, signature string, func_class string",
    )
    e = lambda access: spark.createDataFrame([("d", "b", access)], "derived_id string, base_id string, access string")
    assert rows(inherit.base_members(e("public"), m), "derived_id", "child_id", "access") == [("d", "b.f", "public")]
    # shadowing is looked for within one access of the derived record
    assert rows(inherit.base_members(e("protected"), m), "derived_id", "child_id", "access") == [("d", "b.f", "protected"), ("d", "b.g", "protected")]
    assert rows(inherit.base_members(e("private"), m)) == []
    assert len(rows(inherit.base_members(e("private"), m, private=True))) == 2


def test_earlier_bases_shadow_later_ones(spark):
    member = lambda rec: (rec, f"{rec}.f", "public", "function", "f", "()", "normal")
    m = spark.createDataFrame([member("top"), member("b"), member("c")], "parent_id string, child_id string, access string, kind string, name string, signature string, func_class string")
    e = spark.createDataFrame([("d", "a", "public", 0), ("d", "b", "public", 1), ("d", "c", "public", 2), ("a", "top", "public", 0)], "derived_id string, base_id string, access string, pos int")
    # the first base has the member from its own base: order goes before depth
    assert rows(inherit.base_members(e, m), "derived_id", "child_id", "depth") == [("a", "top.f", 1), ("d", "top.f", 2)]


def test_inherit_modes(spark):
    i = spark.createDataFrame([("d", "x", "public"), ("d", "y", "public")], "derived_id string, child_id string, access string")
    s = spark.createDataFrame([("d", 0), ("x", 3), ("y", 1)], "id string, extraction int")
    got = {m: rows(inherit.inherit(i, s, m), "child_id", "copied", "extraction") for m in ("reference", "copy-dependencies", "copy-all")}
    assert got == {"reference": [("y", False, 1)], "copy-dependencies": [("x", True, 0), ("y", False, 1)], "copy-all": [("x", True, 0), ("y", True, 1)]}


def test_legible_names(spark):
    s = spark.createDataFrame([("abc1", "f"), ("abd2", "f"), ("zzz3", "f"), ("q", "g")], "id string, raw string").withColumn("parent_id", F.lit("p"))
    assert dict(rows(legible.legible_names(s), "id", "legible")) == {"abc1": "f-0abc", "abd2": "f-0abd", "zzz3": "f-0z", "q": "g"}


def test_member_order(spark):
    cols = "id string, func_class string, operator string, param_count int, first_param_kind string, first_param_symbol string, name string"
    data = [
        ("eq", "normal", "operator==", 1, "lref", "r", "operator=="), ("conv", "conversion", "", 0, None, None, "operator bool"), ("as", "normal", "operator=", 1, "lref", "r", "operator="), ("move", "constructor", "", 1, "rref", "r", "r"),
        ("copy", "constructor", "", 1, "lref", "r", "r"), ("a", "normal", "", 0, None, None, "a"), ("dtor", "destructor", "", 0, None, None, "~r"), ("ctor", "constructor", "", 0, None, None, "r"),
    ]
    df = spark.createDataFrame(data, cols).withColumn("parent_id", F.lit("r")).withColumn("is_template", F.lit(False)).withColumn("targ_count", F.lit(0)).withColumn("tparam_count", F.lit(0)).withColumn("params_text", F.lit(""))
    got = [r["id"] for r in order.number_members(df, order.member_sort_keys(), ["parent_id"]).orderBy("idx").collect()]
    assert got == ["ctor", "copy", "move", "dtor", "as", "a", "conv", "eq"] or got == ["ctor", "copy", "move", "dtor", "as", "a", "eq", "conv"]
    assert got.index("eq") > got.index("a") and got.index("conv") > got.index("a")


def test_function_predicates(spark):
    df = spark.createDataFrame([("constructor", "", 1, "lref", "r", "r"), ("constructor", "", 0, None, None, "r"), ("normal", "operator<<", 2, "lref", "x", "r"), ("normal", "operator=", 1, "rref", "r", "r")], "func_class string, operator string, param_count int, first_param_kind string, first_param_symbol string, parent_id string")
    p = filters.function_predicates()
    got = df.select(*[c.alias(k) for k, c in p.items()]).collect()
    assert [got[0]["is_copy_ctor"], got[1]["is_default_ctor"], got[2]["is_stream_insertion"], got[3]["is_move_assign"], got[2]["is_special"]] == [True, True, True, True, False]


def test_short_paths(spark):
    got = spark.createDataFrame([("/src/inc/a.h",), ("/src/b.h",), ("/usr/c.h",), ("/x/d.h",)], "p string").select(filters.short_path(F.col("p"), "/src", ["/src/inc"], ["/usr"]).alias("s")).collect()
    assert [r["s"] for r in got] == ["a.h", "b.h", "c.h", "/x/d.h"]


def test_alternative_urls(spark):
    s = spark.createDataFrame([("spec", "n", "record", "V", 0, 1), ("prim", "n", "record", "V", 1, 0), ("m", "prim", "function", "m", 0, 0), ("al", "n", "typedef", "A", 0, 0)], "id string, parent_id string, kind string, name string, tparam_count int, targ_count int")
    urls = spark.createDataFrame([("prim", "/V.html")], "id string, url string")
    targets = spark.createDataFrame([("al", "prim")], "id string, target_id string")
    assert rows(filters.alternative_urls(s, urls, targets)) == [("al", "/V.html"), ("m", "/V.html"), ("spec", "/V.html")]


def test_literal_pattern_covers_its_namespace(spark):
    t = tree(spark)
    q = hierarchy.qualified_names(t).select("id", "qualified_name")
    got = {r["id"]: r["extraction"] for r in filters.classify(t.join(q, "id"), filters.SymbolRules(include=["g::i"])).collect()}
    assert got["r"] == 0 and got["f"] == 0 and got["e"] == 3 and got["g"] == 0


def test_no_include_means_regular(spark):
    t = tree(spark)
    q = hierarchy.qualified_names(t).select("id", "qualified_name")
    got = filters.classify(t.join(q, "id"), filters.SymbolRules(exclude=["g::E"])).collect()
    assert {r["id"]: r["extraction"] for r in got} == {"g": 0, "i": 0, "r": 0, "f": 0, "e": 3, "v": 3}


def modes(spark, symbols, **rules):
    t = spark.createDataFrame(symbols, "id string, parent_id string, kind string, name string")
    q = hierarchy.qualified_names(t).select("id", "qualified_name")
    return {r["id"]: r["extraction"] for r in filters.classify(t.join(q, "id"), filters.SymbolRules(**rules)).collect()}


NESTED = [("a", None, "namespace", "a"), ("ab", "a", "namespace", "b"), ("abc", "ab", "record", "c"), ("f", "abc", "function", "f"), ("g", None, "function", "g")]


@pytest.mark.parametrize("rules,want", [
    # what is excluded binds its members before any include does
    (dict(include=["a::**"], exclude=["a::b"]), {"ab": 3, "abc": 3, "f": 3}),
    # implementation-defined is asked before see-below, of the symbol and then of its parent
    (dict(see_below=["a"], implementation_defined=["a::b"]), {"a": 1, "ab": 2, "abc": 2, "f": 2}),
    (dict(see_below=["a::b::c"], implementation_defined=["a::b"]), {"ab": 2, "abc": 2}),
    # members of a see-below namespace are see-below, of such a record dependencies
    (dict(see_below=["a::b"]), {"ab": 1, "abc": 1, "f": 3}),
    # the nearest namespace that a literal pattern names
    (dict(include=["a::b"], see_below=["a"]), {"a": 1, "ab": 1}),
    # namespaces do not take a parent's mode, others do
    (dict(include=["a"]), {"a": 0, "ab": 0, "abc": 0}),
    (dict(include=["?"]), {"a": 0, "ab": 3, "abc": 3, "g": 0}),
    # a namespace that only matches as a prefix takes its children's mode, and gives none
    (dict(include=["a::b::c"]), {"a": 0, "ab": 0, "abc": 0, "f": 0}),
    (dict(include=["a::b::d"]), {"a": 3, "ab": 3, "abc": 3, "f": 3}),
    (dict(include=["a::b::x"], implementation_defined=["a::b::c"]), {"a": 2, "ab": 2, "abc": 2, "f": 2}),
    # members of the global scope are members of something extracted
    (dict(include=["a::b::c"]), {"g": 0}),
])
def test_symbol_modes(spark, rules, want):
    got = modes(spark, NESTED, **rules)
    assert {k: got[k] for k in want} == want


def test_namespace_scopes_do_not_inherit_an_included_parent(spark):
    rows_ = [("n", None, "namespace", "Abc"), ("d", "n", "namespace", "d"), ("r", "d", "record", "R")]
    assert modes(spark, rows_, include=["A*"]) == {"n": 0, "d": 3, "r": 3}


def test_any_file_without_input_directories(spark):
    df = spark.createDataFrame([("/x/a.hpp",), ("/x/a.txt",), (None,)], "p string")
    got = df.select("p", filters.file_filter(F.col("p"), filters.FileRules()).alias("k")).collect()
    assert [r["k"] for r in got] == [True, False, False]


def test_type_rules(spark):
    cols = "access string, is_virtual boolean, is_anonymous boolean, kind string, is_static boolean, is_record_member boolean, is_implicit boolean, full_path string"
    data = [
        ("private", True, False, "function", False, True, True, "a.hpp"), ("private", False, False, "function", False, True, False, "a.hpp"), ("public", False, True, "record", False, False, False, "a.hpp"),
        ("public", False, False, "record", False, False, False, "a.cpp"), ("public", False, False, "function", True, False, False, "a.hpp"), ("public", False, False, "function", True, True, False, "a.hpp"),
    ]
    got = spark.createDataFrame(data, cols).select(filters.type_filter(filters.TypeRules(private_virtual=True, local_classes=False)).alias("k")).collect()
    assert [r["k"] for r in got] == [True, False, False, False, False, True]


def chain(spark, n):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.concat(F.lit("s"), "id").alias("name"), F.lit("namespace").alias("kind"))


def test_deep_chains_are_complete(spark):
    t = chain(spark, 200)
    deepest = hierarchy.qualified_names(t).orderBy(F.desc("depth")).first()
    assert deepest["depth"] == 199 and deepest["qualified_name"].count("::") == 199
    assert hierarchy.ancestors(t).count() == 200 * 201 // 2
    texts = t.select("id", F.when(F.col("id") == 0, "text").alias("text"))
    copied = docs.copy_docs(texts, t.select("id", F.col("parent_id").alias("target_id"))).collect()
    assert {r["id"]: r["depth"] for r in copied} == {k: k for k in range(200)}


def test_cyclic_parents_raise(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(RuntimeError):
        hierarchy.ancestors(t)
    with pytest.raises(RuntimeError):
        core.fixpoint(spark.range(1), lambda f: f, max_iter=3)


def test_roll_up_changes_regular_namespaces_only(spark):
    cols = "id string, parent_id string, kind string, has_doc boolean, extraction int"
    s = spark.createDataFrame([
        ("dep", None, "namespace", False, 3), ("r1", "dep", "record", False, 0), ("see", None, "namespace", False, 1), ("r2", "see", "record", False, 3),
        ("reg", None, "namespace", False, 0), ("r3", "reg", "record", False, 3), ("doc", None, "namespace", True, 0), ("r4", "doc", "record", False, 3),
        ("mix", None, "namespace", False, 0), ("r5", "mix", "record", False, 3), ("r6", "mix", "record", False, 2), ("imp", None, "namespace", False, 0), ("r7", "imp", "record", False, 2),
        ("any", None, "namespace", False, 0), ("r8", "any", "record", False, 1), ("r9", "any", "record", False, 3), ("bare", None, "namespace", False, 0),
    ], cols)
    assert dict(rows(rollup.roll_up_modes(s), "id", "extraction")) == {"dep": 3, "see": 1, "reg": 3, "doc": 0, "mix": 0, "imp": 2, "any": 1, "bare": 0}


def test_documented_is_an_optional_rank(spark):
    cols = "k int, pos int, m_targ_count boolean, m_targs boolean, m_param_count boolean, m_documented boolean, m_params boolean, m_qualifiers boolean, m_noexcept boolean"
    c = spark.createDataFrame([(1, 0, True, True, True, True, False, False, False), (1, 1, True, True, True, False, True, False, False), (2, 0, True, True, True, False, False, False, False), (2, 1, True, True, True, True, False, True, True)], cols)
    assert rows(resolve.best_match(c, ["k"]), "k", "pos", "match_rank") == [(1, 1, 5), (2, 1, 4)]


def test_relates_of_regular_documented_free_functions_only(spark):
    f = spark.createDataFrame(
        [("ok", 0, True, False, "namespace"), ("dep", 3, True, False, "namespace"), ("bare", 0, False, False, "namespace"), ("method", 0, True, True, "namespace"), ("inner", 0, True, False, "record")],
        "id string, extraction int, has_doc boolean, is_record_method boolean, parent_kind string",
    ).withColumns({"first_param_symbol": F.lit("b"), "first_param_kind": F.lit("lref"), "return_symbol": F.lit("hidden"), "return_targ_symbol": F.lit("e")})
    records = spark.createDataFrame([("b", "record", 0), ("d", "record", 0), ("dd", "record", 3), ("hidden", "record", 3), ("e", "enum", 0)], "id string, kind string, extraction int")
    bases = spark.createDataFrame([("d", "b"), ("dd", "b")], "derived_id string, base_id string")
    friends = spark.createDataFrame([("b", "ok")], "record_id string, friend_id string")
    assert rows(relates.auto_relates(f, records, bases, friends)) == [("ok", "d"), ("ok", "e")]


def test_lint_asks_regular_documented_functions_only(spark):
    cols = "id string, kind string, name string, qualified_name string, has_doc boolean, extraction int, is_deleted boolean, return_type string, full_path string, line int, col int"
    s = spark.createDataFrame([(i, "function", "f", "n::f", doc, mode, gone, "int", "p", 1, 1) for i, doc, mode, gone in (("ok", True, 0, False), ("dep", True, 3, False), ("bare", False, 1, False), ("gone", True, 0, True))], cols)
    p = spark.createDataFrame([(i, 0, "a") for i in ("ok", "dep", "bare", "gone")] + [("gone", 1, "")], "func_id string, pos int, name string")
    d = spark.createDataFrame([(i, "b") for i in ("ok", "dep", "bare", "gone")], "func_id string, name string")
    none = spark.createDataFrame([], "func_id string"), spark.createDataFrame([], "symbol_id string, literal string, target_id string")
    got = rows(lint.lint(s, p, d, *none), "rule", "message")
    assert got == [
        ("missing-param", "n::f: Missing documentation for parameter 'a'"), ("missing-return", "n::f: Missing documentation for return value"),
        ("unknown-param", "n::f: Documented parameter 'b' does not exist"), ("unknown-param", "n::f: Documented parameter 'b' does not exist"), ("unnamed-param", "n::f: 2nd parameter is unnamed"),
    ]


def test_returns_of_a_brief_keep_their_text(spark):
    got = spark.createDataFrame([("Returns the size",), ("Get it",), ("Returnsx",), ("A thing",)], "b string").select(docs.returns_from_brief(F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == ["the size", "it", None, None]


def test_doc_commands(spark):
    text = "Intro line\n@brief The  brief.\n@param[in,out] a, b Both\n@param c\n@throws std::error when bad\n@returns it\n"
    got = rows(docs.doc_commands(spark.createDataFrame([(1, text)], "id int, body string"), ["id"]), "section", "argument", "direction", "literal")
    assert ("paragraph", None, None, "Intro line") in got and ("brief", None, None, "The brief.") in got and ("params", "a, b", "inout", "Both") in got and ("exceptions", "std::error", None, "when bad") in got
    names = rows(docs.param_rows(docs.doc_commands(spark.createDataFrame([(1, text)], "id int, body string"), ["id"]), ["id"]), "name")
    assert names == [("a",), ("b",), ("c",)]


def test_comments_of_a_source(spark):
    src = "/** One\n * two */\nint a;\n/// three\n/// four\nint b; // no\n"
    got = rows(docs.comment_texts(spark.createDataFrame([("f", src)], "path string, text string")), "pos", "body")
    assert [b.split() for _, b in got] == [["One", "two"], ["three", "four"]]


@pytest.mark.parametrize("text,want", [
    ("a **b** c", [("strong", "b")]), ("a *b* c", [("emph", "b")]), ("x_y_z", []), ("_a_", [("emph-underline", "a")]), ("`co de`", [("code", "co de")]), ("~~s~~ ==m==", [("mark", "m"), ("strike", "s")]), ("* a * b", []), ("$x$", [("inline-math", "x")]),
])
def test_spans(spark, text, want):
    got = docs.inline_spans(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t")
    assert rows(got, "kind", "literal") == want


def test_links_and_images(spark):
    got = docs.inline_spans(spark.createDataFrame([(1, "[a](u) ![i](v)")], "id int, t string"), ["id"], "t").where("kind in ('link', 'image')")
    assert rows(got, "kind", "literal", "href") == [("image", "i", "v"), ("link", "a", "u")]


def test_copy_cycles_resolve_to_nothing(spark):
    d = spark.createDataFrame([("a", "text"), ("b", None), ("c", None), ("d", None)], "id string, text string")
    c = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "c")], "id string, target_id string")
    assert rows(docs.copy_docs(d, c), "id", "source", "depth") == [("a", "a", 0), ("b", "a", 1)]


def test_related_order(spark):
    df = spark.createDataFrame([("b::c", 1), ("z", 2), ("a::b::c", 3), ("a", 4)], "t string, id int")
    assert [r["t"] for r in df.orderBy(*order.related_order(F.col("t"), F.col("id"))).collect()] == ["a", "z", "b::c", "a::b::c"]


def test_relates_of_non_functions_are_reported(spark):
    rel = spark.createDataFrame([("f", "r", "R"), ("v", "r", "R"), ("f", "r", "R"), ("f", None, "X")], "symbol_id string, target_id string, literal string")
    s = spark.createDataFrame([("f", "function", "f"), ("v", "variable", "v")], "id string, kind string, name string")
    back, bad = relates.related_back_edges(rel, s)
    assert rows(back) == [("r", "f", "f")] and rows(bad) == [("v", "R")]


def test_report_caret_follows_tabs(spark):
    w = spark.createDataFrame([("f", 1, 2, "m")], "full_path string, line int, col int, message string")
    files = spark.createDataFrame([("f", "\tab")], "path string, text string")
    got = lambda files, w=w: lint.warning_report(w, files).first()["text"]
    head = "f:1:2:\n    1) m\n"
    assert got(files.withColumn("text", F.lit("\tab\n"))) == head + "  1 |         ab\n    |         ^~\n"
    assert got(files) == head  # the last line is not shown
    assert got(files.withColumn("text", F.lit("x\r\n"))) == head + "  1 | x\n    | "  # no caret beyond the line
    assert got(files.withColumn("text", F.lit("xy\tz\n")), w.withColumn("col", F.lit(4))).endswith("  1 | xy      z\n    | ")
    assert got(files.withColumn("text", F.lit("a\tbcd\n")), w.withColumn("col", F.lit(3))) == "f:1:3:\n    1) m\n  1 | a       bcd\n    |          ^~\n"


def test_messages_of_a_place_keep_their_order(spark):
    w = spark.createDataFrame([("f", 1, 2, "b", 0), ("f", 1, 2, "a", 1), ("f", 1, 2, "b", 2)], "full_path string, line int, col int, message string, seq int")
    assert lint.grouped_warnings(w).first()["messages"] == ["1) b", "2) a", "3) b"]


def test_source_lines_of_warnings(spark):
    files = spark.createDataFrame([("f", "a\r\nb\nc"), ("g", "x")], "path string, text string")
    w = spark.createDataFrame([("f", 2), ("f", 2), ("f", 9), ("g", 1), ("h", 1)], "full_path string, line int")
    assert rows(lint.with_source_line(w, files), "full_path", "line", "source", "n_lines") == [("f", 2, "b", 3), ("f", 2, "b", 3), ("f", 9, None, 3), ("g", 1, "x", 1), ("h", 1, None, None)]


def test_ordinals(spark):
    got = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 11, 12, 13, 21, 112)], "n int").select(lint.ordinal(F.col("n")).alias("o")).collect()
    assert [r["o"] for r in got] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21th", "112th"]


def test_overload_briefs(spark):
    b = spark.createDataFrame([("s", "x", "normal", None, "f"), ("s", "x", "normal", None, "f"), ("t", "x", "normal", "Equality", "g"), ("t", "y", "normal", "Equality", "g")], "set_id string, brief string, func_class string, readable_name string, name string")
    assert rows(overloads.consensus_brief(b)) == [("s", "x"), ("t", "Equality operators")]
    cols = "set_id string, brief string, func_class string, readable_name string, name string"
    part = spark.createDataFrame([("one", "x", "normal", None, "f"), ("one", None, "normal", None, "f"), ("none", None, "normal", None, "g"), ("none", "", "normal", None, "g"), ("two", "x", "normal", None, "h"), ("two", "y", "normal", None, "h"), ("c", None, "constructor", None, "c")], cols)
    assert rows(overloads.consensus_brief(part)) == [("c", "Constructors"), ("none", None), ("one", "x"), ("two", "h overloads")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, parent_id string, kind string, name string")
    assert hierarchy.qualified_names(none).count() == 0 and hierarchy.ancestors(none).count() == 0


def test_equal_member_sets(spark):
    own = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("d", None), ("e", None)], "set_id string, member int")
    assert rows(overloads.equivalent_sets(own, own)) == [("b", "a")]


def test_sets_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 1)], "set_id string, member int")
    blind = lambda m, *_: m.select("set_id").distinct().withColumns({"n": F.lit(1).cast("long"), "f1": F.lit(0), "f2": F.lit(0)})
    monkeypatch.setattr(overloads, "set_fingerprints", blind)
    assert rows(overloads.equivalent_sets(members, members)) == [("b", "c"), ("c", "b"), ("d", "a")]


def test_ranks_of_a_hot_group_equal_one_window(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 3001).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), "id")
    keys = [F.col("v") % 10, F.col("k"), F.col("id")]
    one = lambda hot: rows(order.number_members(df, keys, ["g"], hot=hot), "g", "id", "idx")
    assert one(10_000) == one(1500) == one(10)


def test_param_rules_deal_rows_over_counted_partitions(spark, monkeypatch):
    monkeypatch.setattr(core, "SPREAD_ROWS", 5)
    p = spark.createDataFrame([(k, f"p{k % 3}") for k in range(60)] + [(None, "p"), (7, None), (8, "")], "func_id long, name string")
    d = spark.createDataFrame([(None, "p"), (7, None), (1, "p1"), (1, "p1"), (2, "x")], "func_id long, name string")
    both = lint.documented_params(p, d)
    assert both.rdd.getNumPartitions() >= 13
    assert rows(lint.unknown_params(p, d)) == [(2, "x")]  # nulls are equal, as for EXCEPT
    missing = rows(lint.missing_params(p, d))
    assert len(missing) == 59 and (1, "p1") not in missing and not any(r[0] is None for r in missing)
    assert sorted(rows(lint.param_faults(p, d))) == sorted([("missing", *r) for r in missing] + [("unknown", 2, "x")])
    complete = dict(rows(lint.complete_params(p, d)))
    assert complete[1] and not complete[2] and not complete[None] and 8 in complete
