"""Expected values of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tomeflow.functions import collections as C
from tomeflow.functions import logic as L
from tomeflow.functions import names as N
from tomeflow.functions import paths as P
from tomeflow.functions import strings as S

lit = F.lit

STRINGS = [
    (lambda: S.capitalize(lit("hello world")), "Hello world"), (lambda: S.capitalize(lit("")), ""), (lambda: S.center(lit("hello"), 10, "*"), "**hello**"), (lambda: S.ljust(lit("ab"), 5, "xy"), "abxyx"),
    (lambda: S.rjust(lit("ab"), 5), "   ab"), (lambda: S.ljust(lit("hello"), 2), "hello"), (lambda: S.count(lit("aaaa"), "aa"), 3), (lambda: S.count(lit("banana"), "a", 2), 2), (lambda: S.starts_with(lit("hello"), "el", 1), True),
    (lambda: S.ends_with(lit("hello"), "ell", 0, 4), True), (lambda: S.expandtabs(lit("a\tb"), 3), "a   b"), (lambda: S.tab_stops(lit("a\tb\tc"), 4), "a   b   c"), (lambda: S.find(lit("hello"), "l"), 2), (lambda: S.find(lit("hello"), "z"), -1),
    (lambda: S.find(lit("hello"), "l", 3), 3), (lambda: S.rfind(lit("hello"), "l", 4), 3), (lambda: S.rfind(lit("hello"), "l"), -1), (lambda: S.rfind(lit("hello"), "h"), 0), (lambda: S.includes(lit("hello"), "ell"), True),
    (lambda: S.char_at(lit("hello"), -1), "o"), (lambda: S.char_at(lit("hello"), 1), "e"), (lambda: S.is_alnum(lit("a1")), True), (lambda: S.is_alpha(lit("a1")), False), (lambda: S.is_ascii(lit("é")), False), (lambda: S.is_digit(lit("12")), True),
    (lambda: S.is_lower(lit("ab")), True), (lambda: S.is_upper(lit("AB")), True), (lambda: S.is_space(lit(" \t")), True), (lambda: S.is_printable(lit("a\n")), False), (lambda: S.is_title(lit("Hello World")), True), (lambda: S.is_title(lit("Hello world")), False),
    (lambda: S.swap_case(lit("aBc")), "AbC"), (lambda: S.join("-", F.array(lit(""), lit("a"), lit("b"))), "a-b"), (lambda: S.strip(lit(" x\n")), "x"), (lambda: S.lstrip(lit("xxa"), "x"), "a"), (lambda: S.rstrip(lit("axx"), "x"), "a"),
    (lambda: S.partition(lit("a-b-c"), "-"), ["a", "-", "b-c"]), (lambda: S.partition(lit("abc"), "-"), ["abc", "", ""]), (lambda: S.rpartition(lit("a-b-c"), "-"), ["a-b", "-", "c"]), (lambda: S.rpartition(lit("abc"), "-"), ["", "", "abc"]),
    (lambda: S.remove_prefix(lit("abc"), "ab"), "c"), (lambda: S.remove_suffix(lit("abc"), "bc"), "a"), (lambda: S.replace(lit("a.a.a"), ".", "-"), "a-a-a"), (lambda: S.replace(lit("a.b.c.d"), ".", "-", 2), "a-b-"),
    (lambda: S.split(lit("a.b.c"), "."), ["a", "b", "c"]), (lambda: S.split(lit("a.b.c"), ".", 2), ["a", "b"]), (lambda: S.rsplit(lit("a.b.c"), ".", 2), ["c", "b"]), (lambda: S.split_lines(lit("a\r\nb\n")), ["a", "", "b"]),
    (lambda: S.split_lines(lit("a\nb"), True), ["a\n", "b"]), (lambda: S.zfill(lit("-42"), 6), "-00042"), (lambda: S.zfill(lit("42"), 1), "42"), (lambda: S.repeat(lit("ab"), -1), ""), (lambda: S.escape(lit("<a href=\"x\">'&`")), "&lt;a href&#x3D;&quot;x&quot;&gt;&#x27;&amp;&#x60;"),
    (lambda: S.escape_asciidoc(lit("a~b_c")), "a&#126;b&lowbar;c"), (lambda: S.slice_(lit("hello"), 1, 3), "el"), (lambda: S.slice_(lit("hello"), -3), "llo"), (lambda: S.slice_(lit("hello"), 3, 1), ""), (lambda: S.safe_anchor_id(lit("A b_c::D")), "a-b-cd"),
    (lambda: S.strip_namespace(lit("a::b<c::d>")), "b<c::d>"), (lambda: S.strip_namespace(lit("f(a::b)")), "f(a::b)"), (lambda: S.detag(lit("<b>x</b>y<")), "xy"), (lambda: S.kebab_case(lit("helloWorld fooBar")), "hello-world-foo-bar"),
    (lambda: S.snake_case(lit("HelloWorld")), "hello_world"), (lambda: S.pascal_case(lit("hello_world")), "HelloWorld"), (lambda: S.camel_case(lit("hello-world")), "helloWorld"), (lambda: S.reindent(lit("    a\n      b\n"), 2), "  a\n    b\n"),
    (lambda: S.collapse_whitespace(lit("a  b\tc")), "a b c"), (lambda: S.collapse_whitespace(lit("a\tb")), "a\tb"), (lambda: S.base64_id(lit("00FF")), "AP8="), (lambda: S.base16(lit("00ff")), "00FF"),
]
PATHS = [
    (lambda: P.parent_dir(lit("/a/b/c.txt")), "/a/b/"), (lambda: P.parent_dir(lit("/a/b/")), "/a/"), (lambda: P.file_name(lit("/a/b.txt")), "b.txt"), (lambda: P.with_extension(lit("/a.b/c.txt"), "md"), "/a.b/c.md"), (lambda: P.extension(lit("/a.b/c.txt")), ".txt"),
    (lambda: P.append(lit("/a/"), lit("b")), "/a/b"), (lambda: P.append(lit("/a"), lit("/b")), "/b"), (lambda: P.absolute(lit("x"), lit("/r")), "/r/x"), (lambda: P.posix_style(lit("a\\b")), "a/b"), (lambda: P.make_dirsy(lit("/a")), "/a/"),
    (lambda: P.has_prefix(lit("/ab/c"), lit("/a")), False), (lambda: P.has_prefix(lit("/a/c"), lit("/a")), True), (lambda: P.normalize(lit("/a/./b/../c")), "/a/c"), (lambda: P.normalize(lit("../a/../b")), "../b"), (lambda: P.normalize(lit("/..")), "/"),
    (lambda: P.relativize(lit("/a/b.html"), lit("/a/c.html")), "./b.html"), (lambda: P.relativize(lit("/a/b.html#x"), lit("/d/c.html")), "../a/b.html#x"), (lambda: P.relativize(lit("/a/b.html#x"), lit("/a/b.html")), "#x"),
    (lambda: P.relativize(lit("/a/b.html"), lit("/a/b.html")), "b.html"), (lambda: P.relativize(lit("/a/"), lit("/a/")), "./"), (lambda: P.relativize(lit(""), lit("/a")), "#"), (lambda: P.relativize(lit("x"), lit("/a")), "x"), (lambda: P.depth_prefix(lit("/a/b/c.html")), "../../"),
]
ARRAYS = [
    (lambda: C.range_(3), [0, 1, 2]), (lambda: C.range_(5, 1, -2), [5, 3]), (lambda: C.range_(3, 3), []), (lambda: C.index_of(F.array(lit(1), lit(2)), lit(2)), 1), (lambda: C.get(F.array(lit(1), lit(2)), -1), 2), (lambda: C.first(F.array().cast("array<int>")), None),
    (lambda: C.update(F.array(lit(1), lit(2)), F.array(lit(2), lit(3))), [1, 2, 3]), (lambda: C.fill(F.array(lit(1), lit(2), lit(3)), lit(9), 1), [1, 9, 9]), (lambda: C.chunk(F.array(lit(1), lit(2), lit(3)), 2), [[1, 2], [3]]),
    (lambda: C.chunk_text(lit("abcde"), 2), ["ab", "cd", "e"]), (lambda: C.unique(F.array(lit(2), lit(1), lit(2))), [1, 2]), (lambda: C.delete(F.array(lit("a"), lit("b")), "a"), ["b"]), (lambda: C.replace(F.array(lit(1), lit(2)), lit(1), lit(5)), [5, 2]),
    (lambda: C.key_of(F.create_map(lit("a"), lit(1), lit("b"), lit(2)), lit(2)), "b"), (lambda: F.map_keys(C.update_map(F.create_map(lit("a"), lit(1)), F.create_map(lit("a"), lit(2)))), ["a"]), (lambda: C.get_key(F.create_map(lit("a"), lit(1)), "z", lit(7)), 7),
    (lambda: F.map_keys(C.delete_key(F.create_map(lit("a"), lit(1), lit("b"), lit(2)), "a")), ["b"]), (lambda: C.each(F.array(lit("x"), lit("y")), lambda x, k, last: F.concat(x, F.when(last, ".").otherwise(","))), "x,y."),
    (lambda: C.each(F.array().cast("array<string>"), lambda x, k, last: x, "none"), "none"), (lambda: C.has(F.array(lit(1)), lit(2)), False),
]
LOGIC = [
    (lambda: L.truthy(lit(0), "int"), False), (lambda: L.truthy(lit(""), "string"), False), (lambda: L.truthy(F.array(), "array<int>"), True), (lambda: L.empty(F.array().cast("array<int>"), "array<int>"), True), (lambda: L.empty(lit(0), "int"), False),
    (lambda: L.and_(lit(True), lit(False)), False), (lambda: L.or_(lit(""), lit("b")), "b"), (lambda: L.not_(lit(True), lit(False)), True), (lambda: L.not_(lit(True), lit(True)), False), (lambda: L.eq(lit(1), lit(1), lit(1)), True),
    (lambda: L.ne(lit(1), lit(2)), True), (lambda: L.select(lit(None).cast("boolean"), lit(1), lit(2)), 2), (lambda: L.increment(lit(None).cast("int")), 1), (lambda: L.add(lit(1), lit(2), lit(3)), 6), (lambda: L.sub(lit(5), lit(2), lit(1)), 2),
    (lambda: L.mul(lit(2), lit(3)), 6), (lambda: L.div(lit(-7), lit(2)), -3), (lambda: L.div(lit(1), lit(0)), None), (lambda: L.plus(lit("a"), lit(1), "string", "int"), "a1"), (lambda: L.plus(lit(1), lit(2), "int", "int"), 3), (lambda: L.compare(lit(1), lit(2)), -1),
]


@pytest.mark.parametrize("family", ["STRINGS", "PATHS", "ARRAYS", "LOGIC"])
def test_values(spark, family):
    cases = globals()[family]
    got = spark.range(1).select(*[make().alias(f"c{k}") for k, (make, _) in enumerate(cases)]).first()
    wrong = {k: (got[k], want) for k, (_, want) in enumerate(cases) if got[k] != want}
    assert not wrong


def test_nulls_stay_null(spark):
    x = lit(None).cast("string")
    makers = [S.capitalize, S.upper, S.detag, S.escape, S.kebab_case, S.collapse_whitespace, S.safe_anchor_id, P.file_name, P.normalize]
    assert all(v is None for v in spark.range(1).select(*[m(x).alias(m.__name__) for m in makers]).first())


def test_struct_arrays(spark):
    df = spark.createDataFrame([([("b", 1, [1]), (None, 2, [1, 2]), ("a", 3, None)],)], "xs array<struct<k:string,v:int,in:array<int>>>")
    row = df.select(
        C.pluck(C.sort_by("xs", "k"), "v").alias("sorted"), C.pluck(C.filter_by("xs", "k"), "v").alias("kept"), C.flatten("xs", "in").alias("flat"), F.map_keys(C.group_by("xs", "k")).alias("keys"), C.any_of_by("xs", "k").alias("any"),
    ).first()
    assert (row["sorted"], row["kept"], row["flat"], row["keys"], row["any"]) == ([2, 3, 1], [1, 3], [1, 1, 2], ["b", "a"], True)


def test_flatten_unique(spark):
    df = spark.createDataFrame([([([("a", 1), ("b", 2)],), ([("a", 3)],)],)], "xs array<struct<in:array<struct<id:string,v:int>>>>")
    assert [r["v"] for r in df.select(C.flatten_unique("xs", "in", "id").alias("u")).first()["u"]] == [1, 2]


def test_kinds_and_year(spark):
    t = spark.range(1).schema["id"].dataType
    assert L.kind_of(t) == "number"
    row = spark.range(1).select(L.is_kind(F.col("id"), t, "number").alias("a"), L.year().alias("y"), N.enum_name(lit(1), N.EXTRACTION).alias("e")).first()
    assert row["a"] and row["y"] == datetime.date.today().year and row["e"] == "see-below"
