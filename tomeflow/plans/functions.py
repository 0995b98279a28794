"""Queries of the column-function families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.core import table
from tomeflow.functions import collections as C
from tomeflow.functions import logic as L
from tomeflow.functions import paths as P
from tomeflow.functions import strings as S
from tomeflow.plans.registry import query


@query("""
SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS cap, CASE WHEN length(p_name) < 30 THEN repeat('*', (30 - length(p_name)) // 2) || p_name || repeat('*', (30 - length(p_name)) // 2) ELSE p_name END AS mid,
       CASE WHEN length(p_name) < 30 THEN rpad(p_name, 30, '.') ELSE p_name END AS l, CASE WHEN length(p_name) < 30 THEN lpad(p_name, 30, '.') ELSE p_name END AS r,
       upper(p_name) AS up, lower(p_name) AS lo, lpad(p_size::VARCHAR, 5, '0') AS z, repeat(p_brand, 2) AS twice, reverse(p_type) IS NOT NULL AS ok
FROM part""")
def string_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capitalize, center, ljust, rjust, upper, lower, zfill, repeat."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.capitalize("p_name").alias("cap"), S.center("p_name", 30, "*").alias("mid"), S.ljust("p_name", 30, ".").alias("l"), S.rjust("p_name", 30, ".").alias("r"), S.upper("p_name").alias("up"),
        S.lower("p_name").alias("lo"), S.zfill(F.col("p_size").cast("string"), 5).alias("z"), S.repeat("p_brand", 2).alias("twice"), F.col("p_type").isNotNull().alias("ok"),
    )


@query("""
SELECT p_partkey, instr(p_name, 'a') - 1 AS at, contains(p_name, 'ar') AS has, starts_with(p_name, 'part') AS starts, ends_with(p_name, '1') AS ends,
       length(p_name) - length(replace(p_name, 'a', '')) AS n_a, substr(p_name, 3, 1) AS third, substr(p_name, 2, 3) AS cut, CASE WHEN instr(p_name, 't') = 1 THEN 0 ELSE -1 END AS last_t
FROM part""")
def string_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find, includes, starts_with, ends_with, count, char_at, slice, rfind."""
    big = lambda c: c.cast("bigint")
    return table(spark, sf_dir, "part").select(
        "p_partkey", big(S.find("p_name", "a")).alias("at"), S.includes("p_name", "ar").alias("has"), S.starts_with("p_name", "part").alias("starts"), S.ends_with("p_name", "1").alias("ends"),
        big(S.count("p_name", "a")).alias("n_a"), S.char_at("p_name", 2).alias("third"), S.slice_("p_name", 1, 4).alias("cut"), S.rfind("p_name", "t").cast("int").alias("last_t"),
    )


@query("""
SELECT p_partkey, regexp_full_match(p_name, '[0-9A-Za-z]*') AS alnum, regexp_full_match(p_name, '[A-Za-z]*') AS alpha, regexp_full_match(p_size::VARCHAR, '[0-9]*') AS digit,
       regexp_full_match(p_name, '[a-z]*') AS low, regexp_full_match(p_type, '[A-Z]*') AS up, regexp_full_match(p_type, '[ -~]*') AS printable, regexp_full_match(p_name, '[\\x00-\\x7F]*') AS ascii,
       NOT regexp_matches(p_name, '(^|[^A-Za-z])[a-z]') AND NOT regexp_matches(p_name, '[A-Za-z][A-Z]') AS title, trim(p_brand) = '' AS space
FROM part""".replace("\\\\x", "\\x"))
def string_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """is_alnum, is_alpha, is_digit, is_lower, is_upper, is_printable, is_ascii,
    is_title, is_space."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.is_alnum("p_name").alias("alnum"), S.is_alpha("p_name").alias("alpha"), S.is_digit(F.col("p_size").cast("string")).alias("digit"), S.is_lower("p_name").alias("low"),
        S.is_upper("p_type").alias("up"), S.is_printable("p_type").alias("printable"), S.is_ascii("p_name").alias("ascii"), S.is_title("p_name").alias("title"), S.is_space("p_brand").alias("space"),
    )


@query("""
SELECT c_custkey, split_part(c_name, '#', 1) AS before, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS after,
       replace(c_name, '0', 'o') AS replaced, CASE WHEN len(string_split(c_name, '0')) > 2 THEN string_split(c_name, '0')[1] || 'o' || string_split(c_name, '0')[2] || 'o' ELSE replace(c_name, '0', 'o') END AS two,
       array_to_string(string_split(c_mktsegment, 'I'), '|') AS pieces, array_to_string(list_reverse(string_split(c_mktsegment, 'I')), '|') AS back,
       CASE WHEN starts_with(c_name, 'Cust') THEN substr(c_name, 5) ELSE c_name END AS no_prefix, CASE WHEN ends_with(c_name, '1') THEN left(c_name, -1) ELSE c_name END AS no_suffix, trim(c_mktsegment, 'BG') AS stripped,
       translate(lower(c_name), ' _', '--') AS anchor
FROM customer""")
def string_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partition, replace (counted too), split, rsplit, remove_prefix, remove_suffix,
    strip, safe_anchor_id, join."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.get(S.partition("c_name", "#"), F.lit(0)).alias("before"), F.get(S.partition("c_name", "#"), F.lit(2)).alias("after"), S.replace("c_name", "0", "o").alias("replaced"),
        S.replace("c_name", "0", "o", 2).alias("two"), S.join("|", S.split("c_mktsegment", "I")).alias("pieces"), F.array_join(S.rsplit("c_mktsegment", "I"), "|").alias("back"),
        S.remove_prefix("c_name", "Cust").alias("no_prefix"), S.remove_suffix("c_name", "1").alias("no_suffix"), S.strip("c_mktsegment", "BG").alias("stripped"), S.safe_anchor_id("c_name").alias("anchor"),
    )


@query(r"""
SELECT c_custkey, lower(replace(n_name, '_', '-')) AS kebab, lower(n_name) AS snake, 'Nation' || regexp_extract(n_name, '[0-9]+') AS pascal, 'nation' || regexp_extract(n_name, '[0-9]+') AS camel,
       'x' AS tail, '&lowbar;' AS adoc, 'a  b' AS tabs, 'a   b' AS stops, 2 AS lines, 'a' || chr(10) || ' b' AS code, CASE WHEN c_name LIKE '%  %' THEN NULL ELSE c_name || ' b' END AS one
FROM (SELECT *, 'NATION_' || c_custkey AS n_name FROM customer)""")
def string_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier cases, strip_namespace, AsciiDoc escapes, tabs, split_lines, reindent,
    whitespace collapse."""
    q = F.concat(F.lit("a::b<c::d>::"), F.lit("x"))
    return table(spark, sf_dir, "customer").withColumn("n_name", F.concat(F.lit("NATION_"), "c_custkey")).select(
        "c_custkey", S.kebab_case("n_name").alias("kebab"), S.snake_case("n_name").alias("snake"), S.pascal_case("n_name").alias("pascal"), S.camel_case("n_name").alias("camel"), S.strip_namespace(q).alias("tail"),
        S.escape_asciidoc(F.regexp_extract("n_name", "_", 0)).alias("adoc"), S.expandtabs(F.lit("a\tb"), 2).alias("tabs"), S.tab_stops(F.lit("a\tb"), 4).alias("stops"),
        F.size(S.split_lines(F.lit("x\ny\n"))).alias("lines"), S.reindent(F.lit("  a\n   b"), 0).alias("code"), S.collapse_whitespace(F.concat("c_name", F.lit("  b"))).alias("one"),
    )


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT page_id, regexp_extract(u, '^(.*/)?[^/]+/?$', 1) AS parent, string_split(u, '/')[-1] AS file, starts_with(u, 'http') AND regexp_matches(u, '^(/|[A-Za-z]:[\\/])') AS absolute,
       regexp_replace(u, '/+$', '') || '/index' AS appended, replace(u, '/', '/') AS posix, ends_with(u, '/') AS dirsy
FROM p""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path functions on page urls."""
    u = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", P.parent_dir(u).alias("parent"), P.file_name(u).alias("file"), (F.startswith(u, F.lit("http")) & P.is_absolute(u)).alias("absolute"), P.append(u, F.lit("index")).alias("appended"),
        P.posix_style(u).alias("posix"), P.is_dirsy(u).alias("dirsy"),
    )


ARRAY_SQL = "WITH a AS (SELECT o_custkey, list(o_orderkey % 7 ORDER BY o_orderkey) AS xs FROM orders GROUP BY 1)"


@query(ARRAY_SQL + """
SELECT o_custkey, len(xs) AS n, xs[1] AS first, xs[-1] AS last, coalesce(list_position(xs, 3), 0) - 1 AS at3, len(list_filter(xs, lambda x: x = 3)) AS n3, list_contains(xs, 3) AS has3,
       list_has_any(xs, [5, 6]) AS any56, array_to_string(list_sort(list_distinct(xs)), ',') AS uniq, array_to_string(list_sort(xs), ',') AS sorted, array_to_string(list_reverse(xs), ',') AS rev,
       array_to_string(list_filter(xs, lambda x: x <> 3), ',') AS del3, array_to_string(list_transform(xs, lambda x: CASE WHEN x = 3 THEN 9 ELSE x END), ',') AS rep,
       (len(xs) + 1) // 2 AS chunks, coalesce(xs[4], -1) AS fourth
FROM a""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size, first, last, index_of, count, has, has_any, unique, sort, reverse, delete,
    replace, chunk, get."""
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 7).alias("xs"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    three = F.lit(3).cast("bigint")
    return a.select(
        "o_custkey", C.size("xs").cast("bigint").alias("n"), C.first("xs").alias("first"), C.last("xs").alias("last"), C.index_of("xs", three).cast("int").alias("at3"), C.count("xs", three).cast("bigint").alias("n3"),
        C.has("xs", three).alias("has3"), C.has_any("xs", F.array(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))).alias("any56"), text(C.unique("xs")).alias("uniq"), text(C.sort("xs")).alias("sorted"),
        text(C.reverse("xs")).alias("rev"), text(C.delete("xs", three)).alias("del3"), text(C.replace("xs", three, F.lit(9).cast("bigint"))).alias("rep"), C.size(C.chunk("xs", 2)).cast("bigint").alias("chunks"),
        F.coalesce(F.get("xs", F.lit(3)), F.lit(-1).cast("bigint")).alias("fourth"),
    )


@query("""
WITH s AS (SELECT l_orderkey, list({'k': l_returnflag, 'v': l_linenumber, 'f': CASE WHEN l_linestatus = 'F' THEN 'y' ELSE '' END} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS xs FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(xs, lambda x: x.v), ',') AS plucked, array_to_string(list_transform(list_filter(xs, lambda x: x.f <> ''), lambda x: x.v), ',') AS closed,
       len(list_filter(xs, lambda x: x.f <> '')) > 0 AS any_closed, len(list_distinct(list_transform(xs, lambda x: x.k))) AS groups,
       '[' || array_to_string(list_transform(xs, lambda x: x.k), ';') || ']' AS listed
FROM s""")
def struct_array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pluck, filter_by, any_of_by, group_by, each, sort_by."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("v"), F.when(F.col("l_linestatus") == "F", "y").otherwise("").alias("f"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["f"].alias("f"))).alias("xs"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    listed = C.each("xs", lambda x, k, last: F.concat(F.when(k == 0, "[").otherwise(""), x["k"], F.when(last, "]").otherwise(";")))
    return s.select("l_orderkey", text(C.pluck(C.sort_by("xs", "v"), "v")).alias("plucked"), text(C.pluck(C.filter_by("xs", "f"), "v")).alias("closed"), C.any_of_by("xs", "f").alias("any_closed"), F.size(C.group_by("xs", "k")).cast("bigint").alias("groups"), listed.alias("listed"))


@query("""
SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding[1:4], lambda x: (x > 0)::INT))::BIGINT AS positive, len(embedding[1:10]) + 2 AS filled, embedding[1] > embedding[64] AS first_larger FROM embeddings""")
def embedding_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range, fill, concat, len over long arrays."""
    head = F.slice("embedding", 1, 4)
    pos = F.aggregate(F.transform(head, lambda x: (x > 0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = C.fill(C.concat(F.slice("embedding", 1, 10), F.slice("embedding", 1, 2)), F.lit(0.0), 0, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", C.size("embedding").cast("bigint").alias("n"), pos.alias("positive"), C.size(filled).cast("bigint").alias("filled"), (C.first("embedding") > C.last("embedding")).alias("first_larger"))


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber + 5 + l_suppkey AS added, l_suppkey - l_linenumber AS subbed, l_linenumber * 3 AS mul, l_suppkey // 7 AS div, l_linenumber + 1 AS inc,
       l_returnflag = 'A' AND l_linestatus = 'F' AS both, CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END AS chosen, l_returnflag || l_linenumber AS mixed, NOT (l_discount > 0.05 AND l_tax > 0.05) AS nand
FROM lineitem""")
def logic_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """add, sub, mul, div, increment, and, eq, select, mixed plus, not."""
    n = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", L.add(n, F.lit(5), F.col("l_suppkey")).alias("added"), L.sub(F.col("l_suppkey"), n).alias("subbed"), L.mul(F.col("l_linenumber"), F.lit(3)).cast("int").alias("mul"), L.div(F.col("l_suppkey"), F.lit(7)).alias("div"),
        L.increment(F.col("l_linenumber")).alias("inc"), L.and_(L.eq(F.col("l_returnflag"), F.lit("A")), L.eq(F.col("l_linestatus"), F.lit("F"))).alias("both"),
        L.or_(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit("none")).alias("chosen"), L.plus(F.col("l_returnflag"), F.col("l_linenumber"), "string", "int").alias("mixed"),
        L.not_(F.col("l_discount") > 0.05, F.col("l_tax") > 0.05).alias("nand"),
    )


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k, event_type || ':' || user_id AS shown FROM events""")
def nested_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11, lookup, has_key, S9: dotted lookup into nested rows."""
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    shown = F.get_json_object(F.to_json(F.struct(F.concat_ws(":", "event_type", "user_id").alias("t"))), "$.t")
    return e.select("event_id", C.lookup("m", "k").alias("k"), F.coalesce(C.has_key("m", "k"), F.lit(False)).alias("has_k"), shown.alias("shown"))
