"""Queries on types, specifiers, paths and pages of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.core import fresh_path, table
from tomeflow.functions import names
from tomeflow.operators import filters, hierarchy, resolve, types
from tomeflow.plans.registry import query
from tomeflow.sources import readers, writers


@query("""
SELECT p_partkey AS type_id, CASE p_size % 5 WHEN 0 THEN 'const T' || p_partkey % 3 || '&' WHEN 1 THEN 'T' || p_partkey % 3 || '* const' WHEN 2 THEN 'T' || p_partkey % 3 || '(*)[4]'
    WHEN 3 THEN 'T' || p_partkey % 3 || '(&&)(int, char)' ELSE 'T' || p_partkey % 3 || '[4]' END AS type_text, 'T' || p_partkey % 3 AS innermost
FROM part""")
def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of type chains."""
    k = F.col("p_size") % 5
    no, null = F.lit(False), F.lit(None).cast("string")
    node = lambda depth, kind, name=null, const=no, bound=null, args=null: F.struct(F.lit(depth).alias("depth"), kind.alias("kind"), name.alias("name"), const.alias("is_const"), no.alias("is_volatile"), bound.alias("bound"), args.alias("args"))
    outer = F.expr("case p_size % 5 when 0 then 'lref' when 1 then 'pointer' when 2 then 'pointer' when 3 then 'rref' else 'array' end")
    middle = F.when(k == 2, "array").when(k == 3, "function").otherwise("none")
    chain = F.array(
        node(0, outer, const=k == 1, bound=F.when(k == 4, "4")), node(1, middle, bound=F.when(k == 2, "4"), args=F.when(k == 3, "int, char")),
        node(2, F.lit("named"), F.concat(F.lit("T"), (F.col("p_partkey") % 3).cast("string")), k == 0),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("type_id"), F.explode(chain).alias("n")).select("type_id", "n.*").where("kind <> 'none'")
    return types.type_texts(rows)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN '' WHEN l_returnflag = 'N' THEN 'noexcept' WHEN l_returnflag = 'A' THEN 'noexcept(' || l_linestatus || ')' ELSE '' END AS spec,
       CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'constexpr' ELSE 'consteval' END AS cx, CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'public' WHEN 2 THEN 'protected' ELSE 'private' END AS access,
       CASE l_linenumber % 2 WHEN 0 THEN 'void' ELSE 'std::nullptr_t' END AS fundamental
FROM lineitem""")
def specifier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumeration names and specifier texts."""
    n = F.col("l_linenumber")
    kind = F.expr("case l_returnflag when 'N' then 'true' when 'A' then 'dependent' else 'false' end")
    operand = F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", types.specifier_text("noexcept", kind, operand, F.col("l_tax") > 0.07).alias("spec"), names.enum_name((n % 3).cast("int"), names.CONSTEXPR).alias("cx"),
        names.enum_name((n % 4).cast("int"), names.ACCESS).alias("access"), names.enum_name((n % 2).cast("int"), names.FUNDAMENTAL).alias("fundamental"),
    )


@query("""
SELECT page_id, CASE WHEN starts_with(p, '/en/') THEN substr(p, 5) WHEN starts_with(p, '/') THEN substr(p, 2) ELSE p END AS short
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages)""")
def short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search directory '/en', then the root."""
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", filters.short_path(p, "/", ["/en"]).alias("short"))


@query("""
WITH s AS (SELECT p_partkey AS id, p_brand AS parent_id, p_name AS name, p_size % 3 = 0 AS is_primary, p_size % 2 = 0 AS has_page FROM part),
pr AS (SELECT parent_id, name, min('/' || id) AS u FROM s WHERE is_primary AND has_page GROUP BY 1, 2)
SELECT s.id, pr.u AS alternative_url FROM s LEFT JOIN pr ON s.parent_id = pr.parent_id AND s.name = pr.name WHERE NOT has_page""")
def alternative_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part without a page links to its primary sibling's."""
    k = F.col("p_size")
    s = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("parent_id"), F.lit("record").alias("kind"), F.col("p_name").alias("name"), F.when(k % 3 == 0, 1).otherwise(0).alias("tparam_count"), F.lit(0).alias("targ_count"), (k % 2 == 0).alias("has_page"),
    )
    urls = s.where("has_page").select("id", F.concat(F.lit("/"), "id").alias("url"))
    out = filters.alternative_urls(s, urls, spark.createDataFrame([], "id string, target_id string"))
    return out.select(F.col("id").cast("bigint").alias("id"), "alternative_url")


@query("""
SELECT 'r:' || n_regionkey AS context_id, c_name AS name, 'c:' || c_custkey AS target_id
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'r:' || n_regionkey, c_name, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 1""")
def transparent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of inline namespaces (even nations) are found in the region."""
    from tomeflow.plans.scopes import scope_tree

    tree = scope_tree(spark, sf_dir, orders=False)
    inline = F.startswith("id", F.lit("n:")) & (F.expr("try_cast(substring(id, 3) as int)") % 2 == 0)
    tree = tree.withColumn("is_inline", F.coalesce(inline, F.lit(False))).withColumn("scoped", F.lit(True))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    refs = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("r:"), "n_regionkey").alias("context_id"), F.col("c_name").alias("name"))
    return resolve.resolve_scoped(refs, hierarchy.ancestors(tree), resolve.name_index(tree)).select("context_id", "name", "target_id")


@query("""
WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN starts_with(o_orderpriority, '1') THEN ['urgent', 'any'] WHEN o_orderpriority LIKE '%-HIGH' THEN ['high', 'any'] ELSE ['any'] END AS p FROM orders)
SELECT o_orderkey, unnest(p) AS pattern FROM a""")
def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows against a table of patterns, by literal prefix."""
    from tomeflow.operators.globs import match_patterns

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return match_patterns(o, "o_orderpriority", [("urgent", "1-*"), ("high", "*-HIGH"), ("any", "**")]).select("o_orderkey", "pattern")


@query("""
SELECT c_custkey, 'ends ' || printf('%04d', c_custkey % 10000) AS pattern FROM customer
UNION ALL SELECT c_custkey, 'begins ' || printf('%03d', c_custkey // 100) FROM customer WHERE c_custkey // 100 < 1000""")
def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' numbers against 11,000 globs in one pass."""
    from tomeflow.operators.globs import match_patterns

    digit = "{" + ",".join("0123456789") + "}"
    globs = [(f"ends {k:04d}", f"C?[!x]*:*{k:04d}") for k in range(10_000)] + [(f"begins {k:03d}", f"C#y:000{k:03d}{digit}?") for k in range(1000)]
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C#y:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("text"))
    return match_patterns(c, "text", globs).select("c_custkey", "pattern")


@query("""
SELECT p_partkey, 'template<typename T' || CASE WHEN p_size % 2 = 0 THEN ' = int' ELSE '' END || ', int N' || CASE WHEN p_size % 3 = 0 THEN ' = ' || p_size ELSE '' END ||
       CASE WHEN p_size % 5 = 0 THEN ', template<...> typename C' ELSE '' END || '>' AS head,
       'T' || p_partkey % 3 || ', ' || p_size || CASE WHEN p_size % 5 = 0 THEN ', list...' ELSE '' END AS args
FROM part""")
def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template heads and argument lists."""
    k, null = F.col("p_size"), F.lit(None).cast("string")
    param = lambda kind, name, key=null, type_=null, default=null: F.struct(F.lit(kind).alias("kind"), key.alias("key"), type_.alias("type"), F.lit(name).alias("name"), default.alias("default"))
    params = [param("type", "T", key=F.lit("typename"), default=F.when(k % 2 == 0, "int")), param("constant", "N", type_=F.lit("int"), default=F.when(k % 3 == 0, k.cast("string"))), F.when(k % 5 == 0, param("template", "C"))]
    arg = lambda kind, text, pack=False: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(pack).alias("is_pack"))
    args = [arg("type", F.concat(F.lit("T"), (F.col("p_partkey") % 3).cast("string"))), arg("constant", k.cast("string")), F.when(k % 5 == 0, arg("template", F.lit("list"), True))]
    return table(spark, sf_dir, "part").select("p_partkey", types.template_head(F.array_compact(F.array(*params))).alias("head"), types.template_args(F.array_compact(F.array(*args))).alias("args"))


@query("SELECT page_id || '.html' AS name, md5(coalesce(html, '')) AS text FROM pages WHERE page_id <> 7")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per page is written, the folder scanned, one name excluded."""
    folder = fresh_path(spark, "scan")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), "page_id", F.lit(".html")).alias("url"), F.coalesce("html", F.lit("")).alias("page"))
    writers.write_page_files(pages, folder).write.format("noop").mode("overwrite").save()
    found = readers.scan_files(spark, [folder], patterns=["*.html"], exclude_patterns=["**/7.html"])
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.md5("text").alias("text"))
