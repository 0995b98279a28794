"""Queries through sources, sinks, streams and helpers: what is written to the shared
folder is read back and returned."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tomeflow
from tomeflow.core import fresh_path, table
from tomeflow.operators import merge
from tomeflow.plans.registry import query
from tomeflow.sources import readers, writers
from tomeflow.streaming import incremental
from tomeflow.udf import Helpers


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML element per supplier, written and read."""
    path = fresh_path(spark, "xml")
    writers.write_xml(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), path)
    return readers.read_flat_xml(spark, path, "symbol", "_id long, name string, nation int").withColumnRenamed("_id", "id")


@query("""
SELECT n_name AS compound, 'record' AS kind, NULL AS member_kind, n_name AS name, NULL AS arglist FROM nation
UNION ALL SELECT n_name, 'record', 'function', s_name, '(int p1, ' || CASE WHEN s_acctbal < 0 THEN 'T' ELSE 'U' END || ' p2)' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds and their functions with argument lists."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    null = F.lit(None).cast("string")
    records = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), null.alias("parent_id"), F.lit("record").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("qualified_name"), F.lit(0).alias("extraction"), null.alias("return_type"))
    functions = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.lit("function").alias("kind"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"), F.lit(0).alias("extraction"), F.lit("int").alias("return_type"))
    symbols = records.union(functions)
    args = s.select(F.concat(F.lit("s"), "s_suppkey").alias("func_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("int").alias("type_text"), F.lit("p1").alias("name")),
        F.struct(F.lit(1).alias("pos"), F.when(F.col("s_acctbal") < 0, "T").otherwise("U").alias("type_text"), F.lit("p2").alias("name")),
    )).alias("p")).select("func_id", "p.*")
    urls = symbols.select("id", F.concat(F.lit("/"), "id").alias("url"), F.col("id").alias("anchor"))
    return writers.tag_index(symbols, args, urls).select("compound", "kind", "member_kind", "name", "arglist")


@query("SELECT '/' || c_custkey || '.html' AS url, '<h1>' || c_name || '</h1>' AS page FROM customer")
def multi_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written by URL bucket and read back."""
    path = fresh_path(spark, "pages")
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), "c_custkey", F.lit(".html")).alias("url"), F.col("c_name").alias("page"))
    writers.write_pages(writers.wrap_pages(pages, F.lit("<h1>"), F.lit("</h1>")), path, files=8)
    return spark.read.parquet(path).select("url", "page")


@query("SELECT '/' || page_id || '.html' AS url, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per page."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), "page_id", F.lit(".html")).alias("url"), F.coalesce("html", F.lit("")).alias("page"))
    return writers.write_page_files(p, fresh_path(spark, "files"))


@query("""
SELECT '/w/' || o_custkey || '/f' || o_orderkey % 3 || CASE o_orderkey % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.hpp' WHEN 2 THEN '.cxx' END AS path, '/w/' || o_custkey AS directory,
       arg_min('cc ' || o_orderkey, o_orderkey) AS command
FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1, 2""")
def compile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of each customer's orders, with relative paths, files of other
    languages and repeated files, written and scanned."""
    k = F.col("o_orderkey")
    ext = F.expr("case o_orderkey % 4 when 0 then '.cpp' when 1 then '.hpp' when 2 then '.cxx' else '.py' end")
    entry = F.struct(k.alias("k"), F.concat(F.lit("/w/"), "o_custkey").alias("directory"), F.concat(F.lit("./f"), k % 3, ext).alias("file"), F.concat(F.lit("cc "), k).alias("command"))
    listing = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))
    path = fresh_path(spark, "commands")
    listing.select("value").write.text(path)
    return readers.scan_compile_commands(spark, path, one_per_line=True).select("path", "directory", "command")


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name FROM supplier)
SELECT 'n' || n || '-' || k AS id, NULL AS parent_id, 'namespace' AS kind, 'N' || n AS name FROM s
UNION ALL SELECT 's' || k, 'n' || n || '-' || k, 'record', s_name FROM s
UNION ALL SELECT 'f' || k, 's' || k, 'function', 'f' FROM s""")
def xml_symbol_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: nested dumps, one file per supplier; templates stand between a symbol and
    its scope at any depth."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(
        F.lit("<mrx><namespace name='N"), n, F.lit("' id='n"), n, F.lit("-"), k, F.lit("'><template><x><struct name='"), "s_name", F.lit("' id='s"), k,
        F.lit("'><template><x><y><function name='f' access='public' id='f"), k, F.lit("'><param name='p'><type name='int'/></param></function></y></x></template></struct></x></template></namespace></mrx>"),
    )
    folder = fresh_path(spark, "dumps")
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/"), k, F.lit(".xml")).alias("url"), text.alias("page"))
    writers.write_page_files(pages, folder).write.format("noop").mode("overwrite").save()
    return readers.symbols_from_xml(readers.xml_nodes(spark, folder))["symbols"].select("id", "parent_id", "kind", "name")


@query("""
SELECT 'k' || c_custkey AS scope_id, 'name' AS tag, c_name AS text FROM customer
UNION ALL SELECT 'k' || c_custkey, 'nation', c_nationkey::VARCHAR FROM customer""")
def xml_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of all customers, read tag by tag in byte ranges."""
    path = fresh_path(spark, "xml")
    c = table(spark, sf_dir, "customer")
    writers.write_xml(c.select(F.concat(F.lit("k"), "c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), path)
    return readers.xml_nodes_split(spark, path).where("tag in ('name', 'nation')").select("scope_id", "tag", "text")


@query("SELECT c_name AS value FROM customer UNION ALL SELECT 'head' UNION ALL SELECT 'foot'")
def single_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page in traversal order between header and footer."""
    path = fresh_path(spark, "single")
    rows = writers.wrap_single(table(spark, sf_dir, "customer"), "head", "foot", "c_custkey", "c_name")
    ordered = rows.withColumn("__o", F.col("part") * F.lit(1 << 40) + F.col("idx"))
    writers.write_single_page(ordered, path, "__o", "value")
    return spark.read.text(path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON text, parsed again."""
    j = writers.json_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return j.select(F.from_json("json", "o_orderkey bigint, o_custkey bigint, o_orderstatus string").alias("r")).select("r.*")


@query("SELECT '/src/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.hpp' ELSE '.cpp' END AS path, length(coalesce(text, '')) AS n FROM documents WHERE doc_id % 5 <> 0")
def filtered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, S1's filter: files by directory, exclusion and name pattern."""
    from tomeflow.operators.filters import FileRules, file_filter

    k = F.col("doc_id")
    path = F.concat(F.lit("/src/"), F.when(k % 5 == 0, "gen/").otherwise(""), k.cast("string"), F.when(k % 3 == 0, ".hpp").otherwise(".cpp"))
    d = table(spark, sf_dir, "documents").select(path.alias("path"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    return d.where(file_filter(F.col("path"), FileRules(["/src"], True, ["/src/gen"], ["**/old/**"], ["*.hpp", "*.cpp"])))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN p_partkey % 3 = 0 WHEN 2 THEN FALSE WHEN 3 THEN NOT (p_partkey % 2 = 0 OR p_partkey % 5 = 0) ELSE TRUE END AS kept FROM part")
def type_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """private members but virtual ones, statics, and records that are anonymous
    or in source files are dropped."""
    from tomeflow.operators.filters import TypeRules, type_filter

    no, m = F.lit(False), F.col("p_size") % 4
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(m == 1, "private").otherwise("public").alias("access"), (F.col("p_partkey") % 3 == 0).alias("is_virtual"), (F.col("p_partkey") % 5 == 0).alias("is_anonymous"),
        F.when(m == 3, "record").otherwise("function").alias("kind"), (m == 2).alias("is_static"), no.alias("is_record_member"), no.alias("is_implicit"), F.when(F.col("p_partkey") % 2 == 0, "a.cpp").otherwise("a.hpp").alias("full_path"),
    )
    return p.select("id", type_filter(TypeRules(private_virtual=True, local_classes=False)).alias("kept"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a glob, as the table is one file or a folder of files
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT DISTINCT event_type, user_id FROM events")
def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: streaming first occurrences of (event_type, user_id)."""
    out, mark = fresh_path(spark, "seen"), fresh_path(spark, "seen-mark")
    seen = incremental.first_seen(_stream(spark, sf_dir), ["event_type", "user_id"]).select("event_type", "user_id")
    seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def incremental_merge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of users' first events, merged batch by batch in hash buckets."""
    out, mark = fresh_path(spark, "corpus"), fresh_path(spark, "corpus-mark")

    def first_event(rows: DataFrame) -> DataFrame:
        s = rows.withColumn("seq", F.struct("ts", "event_id")).withColumn("event_ts", F.col("ts")).withColumn("event_no", F.col("event_id"))
        m = merge.merge_symbols(s, "seq", first=["event_type", "event_no", "event_ts"], id_col="user_id")
        return m.select("user_id", "event_type", F.col("event_no").alias("event_id"), F.col("event_ts").alias("ts"))

    incremental.incremental_merge(_stream(spark, sf_dir), out, mark, first_event, ["user_id"], buckets=8).trigger(availableNow=True).start().awaitTermination()
    return incremental.corpus(spark, out).select("user_id", "event_type", "event_id")


@query("SELECT s_suppkey, regexp_replace(s_name, '[^A-Z]', '', 'g') AS initials FROM supplier")
def loaded_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A helper loaded from a folder of helper files."""
    helpers = Helpers(spark)
    helpers.load(str(Path(tomeflow.__file__).parent / "helpers"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", helpers.call("initials", F.col("s_name")).alias("initials"))


def _initials(names: pd.Series) -> pd.Series:
    return names.str.replace(r"[^A-Z]", "", regex=True)


@query("SELECT s_suppkey, regexp_replace(s_name, '[^A-Z]', '', 'g') AS initials FROM supplier")
def registered_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered helper, called from SQL."""
    helpers = Helpers(spark)
    helpers.register("initials", _initials, "string")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("__suppliers")
    return spark.sql("SELECT s_suppkey, initials(s_name) AS initials FROM __suppliers")
