"""Queries on documentation texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.core import table
from tomeflow.functions import names, paths, strings
from tomeflow.operators import docs, lint, resolve
from tomeflow.plans.registry import query


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
seg AS (SELECT DISTINCT '/' || split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) AS top FROM pages),
r AS (SELECT DISTINCT page_id, '/' || split_part(regexp_replace(href, '^([a-z]+://[^/]*)?/?', ''), '/', 1) AS target, href FROM h WHERE href <> '')
SELECT page_id, href, top AS target_id FROM r LEFT JOIN seg ON target = top""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages against the first path segments of all pages' urls."""
    p = table(spark, sf_dir, "pages")
    top = lambda c: F.concat(F.lit("/"), F.split_part(c, F.lit("/"), F.lit(1)))
    known = p.select(top(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("id"))
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).where("href <> ''")
    refs = hrefs.select("page_id", "href", top(F.regexp_replace("href", "^([a-z]+://[^/]*)?/?", "")).alias("target_id")).distinct()
    return resolve.clean_references(refs, known, "target_id").select("page_id", "href", "target_id")


BROKEN_SQL = """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
seg AS (SELECT DISTINCT '/' || split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) AS top FROM pages),
bad AS (SELECT page_id, href FROM h WHERE href <> '' AND '/' || split_part(regexp_replace(href, '^([a-z]+://[^/]*)?/?', ''), '/', 1) NOT IN (SELECT top FROM seg))
SELECT href, min(page_id) AS page_id FROM bad GROUP BY href"""


@query(BROKEN_SQL)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references, each text once."""
    bad = page_links(spark, sf_dir).where("target_id is null")
    place = table(spark, sf_dir, "pages").select(F.col("page_id").alias("__id"), F.lit("page").alias("__name"), F.lit("").alias("full_path"), F.col("page_id").alias("line"), F.lit(0).alias("col"))
    refs = bad.select(F.col("page_id").alias("symbol_id"), F.col("href").alias("literal"), F.col("target_id"))
    found = lint.broken_references(refs, place)
    return found.select(F.regexp_extract("message", "(?s)reference to '(.*)'$", 1).alias("href"), F.col("line").alias("page_id"))


LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
u AS (SELECT *, trim(line) <> '' AS ok FROM l),
b AS (SELECT doc_id, min(pos) AS pos FROM u WHERE ok GROUP BY doc_id)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "literal")).withColumn("kind", F.lit("paragraph"))


@query(LINES_SQL + " SELECT doc_id, u.pos::INT AS pos, line AS brief FROM u JOIN b USING (doc_id, pos)")
def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-blank line of a document is its brief."""
    brief, _ = docs.split_brief(_lines(spark, sf_dir), "doc_id")
    return brief.select("doc_id", "pos", F.col("literal").alias("brief"))


@query(LINES_SQL + r"""
, t AS (SELECT doc_id, pos, CASE WHEN regexp_matches(trim(line), '\s\s') THEN regexp_replace(trim(line), '\s+', ' ', 'g') ELSE trim(line) END AS literal FROM u)
SELECT doc_id, count(*) AS n, md5(array_to_string(list(literal ORDER BY pos), chr(10))) AS body FROM t WHERE trim(literal) <> '' GROUP BY doc_id""")
def tidy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks trimmed and collapsed, empty ones dropped."""
    t = docs.tidy(_lines(spark, sf_dir))
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "literal"))), lambda x: x["literal"])
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(body, "\n")).alias("body"))


@query("""
WITH e AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM e)
SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, array_to_string(list(event_id::VARCHAR ORDER BY ts, event_id), ',') AS literal FROM i GROUP BY 1, 2, 3""")
def merged_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one type become one row."""
    e = table(spark, sf_dir, "events").withColumn("literal", F.col("event_id").cast("string"))
    return docs.merge_siblings(e, ["user_id"], ["ts", "event_id"], "event_type", "literal", sep=",").select("user_id", F.col("island").cast("bigint").alias("island"), "event_type", "n", "literal")


@query("""
SELECT page_id, md5(regexp_replace(html, '<[^>]*>?', '', 'g')) AS plain,
       md5(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '`', '&#x60;'), '=', '&#x3D;')) AS escaped
FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detag, escape."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strings.detag("html")).alias("plain"), F.md5(strings.escape("html")).alias("escaped"))


@query(r"""
WITH p AS (SELECT page_id, translate(html, '*`', '') AS html FROM pages),
s AS (
    SELECT page_id, 'em' AS kind, unnest(regexp_extract_all(html, '<em>(.*?)</em>', 1, 's')) AS literal, NULL AS href FROM p
    UNION ALL SELECT page_id, 'strong', unnest(regexp_extract_all(html, '<strong>(.*?)</strong>', 1, 's')), NULL FROM p
    UNION ALL SELECT page_id, 'code', unnest(regexp_extract_all(html, '<code>(.*?)</code>', 1, 's')), NULL FROM p
    UNION ALL SELECT page_id, 'link-tag', unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 2, 's')), unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 1, 's')) FROM p
)
SELECT page_id, kind, literal, href, count(*) AS n FROM s GROUP BY ALL""")
def inline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: tagged spans and links of pages, without the delimiters of the same kinds."""
    p = table(spark, sf_dir, "pages").select("page_id", F.translate("html", "*`", "").alias("html"))
    spans = docs.inline_spans(p, ["page_id"], "html").where("kind in ('em', 'strong', 'code', 'link-tag')")
    return spans.groupBy("page_id", "kind", "literal", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages),
s AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS t FROM u)
SELECT page_id, CASE WHEN p = '' THEN '#' WHEN NOT starts_with(p, '/') THEN p WHEN p = '/en/1' THEN '1'
    WHEN len(t) >= 1 AND t[1] = 'en' THEN './' || CASE WHEN len(t) = 1 THEN '.' ELSE array_to_string(t[2:], '/') END ELSE '../' || array_to_string(t, '/') END AS rel
FROM s""")
def relative_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages as seen from '/en/1'."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.relativize(path, F.lit("/en/1")).alias("rel"))


COPY_SQL = """
WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS text, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 END AS target FROM orders),
w AS (SELECT id, text, id AS source, 0 AS depth FROM t WHERE text IS NOT NULL
      UNION ALL SELECT t.id, w.text, w.source, w.depth + 1 FROM t JOIN w ON t.target = w.id)
SELECT id, text, source, depth FROM w"""


@query(COPY_SQL)
def copied_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts copied along chains of references."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    texts = o.select(k.alias("id"), F.when(k % 7 == 0, F.col("o_orderpriority")).alias("text"))
    copies = o.where(k % 7 != 0).select(k.alias("id"), (k - 1).alias("target_id"))
    return docs.copy_docs(texts, copies)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'own' WHEN p_size > 25 THEN p_name END AS doc
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def type_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undocumented parameter gets its type's brief."""
    params = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("inner_type_id"), F.when(F.col("l_linenumber") % 2 == 1, "own").otherwise("").alias("doc"))
    briefs_ = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("brief"))
    return docs.brief_of_type(params, briefs_).select("l_orderkey", "l_linenumber", "doc")


AUTO_SQL = """
WITH f AS (
    SELECT p_partkey, p_partkey AS k, p_size AS z, CASE p_size % 6 WHEN 0 THEN 'constructor' WHEN 1 THEN 'destructor' WHEN 2 THEN 'conversion' ELSE 'normal' END AS cls,
           CASE WHEN p_size % 6 > 2 THEN CASE p_partkey % 5 WHEN 0 THEN '==' WHEN 1 THEN '<<' WHEN 2 THEN '=' WHEN 3 THEN '-' ELSE '' END ELSE '' END AS op,
           p_partkey % 3 AS n, p_size % 2 = 0 AS method, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS pt, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS rt,
           CASE WHEN p_size % 5 = 0 THEN p_name END AS rb, p_type, CASE p_partkey % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'lref' WHEN 2 THEN 'rref' ELSE 'pointer' END AS kind,
           CASE WHEN p_size % 8 = 0 THEN 'x' ELSE '' END AS pname, p_size % 9 = 0 AS taken
    FROM part
), g AS (SELECT *, op = '<<' AND n = 2 AND NOT method AS stream, n + method::INT AS free, k % 3 = 0 AS own FROM f)
SELECT p_partkey,
    CASE WHEN cls = 'constructor' THEN CASE WHEN n = 0 THEN 'Default constructor' WHEN n = 1 AND k % 4 = 0 THEN 'Copy constructor' WHEN n = 1 AND k % 4 = 1 THEN 'Move constructor'
              WHEN n = 1 AND pt <> '' THEN 'Construct from ' || pt ELSE 'Constructor' END
         WHEN cls = 'destructor' THEN 'Destructor' WHEN cls = 'conversion' THEN CASE WHEN rt <> '' THEN 'Conversion to ' || rt ELSE 'Conversion operator' END
         WHEN stream THEN 'Stream insertion operator' WHEN op = '=' AND n = 1 AND k % 4 = 0 THEN 'Copy assignment operator' WHEN op = '=' AND n = 1 AND k % 4 = 1 THEN 'Move assignment operator'
         WHEN op = '==' THEN 'Equality operator' WHEN op = '<<' THEN 'Left shift operator' WHEN op = '=' THEN 'Assignment operator'
         WHEN op = '-' THEN CASE WHEN free = 2 THEN 'Subtraction operator' ELSE 'Unary minus operator' END END AS brief,
    CASE WHEN cls = 'conversion' THEN coalesce(rb, 'The object converted to ' || rt) WHEN op = '' THEN NULL WHEN stream THEN 'Reference to the current output stream'
         WHEN kind = 'lref' THEN CASE WHEN own THEN 'Reference to the current object' END WHEN kind = 'pointer' THEN CASE WHEN own THEN 'Pointer to the current object' END
         WHEN op = '==' THEN CASE WHEN kind = 'named' AND k % 2 = 0 THEN 'true if the objects are equal, false otherwise' END
         WHEN method AND own THEN CASE WHEN kind = 'rref' THEN 'Rvalue reference to the current object' ELSE 'Another instance of the object' END END AS returns,
    CASE WHEN pname <> '' THEN pname WHEN (cls = 'constructor' OR op = '=') AND method AND n = 1 AND NOT (taken AND k % 2 = 1) THEN CASE WHEN k % 2 = 0 THEN 'other' ELSE 'value' END
         WHEN stream THEN 'os' WHEN op <> '' AND free = 2 THEN CASE WHEN method THEN 'rhs' ELSE 'lhs' END WHEN op = '-' AND NOT method AND n = 1 AND NOT taken THEN 'value' END AS param_name,
    CASE WHEN (cls = 'constructor' OR op = '=') AND method THEN 'The ' || CASE WHEN k % 5 = 0 THEN 'value' ELSE 'object' END || ' to ' ||
              CASE WHEN k % 5 = 0 THEN '' WHEN kind = 'lref' THEN 'copy ' WHEN kind = 'rref' THEN 'move ' ELSE '' END || CASE WHEN op = '=' THEN 'assign' ELSE 'construct' END || ' from'
         WHEN stream THEN 'An output stream' WHEN op <> '' AND free = 2 THEN CASE WHEN method THEN 'The right operand' ELSE 'The left operand' END
         WHEN op = '-' AND NOT method AND n = 1 THEN 'The operand' ELSE p_type END AS param_doc
FROM g"""


@query(AUTO_SQL)
def auto_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs, returns, and the first parameter's name and text of special
    functions."""
    k, z = F.col("p_partkey"), F.col("p_size")
    cls = F.expr("case p_size % 6 when 0 then 'constructor' when 1 then 'destructor' when 2 then 'conversion' else 'normal' end")
    op = F.expr("case when p_size % 6 > 2 then case p_partkey % 5 when 0 then 'operator==' when 1 then 'operator<<' when 2 then 'operator=' when 3 then 'operator-' else '' end else '' end")
    kind = F.expr("case p_partkey % 4 when 0 then 'named' when 1 then 'lref' when 2 then 'rref' else 'pointer' end")
    n, name = (k % 3).cast("int"), F.when(z % 8 == 0, "x").otherwise("")
    f = table(spark, sf_dir, "part").select(
        "p_partkey", cls.alias("func_class"), op.alias("operator"), n.alias("param_count"), (z % 2 == 0).alias("is_record_method"), (n + (z % 2 == 0).cast("int")).alias("arity"),
        ((cls == "constructor") & (n == 0)).alias("is_default"), ((n == 1) & (k % 4 == 0)).alias("is_copy"), ((n == 1) & (k % 4 == 1)).alias("is_move"),
        ((op == "operator=") & (n == 1) & (k % 4 == 0)).alias("is_copy_assign"), ((op == "operator=") & (n == 1) & (k % 4 == 1)).alias("is_move_assign"), ((op == "operator<<") & (n == 2) & (z % 2 != 0)).alias("is_stream"),
        F.when(k % 7 == 0, "").otherwise(F.col("p_brand")).alias("param_type"), F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("return_type"), F.when(z % 5 == 0, F.col("p_name")).alias("return_brief"),
        kind.alias("return_kind"), F.when(k % 3 == 0, "P").otherwise("Q").alias("return_symbol"), F.lit("P").alias("parent_id"), F.when(k % 2 == 0, "bool").alias("return_fundamental"),
        F.lit(0).alias("pos"), name.alias("name"), F.array_compact(F.array(F.when(name != "", name), F.when(z % 9 == 0, "value"))).alias("names"),
        F.when(k % 2 == 0, "P").otherwise("Q").alias("param_symbol"), kind.alias("param_kind"), (k % 5 == 0).alias("is_fundamental"), F.col("p_type").alias("type_brief"),
    )
    f = names.with_operator_names(f, arity="arity")
    return f.select("p_partkey", docs.auto_brief().alias("brief"), docs.auto_returns().alias("returns"), docs.auto_param_name().alias("param_name"), docs.auto_param_doc().alias("param_doc"))


@query("""
SELECT doc_id, CASE WHEN text LIKE 'Get %' THEN substr(text, 5) WHEN text LIKE 'Returns %' THEN substr(text, 9) WHEN doc_id % 3 = 0 THEN coalesce(text, '') WHEN doc_id % 3 = 1 THEN coalesce(text, '') END AS returns
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def returns_of_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is returned, from briefs that begin with a verb."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    own = F.startswith(text, F.lit("Get ")) | F.startswith(text, F.lit("Returns "))
    brief = F.when(own, text).otherwise(F.concat(F.when(k % 3 == 0, "Determines ").when(k % 3 == 1, "Returns ").otherwise("A "), text))
    return table(spark, sf_dir, "documents").select("doc_id", docs.returns_from_brief(brief).alias("returns"))


@query(r"""
WITH d AS (SELECT doc_id, source, translate(coalesce(text, ''), '@' || chr(92), '') AS body FROM documents),
b AS (SELECT doc_id, source, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d)
SELECT doc_id, 'brief' AS section, NULL AS argument, NULL AS direction, md5(CASE WHEN regexp_matches(body, '[\t-\r ][\t-\r ]') THEN regexp_replace(body, '[\t-\r ]+', ' ', 'g') ELSE body END) AS literal FROM b
UNION ALL SELECT doc_id, 'params', 'a,b', 'in', md5(source) FROM d
UNION ALL SELECT doc_id, 'returns', NULL, NULL, md5('the text') FROM d""")
def doc_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of a comment whose brief is a document's whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "@\\", "").alias("text"), "source")
    body = F.concat(F.lit("@brief "), F.col("text"), F.lit("\n@param[in] a,b "), F.col("source"), F.lit("\n@returns the text"))
    rows = docs.doc_commands(d.select("doc_id", body.alias("body")), ["doc_id"])
    return rows.select("doc_id", "section", "argument", "direction", F.md5("literal").alias("literal"))


@query(r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '@*/' || chr(92), '') AS body FROM documents)
SELECT doc_id, 0 AS pos, md5(trim(' ' || body || ' ', ' ')) AS body FROM d UNION ALL SELECT doc_id, 1, md5('tail ' || doc_id || chr(10) || 'end') FROM d""")
def source_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments cut out of sources: a block comment with a document's whole text,
    and two lines of line comments."""
    text = F.translate(F.coalesce("text", F.lit("")), "@*/\\", "")
    source = F.concat(F.lit("int a;\n/** "), text, F.lit(" */\nint b; // none\n/// tail "), "doc_id", F.lit("\n  /// end\nint c;\n"))
    found = docs.comment_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), source.alias("text")))
    return found.select(F.col("path").alias("doc_id"), "pos", F.md5("body").alias("body"))


@query("SELECT doc_id, p AS name, 'in' AS direction, source AS literal FROM documents, (VALUES ('a'), ('b')) v(p)")
def doc_param_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per name of a parameter command."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("text\n@param[in] a,b "), F.col("source"))
    rows = docs.param_rows(docs.doc_commands(d.select("doc_id", body.alias("body")), ["doc_id"]), ["doc_id"])
    return rows.select("doc_id", "name", "direction", "literal")


@query(LINES_SQL + """
SELECT doc_id AS full_path, pos + 1 AS line, line AS source FROM u WHERE contains(line, 'password') OR contains(line, '@') OR pos = 0""")
def warning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings joined to their source lines."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = lint.source_lines(files).where("contains(source, 'password') or contains(source, '@') or line = 1").select("full_path", "line")
    return lint.with_source_line(found, files).select("full_path", F.col("line").cast("bigint").alias("line"), "source")


TABBED_SQL = LINES_SQL.replace("coalesce(text, '')", "replace(coalesce(text, ''), 'of', 'o' || chr(9) || 'f')")


@query(TABBED_SQL + """
, n AS (SELECT doc_id, max(pos) + 1 AS last FROM u GROUP BY 1),
w AS (SELECT u.doc_id, pos + 1 AS n, strpos(line, 'the') AS c, line, last FROM u JOIN n ON n.doc_id = u.doc_id WHERE contains(line, 'the')),
x AS (SELECT *, list_reduce(string_split(line, chr(9)), lambda a, p: a || repeat(' ', (8 - length(a) % 8)::BIGINT) || p) AS shown,
             c - 1 + 7 * (c - 1 - length(replace(line[:c - 1], chr(9), ''))) AS gap FROM w)
SELECT doc_id AS full_path, n AS line, md5(doc_id || ':' || n || ':' || c || ':' || chr(10) || '    1) found' || chr(10) || '    2) again' || chr(10) || '    3) found' || chr(10) ||
       CASE WHEN n < last THEN '  ' || n || ' | ' || shown || chr(10) || repeat(' ', length(n::VARCHAR) + 3) || '| ' ||
                 CASE WHEN c < length(line) THEN repeat(' ', gap) || '^' || repeat('~', greatest(0, length(shown) - gap - 1)) || chr(10) ELSE '' END ELSE '' END) AS text
FROM x""")
def warning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts: header, numbered messages in order of emission (one of
    them twice), source line with tabs, caret line; for each line with a word."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("of"), F.lit("o\tf"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), text.alias("text"))
    hit = lint.source_lines(files).where("contains(source, 'the')")
    each = F.posexplode(F.array(F.lit("found"), F.lit("again"), F.lit("found"))).alias("seq", "message")
    warnings = hit.select("full_path", "line", F.instr("source", "the").alias("col"), each)
    out = lint.warning_report(warnings, files)
    return out.select("full_path", F.col("line").cast("bigint").alias("line"), F.md5("text").alias("text"))


@query(LINES_SQL + """
, e AS (SELECT doc_id, trim(line) AS l, count(*) AS ne FROM u GROUP BY 1, 2),
p AS (SELECT doc_id, trim(replace(line, 'the', 'THE')) AS l, count(*) AS np FROM u GROUP BY 1, 2),
j AS (SELECT coalesce(e.doc_id, p.doc_id) AS path, coalesce(ne, 0) AS ne, coalesce(np, 0) AS np FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.l = p.l)
SELECT path, sum(greatest(0, np - ne))::BIGINT AS added, sum(greatest(0, ne - np))::BIGINT AS removed FROM j GROUP BY path HAVING added > 0 OR removed > 0""")
def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and removed by an edit."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return lint.golden_diff(d, d.withColumn("text", F.replace("text", F.lit("the"), F.lit("THE"))))


#: The sections of a symbol's page.
SECTIONS = ["namespaces", "records", "enums", "functions", "typedefs", "variables", "concepts", "guides", "usings", "friends", "bases", "derived", "related"]


@query("""
WITH s AS (SELECT o_custkey, list_extract(['namespaces', 'records', 'enums', 'functions', 'typedefs', 'variables', 'concepts', 'guides', 'usings', 'friends', 'bases', 'derived', 'related'], (o_orderkey % 13 + 1)::INT) AS section,
                  o_orderkey AS k, o_orderpriority AS b FROM orders),
l AS (SELECT o_custkey, section, array_to_string(list(k || ' ' || b ORDER BY k), ';') AS items FROM s GROUP BY 1, 2)
SELECT c_custkey, section, items FROM customer JOIN l ON o_custkey = c_custkey""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of customers' pages."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol_id"), k.alias("pos"), k.cast("string").alias("name"), F.col("o_orderpriority").alias("brief"))
    parts = {name: rows.where(F.col("pos") % len(SECTIONS) == n) for n, name in enumerate(SECTIONS)}
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    text = lambda name: F.array_join(F.transform(name, lambda x: F.concat(x["name"], F.lit(" "), x["brief"])), ";")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), text(n).alias("items")) for n in SECTIONS]))
    return docs.page_sections(c, parts).select(F.col("id").alias("c_custkey"), each.alias("s")).select("c_custkey", "s.*").where("items is not null")


@query("""
WITH o AS (SELECT o_custkey, array_to_string(list('<li>' || o_orderkey || ' ' || o_orderpriority || '</li>' ORDER BY o_orderkey), '') AS li FROM orders GROUP BY 1)
SELECT c_custkey, md5('<h1>' || c_name || '</h1>' || coalesce('<ul>' || li || '</ul>', '')) AS page, o.li IS NOT NULL AS has_orders FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sections of a customer, rendered by column expressions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("brief"))
    s = docs.page_sections(c, {"functions": rows})
    items = F.array_join(F.transform("functions", lambda x: F.concat(F.lit("<li>"), x["name"], F.lit(" "), x["brief"], F.lit("</li>"))), "")
    page = docs.render_pages(s, F.concat(F.lit("<h1>"), F.col("name"), F.lit("</h1>")), [F.concat(F.lit("<ul>"), items, F.lit("</ul>"))])
    return page.select(F.col("id").alias("c_custkey"), F.md5("page").alias("page"), F.col("functions").isNotNull().alias("has_orders"))
