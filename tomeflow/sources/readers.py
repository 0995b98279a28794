"""Sources: source trees, compile listings, XML symbol dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import materialize
from tomeflow.functions import paths as P
from tomeflow.operators.filters import FileRules, file_filter

# Extensions of source and header files.
SOURCE_EXTENSIONS = ["c", "cc", "cpp", "cxx", "c++", "C"]
HEADER_EXTENSIONS = ["h", "hh", "hpp", "hxx", "h++", "inc", "ipp", "tpp"]


def scan_files(spark: SparkSession, dirs: list[str], recursive: bool = True, patterns: list[str] = ["*"], exclude: list[str] = [], exclude_patterns: list[str] = []) -> DataFrame:
    """(path, text) of whole files. Paths are filtered before any text is read:
    the file filter is on the path column alone."""
    df = spark.read.option("recursiveFileLookup", recursive).text(dirs, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    rows = df.select(path.alias("path"), F.col("value").alias("text"))
    strip = lambda d: d.removeprefix("file://").removeprefix("file:")
    rules = FileRules([strip(d) for d in dirs], recursive, [strip(d) for d in exclude], exclude_patterns, patterns)
    return rows.where(file_filter(F.col("path"), rules))


def scan_compile_commands(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(path, directory, command, pos): absolute, C and C++ files only, the first
    entry of a file wins. A listing is a whole file, or a line if ``one_per_line``;
    of several listings with one file the least command at the first place wins."""
    raw = spark.read.text(path, wholetext=not one_per_line).select(F.posexplode(F.from_json("value", "array<struct<directory:string,file:string,command:string>>")).alias("pos", "e"))
    full = P.normalize(P.absolute(F.col("e.file"), F.col("e.directory")))
    rows = raw.select(full.alias("path"), F.col("e.directory").alias("directory"), F.col("e.command").alias("command"), "pos")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    kept = rows.where(ext.isin(*SOURCE_EXTENSIONS, *HEADER_EXTENSIONS))
    first = kept.groupBy("path").agg(F.min(F.struct("pos", "command", "directory")).alias("e"))
    return first.select("path", "e.directory", "e.command", "e.pos")


def read_flat_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """S3, flat elements: one row per ``row_tag`` element; attributes have '_'."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


NODES = "path string, node_id long, parent_node_id long, scope_id string, tag string, attrs map<string,string>, text string"


def xml_nodes(spark: SparkSession, path: str, most: int = 10_000, only: DataFrame | None = None) -> DataFrame:
    """S3: every element of whole XML files (of the paths in ``only``, if given) as a
    node row; the tree is recursive, so the parent is a column, and so is ``scope_id``,
    the id of the nearest element around it that has one, at any depth. Elements are
    freed as they end, and rows are given on by ``most``. One task reads a file: see
    ``xml_nodes_split`` for large ones."""
    import io
    import xml.etree.ElementTree as ET

    def shred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, text in zip(pdf["path"], pdf["value"]):
                rows, stack, n, columns = [], [], 0, ["path", "node_id", "parent_node_id", "scope_id", "tag", "attrs", "text"]
                for event, e in ET.iterparse(io.BytesIO(text.encode()), ("start", "end")):
                    if event == "start":
                        stack.append((n, stack[-1][0] if stack else None, stack[-1][3] if stack else None, e.get("id") or (stack[-1][3] if stack else None)))
                        n += 1
                    else:
                        node, parent, scope, _ = stack.pop()
                        rows.append((file, node, parent, scope, e.tag, dict(e.attrib), (e.text or "").strip()))
                        e.clear()
                        if len(rows) == most or not stack:
                            yield pd.DataFrame(rows, columns=columns).astype({"parent_node_id": "Int64"})
                            rows = []

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if only is not None:
        files = files.join(only.select("path"), "path", "left_semi").select("path", "value")
    return files.mapInPandas(shred, NODES)


_ATTRIBUTE = r"""([^\s=]+)\s*=\s*("[^"]*"|'[^']*')"""


def _unescaped(text: Column) -> Column:
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def _before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows`` (path, block, seq, ...) with ``out``: the sum of ``value`` over all rows
    of the file before: a running sum in each block, shifted by the sums of the blocks
    before it."""
    rows = rows.withColumn("__v", value)
    totals = rows.groupBy("path", "block").agg(F.sum("__v").alias("__t"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("path", "block", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__s"))
    running = F.sum("__v").over(Window.partitionBy("path", "block").orderBy("seq"))
    return rows.withColumn("__r", running).join(shift, ["path", "block"]).withColumn(out, F.col("__s") + F.col("__r") - F.col("__v")).drop("__v", "__r", "__s")


def _innermost(rows: DataFrame, delta: Column, payload: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the payload of the innermost element open before each row
    (``delta`` is 1 where one opens, -1 where one closes). That is the last one opened at
    the level below the row's, in this block or else in the nearest before it."""
    rows = _before(rows.withColumn("__delta", delta), F.col("__delta"), "__depth")
    opened = rows.where("__delta = 1").select("path", "block", "seq", F.col("__depth").alias("__level"), payload.alias("__p"), F.lit(None).cast("boolean").alias("__asks"))
    asked = rows.select("path", "block", "seq", (F.col("__depth") - 1).alias("__level"), F.lit(None).cast(opened.schema["__p"].dataType).alias("__p"), F.lit(True).alias("__asks"))
    every = opened.union(asked).where("__level >= 0")
    last = every.groupBy("path", "block", "__level").agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("seq"))).alias("__last"))
    ahead = Window.partitionBy("path", "__level").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("path", "block", "__level", F.last("__last", ignorenulls=True).over(ahead).alias("__carried"))
    here = F.last("__p", ignorenulls=True).over(Window.partitionBy("path", "block", "__level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    told = every.withColumn("__here", here).where("__asks").join(carried, ["path", "block", "__level"])
    told = told.select("path", "block", "seq", F.coalesce("__here", "__carried").alias(out))
    return rows.join(told, ["path", "block", "seq"], "left").drop("__delta", "__depth")


def xml_nodes_split(spark: SparkSession, path: str) -> DataFrame:
    """S3, large dumps: the rows of ``xml_nodes`` without one task per file. Files are
    read in byte ranges (``spark.sql.files.maxPartitionBytes``), tag by tag; depths and
    numbers are prefix sums over ranges, and what is open where a range begins is the last
    element opened at each level before it.

    Files with comments, CDATA, a document type, processing instructions, namespaces,
    character references or a '>' that ends no tag are left to ``xml_nodes``."""
    raw = spark.read.option("lineSep", ">").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    at = F.instr("value", "<")
    body = F.when(at > 0, F.substring(F.col("value"), at + 1, F.length("value"))).otherwise("")
    rows = raw.select("path", "block", "seq", F.regexp_replace(F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value")), "\r\n?", "\n").alias("before"), body.alias("body"), (at > 0).alias("is_tag"))
    b = F.col("body")
    rest = F.regexp_replace(b, _ATTRIBUTE, "")
    head = F.startswith(b, F.lit("?xml "))
    odd = F.startswith(b, F.lit("!")) | (F.startswith(b, F.lit("?")) & ~head) | F.regexp_like(rest, F.lit("[\"':<]")) | F.regexp_like(b, F.lit("(^|\\s)xmlns|&#")) | F.contains("before", F.lit("&#")) | (~F.col("is_tag") & F.regexp_like("before", F.lit("\\S")))
    kind = F.when(head | ~F.col("is_tag"), "none").when(F.startswith(b, F.lit("/")), "close").when(F.endswith(b, F.lit("/")), "single").otherwise("open")
    values = F.transform(F.regexp_extract_all(b, F.lit(_ATTRIBUTE), F.lit(2)), lambda v: _unescaped(F.translate(F.substring(v, F.lit(2), F.length(v) - 2), "\t\n\r", "   ")))
    attrs = F.map_from_arrays(F.regexp_extract_all(b, F.lit(_ATTRIBUTE), F.lit(1)), values)
    parsed = rows.select(
        "path", "block", "seq", kind.alias("kind"), F.regexp_extract(b, "^/?([^\\s/]+)", 1).alias("tag"), F.when(kind.isin("open", "single"), attrs).alias("attrs"), _unescaped(F.col("before")).alias("before"), odd.alias("odd")
    )
    events = materialize(parsed, "xml-tags")
    odd_files = materialize(events.where("odd").select("path").distinct(), "xml-odd")
    is_odd = not odd_files.isEmpty()
    plain = events.drop("odd").where("kind <> 'none'")
    plain = plain.join(odd_files, "path", "left_anti").select(*plain.columns) if is_odd else plain
    # the text of an element is what stands before the next tag
    first = plain.groupBy("path", "block").agg(F.min_by("before", "seq").alias("__first"))
    next_ = first.select("path", "block", F.lead("__first").over(Window.partitionBy("path").orderBy("block")).alias("__next"))
    plain = plain.withColumn("__after", F.lead("before").over(Window.partitionBy("path", "block").orderBy("seq"))).join(next_, ["path", "block"])
    text = F.regexp_replace(F.when(F.col("kind") == "open", F.coalesce("__after", "__next")).otherwise(""), r"(?U)^\s+|\s+$", "")
    is_node = F.col("kind").isin("open", "single")
    delta = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = plain.select("path", "block", "seq", "kind", "tag", "attrs", F.coalesce(text, F.lit("")).alias("text"), F.try_element_at("attrs", F.lit("id")).alias("own_id"))
    rows = _before(rows, is_node.cast("long"), "node_id")
    rows = materialize(_innermost(rows, delta, F.struct("node_id", "own_id"), "top"), "xml-parents")
    has_id = F.when(F.col("kind") == "close", F.col("top.own_id").isNotNull()).otherwise(F.col("own_id").isNotNull())
    rows = _innermost(rows, F.when(has_id, delta).otherwise(0), F.col("own_id"), "scope_id").where(is_node)
    out = rows.select("path", "node_id", F.col("top.node_id").alias("parent_node_id"), "scope_id", "tag", "attrs", "text")
    return out.unionByName(xml_nodes(spark, path, only=odd_files)) if is_odd else out


def child_text(nodes: DataFrame, parents: DataFrame, tag: str, name: str) -> DataFrame:
    """``parents`` (path, node_id, ...) with the text of their first child ``tag``."""
    kids = nodes.where(F.col("tag") == tag).groupBy("path", F.col("parent_node_id").alias("node_id")).agg(F.min_by("text", "node_id").alias(name))
    return parents.join(kids, ["path", "node_id"], "left")


# Elements of a dump that are symbols, and the kind of each.
XML_KINDS = {
    "namespace": "namespace", "class": "record", "struct": "record", "union": "record", "function": "function", "enum": "enum", "enum-constant": "enum-constant",
    "typedef": "typedef", "variable": "variable", "friend": "friend", "using": "using", "namespace-alias": "namespace-alias", "concept": "concept", "guide": "guide",
}


def symbols_from_xml(nodes: DataFrame) -> dict[str, DataFrame]:
    """``symbols``, ``params``, ``locations`` and ``doc_blocks`` of XML node rows."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in XML_KINDS.items() for x in kv]), F.col("tag"))
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    own = nodes.where(F.col("tag").isin(*XML_KINDS) & a("id").isNotNull())
    symbols = own.select(
        a("id").alias("id"), F.col("scope_id").alias("parent_id"), kind.alias("kind"), F.coalesce(a("name"), F.lit("")).alias("name"), a("access").alias("access"),
        F.coalesce(a("is-inline") == "1", F.lit(False)).alias("is_inline"), F.coalesce(a("is-anonymous") == "1", F.lit(False)).alias("is_anonymous"), "path", "node_id",
    )
    key = symbols.select("path", F.col("node_id").alias("parent_node_id"), F.col("id").alias("symbol_id"))
    part = lambda tag: nodes.where(F.col("tag") == tag).join(key, ["path", "parent_node_id"])
    w = Window.partitionBy("symbol_id").orderBy("node_id")
    types = nodes.where("tag = 'type'").select("path", F.col("parent_node_id").alias("node_id"), F.try_element_at("attrs", F.lit("name")).alias("type_text"))
    params = part("param").select("path", "node_id", F.col("symbol_id").alias("func_id"), "symbol_id", F.coalesce(a("name"), F.lit("")).alias("name")).withColumn("pos", F.row_number().over(w) - 1)
    params = params.join(types, ["path", "node_id"], "left").select("func_id", "pos", "name", "type_text")
    locations = part("file").select("symbol_id", F.coalesce(a("class") == "def", F.lit(False)).alias("is_def"), a("short-path").alias("short_path"), a("source-path").alias("source_path"), a("line").cast("int").alias("line"))
    docs = part("doc").select("path", F.col("node_id").alias("parent_node_id"), "symbol_id")
    blocks = nodes.join(docs, ["path", "parent_node_id"]).select("symbol_id", F.col("node_id").alias("pos"), F.col("tag").alias("kind"), a("name").alias("name"), a("class").alias("direction"), F.col("text").alias("literal"))
    return {"symbols": symbols.drop("path", "node_id"), "params": params, "locations": locations, "doc_blocks": blocks}
