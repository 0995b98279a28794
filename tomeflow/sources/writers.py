"""Sinks: XML, tag index, pages, JSON, reports (S4-S10). All write by Spark's
distributed writers; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.operators.filters import REGULAR, SEE_BELOW


def write_xml(symbols: DataFrame, path: str, row_tag: str = "symbol") -> None:
    """One element per row; columns with a leading '_' are attributes, arrays of
    structs repeat child elements."""
    symbols.write.format("xml").option("rowTag", row_tag).option("rootTag", "symbols").mode("overwrite").save(path)


def arglist(params: Column) -> Column:
    """'(type name, ...)' of an array of (pos, type_text, name)."""
    one = lambda p: F.concat_ws(" ", p["type_text"], F.when(p["name"] != "", p["name"]))
    return F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(params), one), ", "), F.lit(")"))


def tag_index(symbols: DataFrame, params: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows (compound, kind, member_kind, type, name, anchorfile, anchor, arglist):
    a compound row for each class-like and for each namespace with a member that is
    no namespace; a member row for each of their functions."""
    u = urls.select(F.col("id").alias("__u"), "url", "anchor")
    visible = symbols.where(F.col("extraction").isin(REGULAR, SEE_BELOW)).join(u, F.col("id") == F.col("__u"))
    holders = visible.where("kind <> 'namespace'").select(F.col("parent_id").alias("__h")).distinct()
    spaces = visible.where("kind = 'namespace'").join(holders, F.col("id") == F.col("__h"), "left_semi")
    compounds = visible.where("kind = 'record'").unionByName(spaces)
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    heads = compounds.select(F.col("qualified_name").alias("compound"), "kind", *none("member_kind", "type"), F.col("qualified_name").alias("name"), F.col("url").alias("anchorfile"), *none("anchor", "arglist"))
    args = params.groupBy("func_id").agg(arglist(F.collect_list(F.struct("pos", "type_text", "name"))).alias("__args"))
    up = compounds.select(F.col("id").alias("__c"), F.col("qualified_name").alias("compound"), F.col("kind").alias("__ck"))
    functions = visible.where("kind = 'function'").join(up, F.col("parent_id") == F.col("__c")).join(args, F.col("id") == F.col("func_id"), "left")
    members = functions.select("compound", F.col("__ck").alias("kind"), F.lit("function").alias("member_kind"), F.col("return_type").alias("type"), "name", F.col("url").alias("anchorfile"), "anchor", F.coalesce("__args", F.lit("()")).alias("arglist"))
    return heads.unionByName(members)


def write_pages(pages: DataFrame, path: str, url: str = "url", text: str = "page", files: int = 200) -> None:
    """Pages as Parquet rows (url, page) bucketed by URL hash: one row per
    document, so a million pages are not a million files."""
    bucket = F.pmod(F.xxhash64(url), F.lit(files))
    pages.select(F.col(url).alias("url"), F.col(text).alias("page"), bucket.alias("bucket")).repartition(files, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def write_page_files(pages: DataFrame, folder: str, url: str = "url", text: str = "page") -> DataFrame:
    """S6, one object per page: each task writes its pages under ``folder`` (any URI
    that pyarrow reads); returns (url, bytes). A retried task writes the same files."""
    import pyarrow as pa

    def write(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{root.rstrip('/')}/{u.lstrip('/')}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(target) as f:
                    f.write(t.encode())
                sizes.append(len(t.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["url", "bytes"])

    return pages.select(F.col(url).alias("url"), F.coalesce(text, F.lit("")).alias("page")).mapInArrow(write, "url string, bytes long")


def single_page(pages: DataFrame, order: str, text: str = "page") -> DataFrame:
    """(value) rows in page order: range-partitioned and sorted, so concatenating
    the part files gives the page, whichever task ends first."""
    return pages.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.col(text).alias("value"))


def write_single_page(pages: DataFrame, path: str, order: str, text: str = "page") -> None:
    single_page(pages, order, text).write.mode("overwrite").text(path)


def wrap_pages(pages: DataFrame, header: Column, footer: Column, text: str = "page", embedded: bool = False) -> DataFrame:
    """Header and footer around each page; ``embedded`` leaves them out."""
    return pages if embedded else pages.withColumn(text, F.concat(header, F.col(text), footer))


def wrap_single(pages: DataFrame, header: str, footer: str, order: str, text: str = "page", embedded: bool = False) -> DataFrame:
    """S8 for a single page: header and footer rows before and after all others."""
    body = pages.select(F.lit(1).alias("part"), F.col(order).alias("idx"), F.col(text).alias("value"))
    if embedded:
        return body
    ends = pages.sparkSession.createDataFrame([(0, header), (2, footer)], "part int, value string")
    return body.unionByName(ends.select("part", F.lit(0).cast(body.schema["idx"].dataType).alias("idx"), "value"))


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(name))
