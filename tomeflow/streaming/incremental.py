"""Streaming operators: incremental corpus merge (R1), first-seen rows (R2).

The merged corpus is a versioned state, cut in hash buckets of its keys. A batch
reads, merges and rewrites only the buckets that its keys fall in; a small manifest
per batch says which version of each bucket is current, and is written last. Nothing
is changed in place, so a replayed batch starts from the same predecessor and a batch
that failed half way leaves no trace in the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

Merge = Callable[[DataFrame], DataFrame]

#: Buckets of a new corpus: many, so that a batch touches few bytes; their number
#: bounds a manifest.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest(folder: str, batch_id: int) -> str:
    return f"{folder.rstrip('/')}/manifest/{batch_id:010d}"


def _bucket(folder: str, version: int, bucket: int) -> str:
    return f"{folder.rstrip('/')}/data/v={version:010d}/bucket={bucket}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose manifest is complete, oldest first."""
    fs, root = _fs(spark, f"{folder.rstrip('/')}/manifest")
    if not fs.exists(root):
        return []
    whole = [f.getPath() for f in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in whole)


def manifest(spark: SparkSession, folder: str, batch_id: int) -> tuple[int, dict[int, int]]:
    """(buckets, current version of each bucket that has rows) after a batch."""
    rows = spark.read.parquet(_manifest(folder, batch_id)).collect()  # a row for each bucket
    return rows[0]["buckets"], {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}


def _write_manifest(spark: SparkSession, folder: str, batch_id: int, buckets: int, current: dict[int, int]) -> None:
    rows = [(buckets, b, v) for b, v in sorted(current.items())] or [(buckets, None, None)]
    spark.createDataFrame(rows, "buckets int, bucket int, version long").coalesce(1).write.mode("overwrite").parquet(_manifest(folder, batch_id))


def _read(spark: SparkSession, folder: str, current: dict[int, int], buckets: list[int]) -> DataFrame | None:
    paths = [_bucket(folder, current[b], b) for b in buckets if b in current]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def corpus(spark: SparkSession, folder: str, batch_id: int | None = None) -> DataFrame:
    """The merged corpus after a batch (the last complete one by default)."""
    known = versions(spark, folder)
    at = known[-1] if batch_id is None else batch_id
    _, current = manifest(spark, folder, at)
    found = _read(spark, folder, current, sorted(current))
    if found is None:
        raise ValueError(f"{folder}: no rows were merged yet")
    return found


def merge_batch(folder: str, merge: Merge, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch's rows join those of the buckets that
    its ``keys`` fall in, and the merged buckets become their version ``batch_id``. The
    predecessor is the last complete batch before this one. ``buckets`` is that of the
    first batch; later ones keep it (see ``rebucket``)."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, folder) if v < batch_id]
        n, current = manifest(spark, folder, before[-1]) if before else (buckets, {})
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        batch = batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # n numbers at most
            if touched:
                old = _read(spark, folder, current, touched)
                rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
                out = merge(rows).withColumn("bucket", bucket)
                out.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.rstrip('/')}/data/v={batch_id:010d}")
        finally:
            batch.unpersist()
        _write_manifest(spark, folder, batch_id, n, current | dict.fromkeys(touched, batch_id))

    return one


def rebucket(spark: SparkSession, folder: str, keys: list[str], buckets: int, batch_id: int) -> None:
    """Deal the whole corpus to another number of buckets, as version ``batch_id``."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    out = corpus(spark, folder).withColumn("bucket", bucket)
    out.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.rstrip('/')}/data/v={batch_id:010d}")
    found = [r[0] for r in out.select("bucket").distinct().collect()]
    _write_manifest(spark, folder, batch_id, buckets, dict.fromkeys(found, batch_id))


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete manifests but the last ``keep``, and bucket versions that none of those
    names; returns how many bucket folders went."""
    known = versions(spark, folder)
    used = {_bucket(folder, v, b) for at in known[-keep:] for b, v in manifest(spark, folder, at)[1].items()}
    for at in known[:-keep]:
        fs, p = _fs(spark, _manifest(folder, at))
        fs.delete(p, True)
    fs, root = _fs(spark, f"{folder.rstrip('/')}/data")
    gone = 0
    for version in fs.listStatus(root) if fs.exists(root) else []:
        if int(version.getPath().getName()[2:]) > known[-1]:
            continue  # of a batch that is still being written
        for part in fs.listStatus(version.getPath()):
            name = part.getPath().getName()
            if name.startswith("bucket=") and _bucket(folder, int(version.getPath().getName()[2:]), int(name[7:])) not in used:
                fs.delete(part.getPath(), True)
                gone += 1
    return gone


def incremental_merge(stream: DataFrame, folder: str, checkpoint: str, merge: Merge, keys: list[str], buckets: int = BUCKETS) -> DataStreamWriter:
    """R1 as a writer: ``merge`` reduces rows of old corpus and batch to one per key
    (it must be idempotent, like the first-wins merge of ``operators.merge``)."""
    return stream.writeStream.foreachBatch(merge_batch(folder, merge, keys, buckets)).option("checkpointLocation", checkpoint)


def first_seen(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """R2: each key once, when first seen. With a (time column, delay) watermark the
    state is bounded: a key is forgotten once the watermark has passed it."""
    if watermark is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
