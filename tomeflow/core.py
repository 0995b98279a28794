"""Session helpers: shared folders, materialised steps and fixpoint loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only where unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tomeflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tomeflow/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it (no lineage)."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tomeflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tomeflow_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_iter: int = 1000, tag: str = "fixpoint") -> list[DataFrame]:
    """Frontiers seed, step(seed), step(step(seed)), ... until one is empty. Each is
    written to the shared folder, so that plans stay short and a lost executor
    costs one round. Cyclic data must be ended by ``step``: more than ``max_iter``
    rounds raise, nothing is cut off."""
    out = [materialize(seed, tag)]
    while True:
        nxt = materialize(step(out[-1]), tag)
        if nxt.isEmpty():
            return out
        if len(out) > max_iter:
            raise RuntimeError(f"{tag}: more than {max_iter} rounds (cyclic data?)")
        out.append(nxt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str, out: str = "place") -> DataFrame:
    """``table`` with the place of each row in the input, (file, row), as ``out``."""
    return table(spark, sf_dir, name).withColumn(out, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


#: Rows that one task of a ``spread`` table gets, about.
SPREAD_ROWS = 1 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as its counted rows ask for, so
    that what a task holds of them stays the same however large the table is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // SPREAD_ROWS)), *keys)
