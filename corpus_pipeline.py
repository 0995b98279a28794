"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's ``docs``. All but the last return the
columns of ``documents``. Null texts count as empty, repeated rows are dropped
by the exact stage, null ids are handled as one more id; an empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import exact_dedup, mixing, near_dedup, packing, quality
from tomeflow.llm.common import materialize, read_table
from tomeflow.llm.mixing import free_name

#: Bound of the classifier's training sample, in rows.
TRAINING_ROWS = 12_000


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents the pairwise-ranking classifier accepts (score >= 0.3)."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), TRAINING_ROWS)
    out = free_name(docs, "__score")
    return quality.score(docs, model, out=out).where(F.col(out) >= 0.3).select(docs.columns)


def _one_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by kept (doc_id, text_sha256); one of repeated rows."""
    sha = free_name(docs, "__sha")
    keyed = docs.withColumn(sha, exact_dedup.text_digest("text")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{sha}") == F.col("k.text_sha256"))
    found = keyed.join(kept.select("doc_id", "text_sha256").distinct().alias("k"), on, "left_semi")
    return found.dropDuplicates(["doc_id", sha]).select(docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts, the smallest id."""
    return _one_of(docs, exact_dedup.exact_dedup(docs, keep="smallest").where("kept"))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies, the smallest id (a null
    id only where there is no other, then the smallest hash). Rows are told apart by
    a hash of id and text, so null and repeated ids are rows like others; one of
    rows repeated whole is kept. Blank texts are near to nothing."""
    key = free_name(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_dedup.near_dedup(keyed.select(key, "text"), threshold=80, id_col=key).select(key, "component_id").distinct()
    named = found.join(keyed.select(key, "doc_id").distinct(), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    kept = first.select(F.col(f"first.{key}").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson-replicate documents so that sources get equal shares of the bytes."""
    return mixing.poisson_mix(docs).select(docs.columns)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of at most 2048 tokens."""
    import public_tokenizers as P

    return packing.best_fit_pack(packing.token_pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


STAGES = [
    ("quality classifier", stage_quality),
    ("exact dedup", stage_exact),
    ("MinHash near-dedup", stage_near),
    ("mixing sources to target weights", stage_mix),
    ("best-fit packing", stage_pack),
]

#: Tokenising, MinHash linking and a trained model have no SQL form; the stages
#: are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
