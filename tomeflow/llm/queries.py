"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import exact_dedup, line_dedup, mixing, near_dedup, neighbours, oracles, packing, pii, quality, sharding, spelling, suffix_dedup, vector_codes, warc
from tomeflow.llm.common import read_table

#: Fixed by the contract of op8: labels are learnt where this remainder is not 0.
HELD_OUT = 5
#: Bound of the classifier's training sample, in rows.
TRAINING_ROWS = 12_000


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"), threshold=0.8, width=8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    pieces = packing.token_pieces(
        read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, limit=2048, eos=0
    )
    return packing.best_fit_pack(pieces, 2048)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read_table(spark, sf_dir, "documents"), threshold=85)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(spark, read_table(spark, sf_dir, "pages"), least=0)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), TRAINING_ROWS, where=lambda i: ~held_out(i))
    scored = quality.score(docs, model, out="score")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), width=100)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_exact_dedup, op4_sharding, op5_near_dedup, op6_neighbours, op7_warc, op8_quality_classifier, op9_suffix_dedup, op10_mixing, op11_spelling_variants, op12_pii, op13_vector_codes)
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": oracles.EXACT, "op5_near_dedup": oracles.NEAR, "op7_warc": oracles.ARCHIVE, "op9_suffix_dedup": oracles.REPEATS,
    "op11_spelling_variants": oracles.SPELLING, "op13_vector_codes": oracles.codes(),
}
