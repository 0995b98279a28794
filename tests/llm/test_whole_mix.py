"""Mixing of rows whose id is null or repeated."""

import math

import numpy as np
from pyspark.sql import functions as F

from tomeflow.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_rows_of_null_and_repeated_ids_have_their_own_draws(spark):
    rows = [(None, f"text number {k:04d}", "a") for k in range(1500)] + [(7, f"text number {k:04d}", "a") for k in range(1500)]
    rows += [(None, "text number same", "a")] * 1500 + [(k + 100, f"text number {k:04d}", "a") for k in range(1500)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.poisson_counts(d, volume=0.5).collect()
    groups = {"null": lambda r: r["doc_id"] is None and "same" not in r["text"], "seven": lambda r: r["doc_id"] == 7, "copies": lambda r: "same" in r["text"], "unique": lambda r: (r["doc_id"] or 0) >= 100}
    for mine in groups.values():
        counts = [r["__count"] for r in got if mine(r)]
        assert len(counts) == 1500 and abs(sum(counts) / 1500 - 0.5) < 0.08
        assert abs(counts.count(0) / 1500 - mixing.expected_share(0.5, 0)) < 0.05
    mixed = mixing.poisson_mix(d, volume=0.5).collect()
    assert len(mixed) == sum(r["__count"] for r in got) == mixing.mix_report(d, volume=0.5).count()
    assert len({r["mix_key"] for r in mixed}) == len(mixed)


def test_inverse_of_the_distribution():
    u = np.array([6e-17, 1e-12, 0.1, 0.3, 0.5, 0.9, 0.999, 1 - 1e-12])
    for rate in (0.0, 0.01, 0.7, 1.0, 5.5, 40.0, 300.0):
        terms, k = [math.exp(-rate)], 0
        while k < rate + 60 * math.sqrt(rate + 1):
            k += 1
            terms.append(terms[-1] * rate / k)
        want = [next((k for k in range(len(terms)) if math.fsum(terms[: k + 1]) > x), len(terms)) for x in u]
        got = mixing.poisson_inverse(rate, u)
        assert got[:-1].tolist() == want[:-1] and abs(int(got[-1]) - want[-1]) <= 1
    draws = np.random.default_rng(1).random(4000)
    for rate in (1e4, 1e6, 1e9):
        got = mixing.poisson_inverse(rate, draws)
        assert abs(got.mean() - rate) < 5 * math.sqrt(rate / 4000) and 0.9 < got.var() / rate < 1.1


def test_very_high_rates_end(spark):
    d = spark.createDataFrame([(1, "a" * 10, "x"), (2, "b" * 10, "x")], DOCS)
    mixed = mixing.poisson_mix(d, volume=1e6)
    n, last = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mix_copy").alias("last")).select("n", "last").first()
    assert abs(n - 1e6) < 6e3 and last == n - 1
    # far more copies than an array could hold are counted, not made
    assert mixing.poisson_counts(d, volume=1e12).agg(F.min("__count")).first()[0] > 9e11


def test_columns_of_the_mix_names_stay(spark):
    d = spark.createDataFrame([(1, "text", "a", "mine", 7)], DOCS + ", mix_copy string, mix_key int")
    got = mixing.poisson_mix(d, volume=8.0).collect()
    assert got and all(r["mix_copy"] == "mine" and r["mix_key"] == 7 for r in got)
    assert sorted(r["mix_copy_"] for r in got) == list(range(len(got))) and len({r["mix_key_"] for r in got}) == len(got)


def test_map_columns_and_repeated_rows_are_mixed(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k % 40}", f"s{k % 3}") for k in range(120)], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "map('k', doc_id) as tags", "array(named_struct('m', map(1, text))) as deep")
    assert mixing.poisson_mix(docs, volume=3.0).columns == [*docs.columns, "mix_copy", "mix_key"]
    drawn = {tuple(r) for r in mixing.poisson_counts(docs, volume=3.0).select("doc_id", "__own", "__count").collect()}
    assert len(drawn) == 120 and len({r[2] for r in drawn if r[0] == 7}) >= 1
    assert mixing.mix_report(docs.limit(0)).count() == 0
