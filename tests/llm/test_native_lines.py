"""Line dedup in column functions alone, its keys, and pairs of lines that share many lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import line_dedup, linking


def lines(spark, texts):
    return line_dedup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")


def text(rng, n):
    return "".join(chr(97 + c) for c in rng.integers(0, 26, n))


def test_lines_are_linked_without_python(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", refuse)
    monkeypatch.setattr(F, "pandas_udf", refuse)
    stem = text(np.random.default_rng(3), 60)
    df = spark.createDataFrame([(k, stem + x) for k, x in enumerate(("", "a", "ab", "cdefghijklmnopqrstuvwxyz0123456789"))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_doc_id"] for r in line_dedup.line_dedup(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize(("n", "i", "missed"), [(9, 8, 0), (18, 16, 0), (36, 32, 0), (45, 40, 1), (150, 134, 1)])
def test_pairs_at_the_threshold_share_a_key(spark, n, i, missed):
    """Runs of sets of up to ``SHORT`` miss no pair of similarity 0.8; longer ones hardly any."""
    rng = np.random.default_rng(n)
    both = []
    for _ in range(2000):
        stem = text(rng, i + 7)
        both += [stem + text(rng, n - i), stem + text(rng, n - i).upper()]
    keys = line_dedup.keyed_lines(lines(spark, both), 8).select(F.expr("first.doc_id div 2").alias("pair"), "node", "key")
    met = keys.groupBy("pair", "key").agg(F.count_distinct("node").alias("c")).where("c = 2").select("pair").distinct().count()
    assert met >= 2000 - missed


def test_sets_and_bitmaps_in_columns(spark):
    rng = np.random.default_rng(5)
    texts = ["a", "short", "12345678", "a" * 30, "\U0001f600" * 9 + "x", "ab" * 4] + ["".join(rng.choice(list("abc \U0001f600é"), int(rng.integers(1, 60)))) + "z" for _ in range(200)]
    want = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in texts]
    each = spark.createDataFrame([(k, len(want[k]), s) for k, s in enumerate(texts)], "node long, n long, line string")
    got = {r["node"]: set(r["s"]) for r in each.select("node", line_dedup.shingle_hashes("line", 8).alias("s")).collect()}
    bits = {r["node"]: sum((r[w] & (1 << 64) - 1) << 64 * k for k, w in enumerate(line_dedup.WORD_NAMES)) for r in line_dedup.bitmaps(each, 8).collect()}
    for x, y in zip(range(len(texts)), range(1, len(texts))):
        assert len(got[x]) == len(want[x]) and len(got[x] & got[y]) == len(want[x] & want[y])
        assert (bits[x] ^ bits[y]).bit_count() <= len(want[x] ^ want[y]) and 0 < bits[x].bit_count() <= len(want[x])


def test_a_pair_meets_in_one_of_its_lists(spark, monkeypatch):
    mixed = spark.createDataFrame([(key, node, node, 1) for key in range(20) for node in (1, 2, 3)], "key long, node long, comp long, major long")
    seen, frame = [], type(mixed)
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: seen.append(df.count()) or distinct(df))
    n = spark.createDataFrame([(1,), (2,), (3,)], "node long").withColumn("n", F.lit(1))
    pairs = linking.cross_pairs(mixed, lambda keys: keys.join(n, "node"), lambda x, y: F.col(f"{x}.n") == F.col(f"{y}.n"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)] and seen[-1] == 3
