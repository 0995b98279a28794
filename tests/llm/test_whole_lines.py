"""Cases in which an operator once did less than the whole job."""

import numpy as np

from tomeflow.llm import line_dedup

DOCS = "doc_id long, text string, source string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, "s") for i, t in data], DOCS)


def kept_lines(spark, data):
    return {r["doc_id"] for r in line_dedup.line_dedup(docs(spark, data)).collect() if r["kept"]}


def test_lines_of_rare_characters_are_read_to_the_end(spark):
    faces = lambda start: "".join(chr(0x1F300 + start + k) for k in range(40))
    rows = [(1, faces(0) + faces(100)), (2, faces(0) + faces(200)), (3, faces(300) + "x"), (4, faces(300)), (5, faces(0) + "a" * 40)]
    assert kept_lines(spark, rows) == {1, 2, 3, 5}


def test_rare_and_common_characters_share_shingles(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river to the old mill by noon"
    assert kept_lines(spark, [(1, base), (2, base + "\U0001f600")]) == {1}


def test_links_just_over_the_threshold_are_found(spark):
    rng = np.random.default_rng(11)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    rows = []
    for k in range(3000):  # 81 of 101 shingles shared: similarity 0.802
        stem = text(88)
        rows += [(2 * k, stem + text(10)), (2 * k + 1, stem + text(10))]
    assert kept_lines(spark, rows) == {2 * k for k in range(3000)}
