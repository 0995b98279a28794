"""Ids that are repeated, null or contradictory."""

import numpy as np
from pyspark.sql import functions as F

from tomeflow.llm import exact_dedup, neighbours, quality

DOCS = "doc_id long, text string, source string"


def test_ids_with_several_vectors_occur_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [5.0, 5.0]), (1, [1.0, 0.1]), (2, [0.1, 1.2]), (3, [-1.0, 0.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(v, v.where("vec_id = 0"), k=10).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    x = {i: [np.array(e, np.float32).astype(float) for j, e in rows if j == i] for i in (0, 1, 2, 3)}
    for r in got:
        assert r["score"] == min(np.sqrt(((a - b) ** 2).sum()) for a in x[0] for b in x[r["vec_id"]])


def test_one_of_repeated_rows_is_kept(spark):
    rows = [(None, "Hot", "a")] * 500 + [(7, "other", "a")] * 3 + [(8, "OTHER", "b"), (9, "hot", "b")] + [(9, "hot", "b")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), keep="largest").collect()
    assert sorted((r["doc_id"], r["text_sha256"][:4], r["group_size"]) for r in got if r["kept"]) == sorted((r["doc_id"], r["text_sha256"][:4], n) for r, n in [(next(x for x in got if x["doc_id"] == 8), 4), (next(x for x in got if x["doc_id"] == 9), 502)])
    nulls = exact_dedup.exact_dedup(spark.createDataFrame([(None, "x", "a")] * 300 + [(None, "y", "a")], DOCS)).collect()
    assert sum(r["kept"] for r in nulls) == 2 and len(nulls) == 301
    assert exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).where("kept").agg(F.min("doc_id"), F.max("doc_id")).first() == (7, 9)


def test_contradictory_labels_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "Good text here.", "a")] * 50 + [(1, "Another text.", "a"), (2, "!!! x", "a"), (3, None, "a"), (4, "fine words", "a")], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    x, y = quality.training_sample(docs, labels, 100)
    assert len(x) == 3 and sorted(y.tolist()) == [0, 0, 1]
    again = quality.training_sample(docs.repartition(3), labels.repartition(2), 100)
    assert (again[0] == x).all() and (again[1] == y).all()
    assert len(quality.training_sample(docs, labels, 2)[0]) == 2
