"""Neighbours, archives, classifier, pipeline and entry points."""

import hashlib
import io
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tomeflow.llm import common, neighbours, quality, queries, warc

SF = "/root/testdata/sf0.001"


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score double, rank int, id long, v string")


def row(i, v):
    return (i, v, 0.0, 0, 5, "x")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:760] = x[5]  # a hot vector
    data = [row(i, v.tolist()) for i, v in enumerate(x)]
    odd = [row(2000, None), row(2100, [0.0] * 32), row(2200, [float("nan")] * 32), row(2300, [1.0, None] + [0.0] * 30), row(2400, []), row(2500, [float("inf")] + [0.0] * 31), row(None, x[0].tolist()), row(0, x[0].tolist())]
    df = vectors(spark, data + odd)
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0"), block=400, query_block=7).collect()
    d = x.astype(np.float64)
    hits = total = 0
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(found) == list(range(0, 1500, 100))
    for q, rows in found.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 11)) and q not in {r[2] for r in rows}
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(d)), dist)) if i != q][:10]
        hits += len({r[2] for r in rows} & set(want))
        total += 10
        assert all(np.isclose(s, dist[i], rtol=1e-12) for _, s, i in rows)
        assert [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)
    assert hits / total >= 0.9
    hot = [r[2] for r in sorted(found[700])]
    assert hot == [5, 701, 702, 703, 704, 705, 706, 707, 708, 709]


def test_few_vectors(spark):
    df = vectors(spark, [row(0, [1.0, 0.0]), row(1, [0.0, 1.0]), row(100, [1.0, 0.0, 0.0])])
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]
    none = vectors(spark, [])
    assert neighbours.nearest(none, none).count() == 0


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3", None), (4, None, ""), (5, "u\r\nX: y", "é" * 30_000), (None, "http://n", "<p>x</p>"), (7, "http://a/7", "only\r\n\r\nme"), (2, "http://a/2b", "<p>x</p>")]


def pages(spark, data=PAGES):
    return spark.createDataFrame([(*r, "k", 0) for r in data], "page_id long, url string, html string, record_type string, refers_to long")


def test_archive_round_trip(spark):
    got = warc.page_round_trip(spark, pages(spark)).collect()
    best = {}
    for i, _, h in PAGES:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = best[h or ""] != i
        want[(i, len(b), warc.payload_digest(b), "revisit" if revisit else "response", best[h or ""] if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.page_round_trip(spark, pages(spark, [])).count() == 0


def test_small_payloads_are_never_revisits(spark):
    got = warc.page_records(pages(spark), least=100).where("record_type = 'revisit'")
    assert got.count() == 0


def test_archives_roll_and_payloads_survive(spark):
    data = [(i, f"u{i}", f"<p>{hashlib.sha256(str(i).encode()).hexdigest() * 50}</p>") for i in range(60)]
    manifest = warc.write_archives(warc.page_records(pages(spark, data)), common.fresh_path(spark, "wacz"), roll=2000)
    assert manifest.count() > 5 and manifest.groupBy().sum("records").first()[0] == 60
    back = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest).collect()}
    assert back == {f"urn:page:{i}": h for i, _, h in data}


def test_central_directory_with_zip64():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr(zipfile.ZipInfo("packed"), b"z" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("b", b"world")
    body = raw.getvalue()
    want = {"a": b"hello", "b": b"world"}

    def check(data):
        f = io.BytesIO(data)
        got = warc.central_directory(f, len(data))
        assert {k: data[o : o + n] for k, (o, n) in got.items()} == want

    check(body)
    # the same archive with ZIP64 end records and a ZIP64 extra field for its first entry
    end = body.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<HII", body[end + 10 : end + 20])
    cd = body[start : start + length]
    n, m = struct.unpack("<HH", cd[28:32])
    size, = struct.unpack("<I", cd[24:28])
    extra = struct.pack("<HHQQQ", 1, 24, size, size, 0)
    first = cd[:20] + b"\xff" * 8 + struct.pack("<HH", n, len(extra)) + cd[32:42] + b"\xff" * 4 + cd[46 : 46 + n] + extra
    cd = first + cd[46 + n + m :]
    at = start + len(cd)
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(cd), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    check(body[:start] + cd + record + locator + tail)
    with pytest.raises(ValueError):
        warc.central_directory(io.BytesIO(b"no zip"), 6)


def test_classifier_on_held_out_rows(spark):
    got = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (held.predicted == held.quality).mean() > 0.97
    assert (both[both.quality == 1].predicted == 1).mean() > 0.98


def test_classifier_edges(spark):
    d = spark.createDataFrame([(1, "Good text here."), (2, None), (None, ""), (3, "x" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(d, none)
    assert quality.score(d, model).where("quality_score between 0 and 1").count() == 4
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(d, quality.train(d, one)).where("quality_score > 0.3").count() == 4
    assert quality.score(d.limit(0), model).count() == 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, len(quality.FEATURES)))
    y = (x[:, 3] - x[:, 7] + 0.3 * rng.standard_normal(2000) > -1).astype(int)
    m = quality.fit(x, y)
    p = m.score(x)
    assert ((p >= 0.3) == (y == 1)).mean() > 0.93 and m.weights[3] > 0 > m.weights[7]
    assert abs((p < 0.3).mean() - (y == 0).mean()) < 0.002


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input; the run on the smallest tables."""
    import test_dedup as brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    good = common.materialize(stages["quality classifier"](spark, d, SF), "t")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(labels[i] != (i in kept) for i in labels) <= 0.03 * len(labels) and good.columns == docs.columns
    exact = common.materialize(stages["exact dedup"](spark, good, SF), "t")
    texts = {}
    for r in good.collect():
        k = brute.lower(r["text"]) if hasattr(brute, "lower") else (r["text"] or "").encode().translate(brute.LOWER)
        texts[k] = min(texts.get(k, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(texts.values()) and exact.columns == docs.columns
    near = common.materialize(stages["MinHash near-dedup"](spark, exact, SF), "t")
    want = brute.near_truth([(r["doc_id"], r["text"]) for r in exact.collect()], 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(k[0] for k in want if k[3]) and near.columns == docs.columns
    mixed = common.materialize(stages["mixing sources to target weights"](spark, near, SF), "t")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    packed = stages["best-fit packing"](spark, mixed, SF)
    first = packed.where("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in first} == {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()


def test_pipeline_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, "A good text. " * 20, "en", "s", 1), (1, "A good text. " * 20, "en", "s", 1), (2, None, None, None, None), (None, "", "en", None, 0), (3, "z " * 30_000, "en", "s", 1)], schema)
    for data in (odd, odd.limit(0)):
        d = data
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = common.materialize(stage(spark, d, SF), "odd")
            assert d.columns == data.columns
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() >= 0


def test_exact_dedup_matches_its_sql(spark):
    import sys

    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    from compare import assert_same, connect

    assert_same(queries.op3_exact_dedup(spark, SF), connect(SF), queries.ORACLE["op3_exact_dedup"])


def test_ten_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_neighbours_of_extreme_magnitudes(spark):
    rows = [(0, [1e200, 0.0]), (1, [1.1e200, 0.0]), (2, [1e200, 3e199]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (5, [1.0, 1.0]), (6, [1e308, -1e308]), (7, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(df, df, k=10).collect()}
    assert out[0, 1] == (1, pytest.approx(1e199)) and out[0, 2] == (2, pytest.approx(3e199))
    assert out[3, 1] == (4, pytest.approx(2e-200)) and out[3, 2] == (5, pytest.approx(2**0.5))
    assert out[6, 7][0] == 7 and out[6, 7][1] == float("inf")


def test_weights_are_those_of_plain_gradient_descent():
    """The fit's pairs, by plain descent with momentum instead of Newton steps."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] - 0.7 * x[:, 3] + rng.normal(size=400) > 0).astype(int)
    model = quality.fit(x, y, pairs=5000, seed=3)
    z = np.clip((x - np.array(model.mean)) / np.array(model.scale), -8, 8)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), 5000)] - z[draw.choice(np.flatnonzero(y == 0), 5000)]
    w, speed = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for _ in range(6000):
        gradient = -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 1e-3 * w
        speed = 0.9 * speed - 0.1 * gradient
        w = w + speed
    assert np.abs(gradient).max() < 1e-8
    assert np.allclose(w, model.weights, atol=1e-5)
