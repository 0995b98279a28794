"""Sources, sinks, streams and helpers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tomeflow.sources import readers, writers
from tomeflow.streaming import incremental
from tomeflow.udf import Helpers


def test_scan_files(spark, tmp_path):
    for name in ("a.hpp", "b.txt", "sub/c.hpp", "out/d.hpp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = readers.scan_files(spark, [str(tmp_path)], patterns=["*.hpp"], exclude=[f"{tmp_path}/out"]).collect()
    assert sorted(r["text"] for r in got) == ["a.hpp", "sub/c.hpp"]


def test_compile_commands(spark, tmp_path):
    entries = [{"directory": "/w", "file": "a.cpp", "command": "1"}, {"directory": "/w", "file": "./a.cpp", "command": "2"}, {"directory": "/w", "file": "/x/b.h", "command": "3"}, {"directory": "/w", "file": "c.py", "command": "4"}]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    got = readers.scan_compile_commands(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r["path"], r["command"]) for r in got) == [("/w/a.cpp", "1"), ("/x/b.h", "3")]


XML = """<mrx><namespace name="" id="G"><struct name="S" id="1"><file short-path="s.h" source-path="s.h" line="3" class="def"/>
<function name="f" access="public" id="2"><file short-path="s.h" source-path="s.h" line="4"/><return><type name="void"/></return>
<param name="x"><type name="int"/></param><param><type name="char"/></param><doc><brief>Does it.</brief><param name="x">An x</param></doc></function></struct></namespace></mrx>"""


def test_xml_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    t = readers.symbols_from_xml(readers.xml_nodes(spark, str(tmp_path / "d.xml")))
    assert sorted((r["id"], r["parent_id"], r["kind"], r["name"]) for r in t["symbols"].collect()) == [("1", "G", "record", "S"), ("2", "1", "function", "f"), ("G", None, "namespace", "")]
    assert sorted((r["pos"], r["name"], r["type_text"]) for r in t["params"].collect()) == [(0, "x", "int"), (1, "", "char")]
    assert sorted((r["symbol_id"], r["is_def"], r["line"]) for r in t["locations"].collect()) == [("1", True, 3), ("2", False, 4)]
    assert {(r["kind"], r["literal"]) for r in t["doc_blocks"].collect()} == {("brief", "Does it."), ("param", "An x")}


def node_rows(df):
    return sorted((r["path"].rsplit("/", 1)[-1], r["node_id"], r["parent_node_id"], r["scope_id"], r["tag"], tuple(sorted(r["attrs"].items())), r["text"]) for r in df.collect())


def test_split_dumps_equal_whole_ones(spark, tmp_path):
    """Ranges of three thousand bytes, so that most elements stay open across ranges."""
    rng = random.Random(6)

    def element(depth):
        attrs = "".join(f" {k}={q}{v}{q}" for k, v, q in (("id", rng.randrange(1000), '"'), ("name", "a &lt;b&gt; \n é", "'"), ("x", "1 &amp;amp; 2", '"')) if rng.random() < 0.4)
        tag = rng.choice(["namespace", "struct", "function", "é"])
        if depth > 7 or rng.random() < 0.2:
            return f"<{tag}{attrs}/>" if rng.random() < 0.7 else f"<{tag}{attrs} ></{tag} >"
        inside = "".join(rng.choice(["", "\n  ", " text &amp; é "]) + element(depth + 1) for _ in range(rng.randint(0, 4)))
        return f"<{tag}{attrs}>{rng.choice(['', ' lead &quot;', chr(10)])}{inside} tail </{tag}>"

    for k in range(3):
        (tmp_path / f"{k}.xml").write_text("<?xml version='1.0'?>\n<mrx>" + "\n".join(element(0) for _ in range(25)) + "</mrx>\n")
    (tmp_path / "odd.xml").write_text("<a id='1'><!-- <b> --><c>x > y</c><![CDATA[<z>]]><d v='p>q'/>&#65;</a>")
    (tmp_path / "dump.xml").write_text(XML)
    whole = node_rows(readers.xml_nodes(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        split = node_rows(readers.xml_nodes_split(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == whole and len(whole) > 100


def test_single_page_keeps_order(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("page")).repartition(7)
    writers.write_single_page(pages, str(tmp_path / "p"), "idx")
    lines = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [str(k) for k in range(500)]


def test_page_files(spark, tmp_path):
    pages = spark.createDataFrame([("/a/b.html", "x"), ("/c.html", "yy")], "url string, page string")
    sizes = {r["url"]: r["bytes"] for r in writers.write_page_files(pages, f"file://{tmp_path}").collect()}
    assert sizes == {"/a/b.html": 1, "/c.html": 2} and (tmp_path / "a/b.html").read_text() == "x"


def test_batches_rewrite_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    one = incremental.merge_batch(folder, lambda df: df.groupBy("k").agg(F.min("v").alias("v")), ["k"], buckets=16)
    written = lambda v: sum(f.stat().st_size for f in (tmp_path / f"corpus/data/v={v:010d}").rglob("*.parquet"))
    got = lambda at=None: sorted((r["k"], r["v"]) for r in incremental.corpus(spark, folder, at).collect())
    start = [(f"k{k:05d}", 5) for k in range(20_000)]
    one(spark.createDataFrame(start, "k string, v int"), 0)
    for _ in range(2):  # a replay starts from the same predecessor
        one(spark.createDataFrame([("k00000", 1), ("new", 7)], "k string, v int"), 1)
        assert got() == sorted([("k00000", 1), ("new", 7), *start[1:]]) and got(0) == start
    assert written(1) < written(0) / 4
    one(spark.createDataFrame([], "k string, v int"), 2)
    assert incremental.versions(spark, folder) == [0, 1, 2] and got(2) == got(1)
    assert incremental.vacuum(spark, folder, keep=1) <= 2 and got() == sorted([("k00000", 1), ("new", 7), *start[1:]])
    incremental.rebucket(spark, folder, ["k"], 4, 3)
    one(spark.createDataFrame([("k00001", 0)], "k string, v int"), 4)
    assert incremental.manifest(spark, folder, 4)[0] == 4 and got() == sorted([("k00000", 1), ("k00001", 0), ("new", 7), *start[2:]])


def test_helpers(spark, tmp_path):
    (tmp_path / "shout.py").write_text("RETURN_TYPE = 'string'\nVECTORIZED = False\ndef helper(x):\n    return x.upper() + '!'\n")
    h = Helpers(spark)
    assert h.load(str(tmp_path)) == ["shout"]
    assert spark.range(1).select(h.call("shout", F.lit("a"))).first()[0] == "A!"
    assert spark.range(1).select(h.call("missing", F.lit("a"))).first()[0] is None
    with pytest.raises(KeyError):
        h.call("missing", F.lit("a"), F.lit("b"))
    h.unregister("shout")
    assert "shout" not in h.known
