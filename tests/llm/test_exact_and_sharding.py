"""Exact dedup, sharding, mixing and packing against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomeflow.llm import common, exact_dedup, mixing, packing, sharding

DOCS = "doc_id long, text string, source string, lang string, n_chars long, kept string, shard int, id long"


def docs(spark, data):
    """Rows (id, text, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, s, "en", 1, "x", 9, 7) for i, t, s in data], DOCS)


EDGE = [
    (1, "Same Text", "a"), (2, "same text", "a"), (5, "SAME TEXT", None), (5, "SAME TEXT", None), (3, "", "b"), (4, None, "b"), (6, "x" * 50_000, "a"), (7, "x" * 50_000 + "y", "a"), (None, "same text", "c"), (None, "alone", "c"), (8, "É same", "a"), (9, "é same", "a"), (9, "other", "a"),
]


def lower(t):
    return (t or "").encode().translate(exact_dedup.LOWER)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [48 << 20, 1000])
def test_exact_dedup(spark, keep, budget):
    got = exact_dedup.exact_dedup(docs(spark, EDGE), keep=keep, budget=budget).collect()
    groups = defaultdict(list)
    for i, t, _ in EDGE:
        groups[lower(t)].append(i)
    pick = min if keep == "smallest" else max
    want = Counter()
    for i, t, _ in EDGE:
        g = groups[lower(t)]
        ids = [x for x in g if x is not None]
        want[(i, pick(ids) if ids else None, len(g), hashlib.sha256(lower(t)).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(k).hexdigest(): 1 for k in groups})


def test_trie_spills_and_merges():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(0, 40)).tolist()) for _ in range(3000)]
    small, want = exact_dedup.PatriciaTrie(budget=5000), {}
    for k, w in enumerate(words):
        small.insert(w, k, 1)
        b, n = want.get(w, (k, 0))
        want[w] = (min(b, k), n + 1)
    got = list(small.entries())
    assert [g[0] for g in got] == sorted(want) and {g[0]: g[1:] for g in got} == want


def test_sharding_law(spark):
    data = [(i % 500 if i else None, ["t", "", None][i % 3], "a") for i in range(2000)]
    got = sharding.shard_documents(docs(spark, data), 40).collect()
    assert len(got) == 2000
    by_key, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_sharding_balance_and_confined_movement(spark):
    keys = spark.range(40_000)
    tree = sharding.topology(40)
    heavier = [(r, k, s, 3.0 if s == 12 else w) for r, k, s, w in tree]
    got = sharding.assign(sharding.assign(keys, ["id"], tree, "a"), ["id"], heavier, "b").groupBy("a", "b").count().collect()
    size = Counter()
    for r in got:
        size[r["a"]] += r["count"]
        assert r["a"] == r["b"] or r["b"] // 10 == 1  # only into the changed region
    assert min(size.values()) > 850 and max(size.values()) < 1150
    third = sharding.assign(keys, ["id"], [(r, k, s, 0.0 if s == 3 else w) for r, k, s, w in tree], "c").where("c = 3")
    assert third.isEmpty()


def test_poisson_mix(spark):
    data = [(i, "x" * (i % 50), "big" if i % 3 else f"s{i % 4}") for i in range(6000)]
    d = docs(spark, data)
    got = mixing.mix_report(d).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    size = Counter()
    for _, t, s in data:
        size[s] += len(t) + 16
    total, mass = sum(size.values()), Counter()
    text = {i: t for i, t, _ in data}
    for r in got:
        want = total / len(size) / size[r["source"]]
        assert math.isclose(r["rate"], want, abs_tol=1e-8)
        mass[r["source"]] += len(text[r["doc_id"]]) + 16
    assert all(abs(m / total - 1 / len(size)) < 0.02 for m in mass.values())
    counts = Counter(r["n_copies"] for r in got if r["copy"] == 0 and r["source"] == "s0")
    n, rate = sum(s == "s0" for _, _, s in data), total / len(size) / size["s0"]
    for k in (1, 2):
        assert abs(counts[k] / n - mixing.expected_share(rate, k)) < 0.05
    mixed = mixing.poisson_mix(d)
    assert mixed.count() == len(got) and mixed.columns[: len(d.columns)] == d.columns


def test_poisson_counts_by_brute_force(spark):
    data = [(i, "abc", f"s{i % 3}") for i in range(300)] + [(None, None, None), (5, "abc", "s2")]
    got = mixing.poisson_counts(docs(spark, data), weights={"s0": 3.0, "s1": 1.0, None: 1.0}).withColumn("u", common.uniform("doc_id", seed=23)).collect()
    for r in got:
        c, k, p = 0.0, 0, math.exp(-r["__rate"])
        while r["__rate"] and (c := c + p) <= r["u"]:
            k += 1
            p *= r["__rate"] / k
        assert r["__count"] == k
        assert r["__rate"] == 0 or r["source"] != "s2"


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "of", "the", "<|endoftext|>", "naïve", "\n", "  "]
    data = [(i, " ".join(rng.choice(words, int(n))), "a") for i, n in enumerate(rng.integers(0, 900, 120))] + [(200, None, "a"), (201, "", "a"), (202, "word " * 9000, "a"), (202, "twice", "a"), (202, "twice", "a"), (None, "no id", "b")]
    pieces = packing.token_pieces(docs(spark, data), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = packing.best_fit_pack(pieces, 2048, per_group=40).collect()
    tok, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for i, t, _ in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (s, e) in enumerate(zip(at, at[1:])):
            want[(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 2


def test_local_search_empties_bins():
    sizes = np.array([6, 4, 5, 5, 3, 7, 2, 8])
    bins, fill = [[0], [1], [2], [3], [4, 5], [6, 7]], [6, 4, 5, 5, 10, 10]
    before = sum(f * f for f in fill)
    packing.local_search(bins, fill, sizes, 10, 100)
    assert sum(1 for b in bins if b) == 4 and sum(f * f for f in fill) > before
    assert all(sum(sizes[b]) == f <= 10 for b, f in zip(bins, fill)) and sorted(i for b in bins for i in b) == list(range(8))


def test_exchanges_keep_items():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 100, 60)
        where = packing.pack(sizes, 100)
        least = max(math.ceil(sizes.sum() / 100), int((sizes > 50).sum()))
        assert all(sizes[where == b].sum() <= 100 for b in set(where)) and len(set(where)) <= least + 3


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and sharding.shard_documents(none).count() == 0 and mixing.mix_report(none).count() == 0 and mixing.poisson_mix(none).count() == 0
    pieces = spark.createDataFrame([], packing.PIECE)
    assert packing.best_fit_pack(pieces).count() == 0


def test_components_both_ways(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = common.union_find((a, b) for a, b in pairs if a != b)
    for way in ({"native": True}, {"task_links": 10}, {}):
        assert {r["node"]: r["root"] for r in common.components(df, **way).collect()} == want
