"""Passages that very many documents have: what their sort costs, and that all of it is done."""

import hashlib

import numpy as np
import pytest

from tomeflow.llm import suffix_dedup

WIDTH, GRAM = 100, 24


def texts(n, seed=5):
    """Documents that share a line between words of their own; some are copies."""
    rng = np.random.default_rng(seed)
    words = lambda k: "".join(rng.choice(list("abcdefgh é"), k))
    line = words(140)
    rows = [(i, words(int(rng.integers(0, 200))) + line + words(int(rng.integers(0, 200)))) for i in range(n)]
    return rows + [(n + i, t + words(5)) for i, t in rows[:10]] + [(2 * n, None), (2 * n + 1, line[:99]), (2 * n + 2, line * 3)]


def truth(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - WIDTH + 1):
            s = b[p : p + WIDTH]
            if s in seen:
                gone[p : p + WIDTH] = b"\1" * WIDTH
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_only_strings_whose_hash_repeats_are_sorted(monkeypatch):
    bodies = [t.encode() for _, t in texts(300) if t]
    h, doc, at, anchor, first, count = suffix_dedup.anchors(bodies, WIDTH, GRAM)
    asked, sort = [], suffix_dedup.mergesort
    monkeypatch.setattr(suffix_dedup, "mergesort", lambda h, x, cls, width: asked.append(len(x)) or sort(h, x, cls, width))
    key = suffix_dedup.mix(h.of(anchor, anchor + GRAM))
    gone = suffix_dedup.repeated(h, key, anchor - first, first, count, WIDTH)
    seen = {}
    for b in bodies:
        for p in range(len(b) - WIDTH + 1):
            s = b[p : p + WIDTH]
            seen[s] = seen.get(s, 0) + 1
    assert gone.sum() == sum(n - 1 for n in seen.values())
    assert sum(asked) == sum(n for n in seen.values() if n > 1)


def test_runs_of_a_frequent_anchor_are_dealt_over_many():
    rows = [(i, t.encode()) for i, t in texts(300) if t]
    body = {(i, 0): b for i, b in rows}
    ids = np.array([i for i, _ in rows])
    h, doc, at, anchor, first, count = suffix_dedup.anchors([b for _, b in rows], WIDTH, GRAM)
    key = suffix_dedup.mix(h.of(anchor, anchor + GRAM))
    fields = [key, ids[doc], np.zeros(len(doc), np.uint64), first - at, (anchor - first).astype(np.uint8), count.astype(np.uint8)]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)

    def strings(fields):
        """(hash, document, place, offset) of each string."""
        return [(k, d, f + j, o - j) for k, d, _, f, o, c in zip(*(x.tolist() for x in fields)) for j in range(c)]

    whole = strings(fields)
    parts = strings(suffix_dedup.split_hot(fields, times[back].astype(np.uint32), body, WIDTH, GRAM, 8))
    assert sorted((d, p, o) for _, d, p, o in parts) == sorted((d, p, o) for _, d, p, o in whole)
    meet = {}
    for k, d, p, o in parts:
        assert meet.setdefault(body[d, 0][p : p + WIDTH], (k, o)) == (k, o)
    distinct = lambda each: max(np.unique([k for k, _ in {(k, body[d, 0][p : p + WIDTH]) for k, d, p, _ in each}], return_counts=True)[1])
    assert distinct(parts) * 8 < distinct(whole)


@pytest.mark.parametrize("hot", [4, 60, 4096])
def test_frequent_passages_are_removed_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "_HELD", 5000)
    monkeypatch.setattr(suffix_dedup, "_STRINGS", 700)
    rows = texts(150)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WIDTH, per_bucket=9000, hot=hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == truth(rows)


def test_pieces_between_buckets_grow_no_faster_than_the_table():
    """Each task writes to each bucket; the product is what a large table pays for."""
    pieces = lambda size: -(-size // suffix_dedup._HELD) * suffix_dedup.bucket_count(size, 4 << 20)
    assert pieces(8 << 30) <= 8 * pieces(1 << 30)
    assert suffix_dedup.bucket_count(100 << 20, 4 << 20) == 25 and suffix_dedup.bucket_count(0, 4 << 20) == 8
    assert suffix_dedup.bucket_count(100 << 30, 4 << 20) * (32 << 20) >= 100 << 30
