"""Near-duplicate, line and suffix dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomeflow.llm import line_dedup, near_dedup, suffix_dedup
from tomeflow.llm.exact_dedup import LOWER

DOCS = "doc_id long, text string, source string, kept boolean, component_id long, key long, node long, line string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, "s", True, 1, 2, 3, "x") for i, t in data], DOCS)


def corpus(seed=0, n=60):
    """Random texts, chains of edited copies, a hot group and a shared passage."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda m: list(rng.choice(vocabulary, m))
    out, passage = [], text(40)
    for _ in range(n):
        out.append(text(int(rng.integers(1, 120))))
        out.append(text(30) + passage)
    base = text(80)
    for _ in range(80):  # a hot group of near copies
        copy = list(base)
        for k in rng.choice(80, int(rng.integers(0, 3)), replace=False):
            copy[k] = f"e{rng.integers(1 << 30)}"
        out.append(copy)
    chain = text(100)
    for _ in range(15):  # each near the one before only
        chain = list(chain)
        chain[int(rng.integers(100))] = f"c{rng.integers(1 << 30)}"
        out.append(chain)
    rows = [(k, " ".join(t)) for k, t in enumerate(out)]
    rows += [(900, rows[5][1].upper()), (901, rows[5][1]), (902, ""), (903, None), (904, " \n"), (905, "one two"), (906, "ONE  two"), (907, "one two three"), (None, rows[7][1]), (910, rows[9][1]), (910, rows[9][1])]
    rng.shuffle(rows)
    return rows


def find(up, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def word_set(t, w=5):
    words = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[k : k + w]) for k in range(len(words) - w + 1)) if len(words) >= w else frozenset([tuple(words)] if words else [])


def near_truth(rows, threshold):
    sets = [word_set(t) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(up, i)].append(d)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        c = (min(least[find(up, i)]) if least[find(up, i)] else None) if sets[i] else d
        want[(d, len(sets[i]), c, d == c)] += 1
    return want


@pytest.mark.parametrize("threshold,whole", [(80, 192), (85, 0)])
def test_near_dedup(spark, threshold, whole):
    rows = corpus()
    got = near_dedup.near_dedup(docs(spark, rows), threshold, whole=whole).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == near_truth(rows, threshold)


def test_shingler_parts_agree():
    bodies = [t.encode() for t in ("a b c d e f", "", " x ", "a b c d e", "b c d e f g h")] * 3
    one = near_dedup.Shingler()
    together, apart = one(bodies), [one([b])[0] for b in bodies]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(together, apart)) and [len(x) for x in together[:5]] == [2, 0, 1, 1, 3]


def line_truth(rows, threshold, width):
    first, occurrences = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            occurrences.append((d, k, line))
            if line.strip(" "):
                at = ((d is not None, d or 0), k, d)
                first[line] = min(first.get(line, at), at)
    lines = list(first)
    sets = [{s[k : k + width] for k in range(max(1, len(s) - width + 1))} for s in lines]
    up = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    head = {}
    for i, s in enumerate(lines):
        head[find(up, i)] = min(head.get(find(up, i), first[s]), first[s])
    root = {s: head[find(up, i)] for i, s in enumerate(lines)}
    want = Counter()
    for d, k, line in occurrences:
        c = (root[line][2], root[line][1]) if line.strip(" ") else (d, k)
        want[(d, k, *c, c == (d, k))] += 1
    return want


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))
    base = [" ".join(word() for _ in range(int(rng.integers(1, 40)))) for _ in range(60)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            s = list(base[int(rng.integers(len(base)))])
            if rng.random() < 0.6:
                s[int(rng.integers(len(s)))] = "Q"
            lines.append("".join(s))
        rows.append((d, "\n".join([*lines, ""] if d % 9 == 0 else lines)))
    rows += [(500, None), (501, ""), (502, "   "), (503, "short"), (504, "short"), (505, "aaaaaaaaaaaa"), (506, "aaaaaaaaaaaaaaaaaaaaaaaa"), (507, "ünïcödé 🙂 line of some length"), (508, "ünïcödé 🙂 line of some lengthy"), (None, rows[0][1])]
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    have = Counter((r["doc_id"], r["line_no"], r["component_doc_id"], r["component_line_no"], r["kept"]) for r in got)
    want = line_truth(rows, 0.8, 8)
    assert have == want


def strip_truth(rows, width):
    seen, out = set(), Counter()
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        spots = []
        for s in range(len(b) - width + 1):
            x = b[s : s + width]
            (spots.append(s) if x in seen else seen.add(x))
        kept, last, spans, reach = [], 0, 0, -1
        for s in spots:
            if s > reach:
                kept.append(b[last:s])
                spans += 1
            reach = last = s + width
        left = b"".join([*kept, b[last:]])
        n = sum(r == (d, t) for r in rows)
        out[(d, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest(), left)] += n
    return out


@pytest.mark.parametrize("per_bucket", [4 << 20, 3000])
def test_suffix_dedup(spark, per_bucket):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé "), int(rng.integers(1, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    rows = []
    for d in range(80):
        parts = [text(int(rng.integers(0, 30)))]
        if d % 2:
            parts.append(passages[int(rng.integers(4))])
        if d % 7 == 0:
            parts += [passages[0][10:140]] * 2
        rows.append((d, " ".join([*parts, text(5)])))
    rows += [(200, rows[1][1]), (201, None), (202, ""), (203, "ab" * 400), (204, "z" * 99), (205, "z" * 300), (None, rows[3][1]), (206, text(12000)), (207, "dup row " * 30), (207, "dup row " * 30)]
    got = suffix_dedup.remove_repeats(docs(spark, rows), 100, per_bucket=per_bucket, keep_text=True).collect()
    have = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got)
    assert have == strip_truth(rows, 100)


def test_rows_of_one_id_are_apart(spark):
    rows = [(1, "x" * 150 + "a"), (1, "x" * 150 + "b"), (2, "y" * 10)]
    got = suffix_dedup.remove_repeats(docs(spark, rows), 100).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 149, 150]


def test_mergesort_sorts_suffixes():
    rng = np.random.default_rng(6)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    x = rng.integers(0, 2800, 700)
    cls = np.sort(rng.integers(0, 20, 700))
    order = suffix_dedup.mergesort(suffix_dedup.Hashes(buf), x, cls, 100)
    raw = buf.tobytes()
    keys = [(cls[i], raw[x[i] : x[i] + 100], i) for i in order]
    assert keys == sorted(keys)


def test_collisions_are_settled_by_bytes(monkeypatch):
    class Weak(suffix_dedup.Hashes):
        def of(self, start, end):  # every string of a length has one hash
            return (end - start).astype(np.uint64)

    buf = np.frombuffer(b"a" * 40 + b"b" * 40 + b"a" * 40 + b"\0" * 40, np.uint8)
    first, count = np.array([0, 40, 80]), np.array([1, 1, 1])
    gone = suffix_dedup.repeated(Weak(buf), np.zeros(3, np.uint64), np.zeros(3, np.int64), first, count, 32)
    assert gone.tolist() == [False, False, True]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert near_dedup.near_dedup(none).count() == 0 and line_dedup.line_dedup(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def test_shingle_sets_are_exact():
    rng = np.random.default_rng(8)
    texts = ["", "a", "short", "12345678", "a" * 30, "\U0001f600" * 9 + "x", "\x00" * 8, "ab" * 4] + ["".join(rng.choice(list("abc \U0001f600é"), int(rng.integers(1, 40)))) for _ in range(300)]
    want = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in texts]
    got = line_dedup.sets(texts, 8)
    assert [len(x) for x in got] == [len(x) for x in want]
    for k in range(1, len(texts)):
        assert len(np.intersect1d(got[k - 1], got[k])) == len(want[k - 1] & want[k])
    for width in (1, 2, 3, 5, 7):
        assert [len(x) for x in line_dedup.sets(texts, width)] == [len({s[i : i + width] for i in range(max(1, len(s) - width + 1))}) for s in texts]


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000))).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate((x[: int(rng.integers(len(x)))], y[:50])))
        p, q = line_dedup.bitmap(x).view(np.uint64), line_dedup.bitmap(y).view(np.uint64)
        assert sum(int(w).bit_count() for w in p ^ q) <= len(np.setxor1d(x, y))


def test_bands_meet_at_the_threshold():
    """Pairs of similarity 0.8 to 0.805 of every size share a band but for 5e-5."""
    rng = np.random.default_rng(21)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for n, i in ((9, 8), (18, 16), (45, 40), (150, 134)):
        stems = [text(i + 7) for _ in range(2500)]
        a, b = (line_dedup.bands([s + text(n - i) for s in stems], 8) for _ in range(2))
        assert (a == b).any(1).sum() >= 2499
