"""Vector codes against plain Lloyd rounds in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tomeflow.llm import vector_codes
from tomeflow.llm.vector_codes import ball_assign


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    ints = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[k], p) for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in ints]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(ints, got) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    top = (1 << 63) - 1
    error = [min(sum(d for d, _ in c), top) for c in got]
    by = {}
    for (_, _, lab), e in zip(kept, error):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in c), e, min(by[lab], top), sha) for (i, _, lab), c, e in zip(kept, got, error)), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = [tuple(r) for r in vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_codes_match_plain_rounds(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32))
    rows = [(i, (centers[rng.integers(20)] + 0.1 * rng.normal(size=32)).tolist(), int(rng.integers(5)) if i % 7 else None) for i in range(300)]
    check(spark, rows)


def test_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) / 4096 for x in rng.integers(-2, 3, 16)], 1) for i in range(120)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (7, None, 1), (8, [float("nan")] * 16, 1), (9, [None] * 16, 1), (10, [float("inf")] * 16, 1), (11, [], 2), (12, [0.5] * 5, 2)]
    check(spark, rows)


def test_huge_components(spark):
    rows = [(i, [(-1) ** i * (i + 1) * 1e200, 1e-300, *[float(i)] * 14], i % 2) for i in range(24)]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(5, [1.0] * 8, None), (3, [2.0] * 8, None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code int, error string, v int")
    out = vector_codes.vector_codes(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("seed", range(4))
def test_ball_rounds_equal_full_search(seed):
    """From any home, and from the last round's with entries that did not move."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-20, 20, (500, 3))
    entries = rng.integers(-20, 20, (16, 3))
    entries[7] = entries[2]

    def full(c):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    got = ball_assign(x, rng.integers(0, 16, 500), entries)
    assert (got[0] == full(entries)[0]).all() and (got[1] == full(entries)[1]).all()
    later = entries.copy()
    later[[1, 5]] += 3
    again = ball_assign(x, got[0], later, (later != entries).any(1))
    assert (again[0] == full(later)[0]).all() and (again[1] == full(later)[1]).all()
