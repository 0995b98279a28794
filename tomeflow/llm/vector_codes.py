"""Vector code compression: product codes from exact Ball k-means.

A vector is cut in equal parts; each part position has a codebook, found by Lloyd's
rounds in exact integers. An assignment round treats an entry and the parts that it
holds as a ball: only entries within twice the ball's radius are its neighbours. A
part nearer to its entry than half the way to the nearest neighbour is in the stable
core and stays without another distance; of the others, the ring between half the
ways to the k-th and the next neighbour has k candidates. Both bounds are strict in
integers, so results are Lloyd's to the last digit, ties included. Balls of entries
that did not move, nor their neighbours, keep their parts.

Each round is one pass that writes codes and partial sums of its tasks; a codebook
(entries x width integers, whatever the input's size) is all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import BROADCAST_KEYS, discard, materialize, small_batches

#: Magnitudes up to this one have sums and distances in 64 bits; others use Python's integers.
SMALL = 1 << 24
#: Bits of a limb, so that sums of any magnitude add up as 64-bit numbers.
LIMB = 30
_LONG = (1 << 63) - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; int64 where that is small, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))  # exact, as the scale is a power of two
    if y.size == 0 or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    return np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def books_array(books: list) -> np.ndarray:
    """(parts, entries, width) of nested lists of integers."""
    a = np.array(books, object)
    return a.astype(np.int64) if a.size == 0 or max(abs(int(v)) for v in a.ravel()) < SMALL else a


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(-1)


def ball_assign(x: np.ndarray, home: np.ndarray, entries: np.ndarray, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest of ``entries`` to each row of ``x``, the
    lower index of equally near ones; ``home`` is any entry of each row, at best the
    last round's. If ``moved`` tells which entries changed since a round that gave
    ``home``, rows whose ball and neighbours did not change are not searched."""
    wide = x.dtype == object or entries.dtype == object
    x, entries = (x.astype(object), entries.astype(object)) if wide else (x, entries)
    best, least = home.astype(np.int64), squares(x, entries[home])
    apart = squares(entries[:, None], entries[None, :])
    for i in np.unique(home):
        rows = np.flatnonzero(home == i)
        d = least[rows]
        near = np.array([j for j in range(len(entries)) if j != i and apart[i, j] <= 4 * d.max()], np.int64)
        if not near.size or (moved is not None and not moved[i] and not moved[near].any()):
            continue
        near = near[np.argsort(apart[i, near], kind="stable")]
        way = apart[i, near]
        # candidates of a row: entries no further from its own than twice the row is
        reach = np.searchsorted(way, 4 * d, side="right")
        for t in range(int(reach.max())):
            ring = rows[reach > t]
            j = near[t]
            e = squares(x[ring], entries[j])
            closer = (e < least[ring]) | ((e == least[ring]) & (j < best[ring]))
            best[ring[closer]], least[ring[closer]] = j, e[closer]
    return best, least


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and has neither null nor non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vec_col).cast("array<double>")
    return vectors.where(v.isNotNull() & F.forall(v, good))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists, padded with zeros to ``width``."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _limbs(sums: np.ndarray) -> list[list[int]]:
    """Integers as rows of limbs: sums[k] = limbs[0][k] + limbs[1][k] << LIMB + ..."""
    left, out = [int(s) for s in sums], []
    while True:
        if all(abs(s) < 1 << 46 for s in left):
            return [*out, left]
        out.append([s & ((1 << LIMB) - 1) for s in left])
        left = [s >> LIMB for s in left]


STATE = "id long, label {label}, v array<double>, code binary, error decimal(38,0), part int, entry int, n long, limb int, sums array<long>"


def _round(state: DataFrame, schema: str, books: list, before: list | None, parts: int, scale: int) -> DataFrame:
    """Assign anew: rows with their code and error, and rows with each task's sums by
    (part, entry)."""
    width = len(books[0][0])
    label_type = state.schema["label"].dataType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = books_array(books)
        entries = table.shape[1]
        moved = None if before is None else np.array([[books[p][e] != before[p][e] for e in range(entries)] for p in range(parts)])
        sums = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        kinds = None
        for b in batches:
            kinds = b.schema
            if not b.num_rows:
                continue
            x = scaled(_matrix(b.column("v"), parts * width), scale).reshape(-1, parts, width)
            home = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            code, error = np.empty_like(home), np.zeros(len(x), object)
            for p in range(parts):
                best, d = ball_assign(x[:, p], home[:, p], table[p], None if moved is None else moved[p])
                code[:, p] = best
                error = error + d.astype(object)
                counts[p] += np.bincount(best, minlength=entries)
                for e in np.unique(best):
                    sums[p, e] = sums[p, e] + x[best == e, p].sum(0).astype(object)
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
            codes = [r.tobytes() for r in code.astype(np.uint8)]
            # errors beyond a long are given as the largest long
            errors = pa.array([min(int(e), _LONG) for e in error], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), pa.array(codes, pa.binary()), errors, *none], names=names)
        rows = [(p, e, int(counts[p, e]) if k == 0 else 0, k, limb) for p in range(parts) for e in range(entries) if counts[p, e] for k, limb in enumerate(_limbs(sums[p, e]))]
        if rows:
            none = [pa.nulls(len(rows), kinds.field(c).type) for c in ("id", "label", "v")]
            cols = list(zip(*rows))
            given = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.decimal128(38, 0)), *given], names=names)

    names = ["id", "label", "v", "code", "error", "part", "entry", "n", "limb", "sums"]
    return state.select("id", "label", "v", "code").mapInArrow(assign, schema.format(label=label_type.simpleString()))


def _updated(state: DataFrame, books: list) -> list:
    """Entries replaced by their parts' floored means; unused ones stay."""
    each = state.where("part is not null").select("part", "entry", "n", "limb", F.posexplode("sums").alias("dim", "s"))
    total = each.groupBy("part", "entry", "limb", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = [[list(e) for e in book] for book in books]
    sums: dict[tuple, dict[int, int]] = {}
    count: dict[tuple, int] = {}
    for r in total.collect():  # at most parts x entries x width x limbs numbers
        of = sums.setdefault((r.part, r.entry), {})
        of[r.dim] = of.get(r.dim, 0) + (r.s << (LIMB * r.limb))
        count[r.part, r.entry] = max(count.get((r.part, r.entry), 0), r.n)
    for (p, e), of in sums.items():
        out[p][e] = [of[k] // count[p, e] for k in range(len(out[p][e]))]
    return out


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, list]:
    """((id, label, code, error), codebooks): ``code`` has an entry's number (a byte)
    for each part, ``error`` is the squared distance in components floor(scale * x),
    at most the largest long. ``scale`` is a power of two, ``entries`` at most 256.

    Rows whose vector is null or has a null or non-finite component are left out.
    Codebooks start as the parts of the smallest ids (null ids last, ties by vector);
    fewer rows give fewer entries. Vectors shorter than the widest, or of a width that
    ``parts`` does not divide, are filled up with zeros. Repeated rows count each; a
    table without rows gives none and empty codebooks. ``label_col`` None means no
    label; other columns are ignored."""
    small_batches(vectors.sparkSession, 4096)
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    state = materialize(kept.withColumn("code", F.lit(bytes(parts))), "vectors")
    widest = state.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // parts)
    first = state.select("id", "v").orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect()
    rows = [scaled(np.array([*r.v, *[0.0] * (parts * width - len(r.v))]), scale).reshape(parts, width).tolist() for r in first]
    books = [[r[p] for r in rows] for p in range(parts)]
    if not rows:
        return state.select("id", "label", "code", F.lit(0).cast("long").alias("error")), books
    before = None
    for _ in range(rounds):
        last, state = state, materialize(_round(state.where("code is not null"), STATE, books, before, parts, scale), "codes")
        discard(last)
        before, books = books, _updated(state, books)
    last, state = state, materialize(_round(state.where("code is not null"), STATE, books, before, parts, scale), "codes")
    discard(last)
    return state.where("code is not null").select("id", "label", "code", F.col("error").cast("long").alias("error")), books


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes as hexadecimal, errors
    summed over equal labels (null labels together, a sum beyond a long is the largest
    one) and the hash of all entries' decimal components."""
    rows, books = compress(vectors, parts, entries, rounds, scale, id_col, vec_col, label_col)
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("__l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = materialize(sums, "label-errors")
    few = sums.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    joined = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__l")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
