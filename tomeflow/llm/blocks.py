"""Members of candidate lists compared block by block, in numpy.

A list's members outside its largest component are dealt to left blocks, all of its
members to right blocks, and a cell is one left block with one right block. So any
pair that can still be linked meets in one cell, no task holds more than two
blocks of a list, and a cell gives at most as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, about.
BLOCK = 2048
#: Left members that are compared at a time.
STEP = 32
CELL = ["key", "i", "r"]
_PAD = np.iinfo(np.int64).max


def cells(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, r, left, right, minor, comp, node) of ``mixed`` (key, node, comp,
    major): in which cells a member takes part, and on which sides."""
    minor = F.col("comp") != F.col("major")
    long = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("__c"), F.count_if(minor).alias("__m")).where(F.col("__c") > block)
    parts = lambda c: F.coalesce(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    dealt = mixed.join(long, "key", "left").select("key", "comp", "node", minor.alias("minor"), parts("__m").alias("nl"), parts("__c").alias("nr"))
    dealt = dealt.withColumns({"i0": place(1, F.col("nl")), "r0": place(2, F.col("nr"))})
    cell = lambda i, r, left, right: F.struct(i.alias("i"), r.alias("r"), left.alias("left"), right.alias("right"))
    till = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    row = F.transform(till("nr"), lambda r: cell(F.col("i0"), r, F.lit(True), r == F.col("r0")))
    column = F.transform(F.filter(till("nl"), lambda i: ~F.col("minor") | (i != F.col("i0"))), lambda i: cell(i, F.col("r0"), F.lit(False), F.lit(True)))
    every = F.when(F.col("minor"), F.concat(row, column)).otherwise(column)
    return dealt.select("key", F.explode(every).alias("c"), "minor", "comp", "node").select("key", "c.*", "minor", "comp", "node")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in CELL], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if held and tuple(keys[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[s])
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


class Lists:
    """A list column: values end to end, with the place and length of each row's."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        whole = column.combine_chunks()
        self.size = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = whole.flatten().to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.size) - self.size

    def __getitem__(self, x: int) -> np.ndarray:
        return self.flat[self.at[x] : self.at[x] + self.size[x]]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, starts) of some rows that have values."""
        size = self.size[rows]
        starts = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(self.at[rows] - starts, size)], starts

    def hits(self, x: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, starts, which of them row ``x``, sorted, has too)."""
        own, (values, starts) = self[x], self.of(rows)
        at = own.searchsorted(values)
        at[at == len(own)] = 0
        return values, starts, own[at] == values

    def padded(self, width: int) -> np.ndarray:
        out = np.full((len(self.size), width), _PAD)
        out[np.arange(width) < self.size[:, None]] = self.flat
        return out


class Comparer:
    """Links within a cell: rows with key, left, right, minor, comp, node, n, keys (the
    lists of the member), bits (bitmap of its set), set (null if it is long) and
    sketch (its ``k`` smallest values; null if no long set can be near)."""

    def __init__(self, threshold: int, k: int) -> None:
        self.threshold, self.k = threshold, k

    def __call__(self, cell: pa.Table) -> Iterator[tuple[int, int, bool]]:
        """(a, b, sure): true links of members in different components, as many as
        join them, and pairs of long sets that their sketches allow."""
        get = lambda c: cell.column(c).to_numpy()
        self.n, node, minor, comp = get("n"), get("node"), get("minor"), get("comp")
        left, right = np.flatnonzero(get("left")), np.flatnonzero(get("right"))
        if not len(left) or not len(right):
            return
        t, key = self.threshold, cell.column("key")[0].as_py()
        bits = Lists(cell.column("bits")).flat.reshape(len(node), -1).view(np.uint64)
        keys, sets = Lists(cell.column("keys")), Lists(cell.column("set"))
        sketch = None
        other, their, after = bits[right], self.n[right], ~minor[right]
        for s in range(0, len(left), STEP):
            rows = left[s : s + STEP]
            own = self.n[rows][:, None]
            # bitmaps differ in no more bits than sets in elements
            apart = np.bitwise_count(bits[rows][:, None] ^ other[None]).sum(-1, dtype=np.int64)
            ok = (apart * (100 + t) <= (own + their) * (100 - t)) & (np.minimum(own, their) * 100 >= np.maximum(own, their) * t)
            ok &= after | (node[rows][:, None] < node[right])
            ok &= comp[rows][:, None] != comp[right]
            for x in rows[ok.any(1)]:
                met = right[ok[np.searchsorted(rows, x)]]
                met = met[comp[met] != comp[x]]
                if len(met):
                    # each pair is settled where its first common list is
                    values, starts, hit = keys.hits(x, met)
                    met = met[np.minimum.reduceat(np.where(hit, values, _PAD), starts) == key]
                whole = (sets.size[met] > 0) & (sets.size[x] > 0)
                for y in self.exact(x, met[whole], sets):
                    if comp[y] != comp[x]:
                        yield min(node[x], node[y]), max(node[x], node[y]), True
                        comp = np.where(comp == comp[y], comp[x], comp)
                met = met[~whole]
                if len(met):
                    if sketch is None:
                        sketch = Lists(cell.column("sketch"))
                        wide = sketch.padded(self.k)
                    for y in met[self.likely(x, met, sketch.size, wide)]:
                        yield min(node[x], node[y]), max(node[x], node[y]), False

    def exact(self, x: int, met: np.ndarray, sets: Lists) -> np.ndarray:
        if not len(met):
            return met
        _, starts, hit = sets.hits(x, met)
        both = np.add.reduceat(hit.astype(np.int64), starts)
        return met[both * 100 >= (self.n[x] + self.n[met] - both) * self.threshold]

    def likely(self, x: int, met: np.ndarray, size: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Whether the k smallest values of the union allow the threshold: exact for
        a whole union, else 4.5 standard deviations are granted."""
        share, k = self.threshold / 100, self.k
        margin = np.where(np.maximum(self.n[x], self.n[met]) * 2 <= k, 0.0, 4.5 * (share * (1 - share) / k) ** 0.5)
        values = np.sort(np.concatenate([np.broadcast_to(wide[x], (len(met), k)), wide[met]], 1), 1)
        twice = (values[:, 1:] == values[:, :-1]) & (values[:, 1:] != _PAD)
        rank = 1 + np.cumsum(~twice, 1)
        shared = twice.sum(1)
        union = np.minimum(k, size[x] + size[met] - shared)
        found = (twice & (rank <= k)).sum(1) / union
        return (shared >= (share - margin) * np.maximum(size[x], size[met])) & (found >= share - margin)


def compared(rows: DataFrame, threshold: int, k: int) -> DataFrame:
    """(a, b, sure) of the members of cells (columns of ``Comparer``)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = Comparer(threshold, k)
        out: list[tuple[int, int, bool]] = []
        for cell in runs(batches):
            for pair in compare(cell):
                out.append(pair)
                if len(out) == 10_000:
                    yield _pairs(out)
                    out = []
        yield _pairs(out)

    dealt = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(of, "a long, b long, sure boolean")


def _pairs(found: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, sure = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])
