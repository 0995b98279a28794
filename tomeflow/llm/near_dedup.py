"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch holds the smallest hashes of its word-shingle set. Inverted
lists of the retained values that are rarest in the corpus yield candidates, the
union sketch estimates their similarity, and pairs near or over the threshold
are verified on full shingle sets. Equal sets are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.blocks import cells, compared
from tomeflow.llm.common import discard, materialize, mix, only, small_batches
from tomeflow.llm.exact_dedup import LOWER
from tomeflow.llm.line_dedup import bitmap
from tomeflow.llm.linking import link

#: Stands for a null id.
NULL = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = [mix(np.array([101 + j], np.uint64))[0] | np.uint64(1) for j in range(64)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Shingler:
    """Sets of ``width``-word shingles of lower-cased byte texts, as sorted arrays
    of signed 64-bit hashes. Fewer words than ``width`` make one shingle, none
    make an empty set."""

    def __init__(self, width: int = 5) -> None:
        self.width, self.up, self.down = width, _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def __call__(self, bodies: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
        if len(buf) >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(buf)), _powers(_INVERSE, 2 * len(buf))
        # word hashes from differences of a prefix polynomial
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=prefix[1:])
        white = _WHITE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        words = mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        # first word of each document
        at = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in bodies)]))
        w, n = self.width, len(words)
        full = np.zeros(max(0, n - w + 1), np.uint64)
        for j in range(w):
            full += words[j : n - w + 1 + j] * _PLACE[j] if n >= w else 0
        full = mix(full).view(np.int64)
        out = []
        for s, e in zip(at, at[1:]):
            if e - s >= w:
                out.append(np.unique(full[s : e - w + 1]))
            elif e > s:
                short = np.array([e - s], np.uint64)
                for j in range(e - s):
                    short = short + words[s + j : s + j + 1] * _PLACE[j + w]
                out.append(mix(short).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, lower-cased bodies) of about ``most`` bytes."""
    for b in batches:
        ids, bodies, held = [], [], 0
        for i, body in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            bodies.append(body.as_py().translate(LOWER))
            held += len(bodies[-1])
            if held >= most:
                yield ids, bodies
                ids, bodies, held = [], [], 0
        if ids:
            yield ids, bodies


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, for telling equal sets."""
    m = mix(s.view(np.uint64))
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(m + _BASE)).astype(np.int64)) if len(m) else 0


def sketches(docs: DataFrame, k: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, sketch): set size, fingerprint and k smallest hashes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for ids, bodies in _chunks(batches):
            sets = shingler(bodies)
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                 pa.array([p[1] for p in prints], pa.int64()), _lists([s[:k] for s in sets])],
                names=["id", "n", "f1", "f2", "sketch"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(of, "id long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """(node, set) of the classes ``wanted`` (node, min_id, f1, f2, n). With ``most``:
    (node, set, bits), a bitmap of each set, and no set of more elements than that."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for ids, bodies in _chunks(batches):
            sets = shingler(bodies)
            prints = [fingerprint(s) for s in sets]
            own = [pa.array(ids, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
            if most is None:
                own += [_lists(sets)]
            else:
                own += [pa.array([x if len(x) <= most else None for x in sets], pa.list_(pa.int64())), _lists([bitmap(x.view(np.uint64)) for x in sets])]
            yield pa.RecordBatch.from_arrays(own, names=["id", "f1", "f2", *kept])

    kept = ["set"] if most is None else ["set", "bits"]

    # a null id never is the least of a class that has another, so it is coded
    named = wanted.select(F.coalesce("min_id", F.lit(NULL)).alias("id"))
    rows = _rows(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NULL)))
    rows = only(rows, named, ["id"]).select("id", "body").mapInArrow(of, "id long, f1 long, f2 long, " + ", ".join(f"{c} array<long>" for c in kept))
    # an id can be repeated with other texts: the fingerprint tells which is meant
    found = rows.join(wanted.select("node", F.col("f1").alias("w1"), F.col("f2").alias("w2")), (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2")))
    return found.dropDuplicates(["node"]).select("node", *kept)


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k smallest values of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def near_dedup(docs: DataFrame, threshold: int = 80, width: int = 5, k: int = 64, whole: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept).

    Documents are linked when 100 * |A & B| >= threshold * |A | B| over sets of
    ``width``-word shingles (words split at ASCII white space, A-Z lower-cased);
    fewer words form one shingle; null, empty and blank texts are linked with
    nothing. ``component_id`` is the smallest id reachable (null if there is none),
    and a row is kept if that is its own id, so repeated rows of one id are kept
    together. Empty tables give empty results; other columns are ignored.

    A document at the threshold shares at least ``threshold`` per cent of its values
    with its partner; less 4.75 standard deviations of a sketch (nothing, if both
    sketches hold whole sets), so many must be shared. Hence documents with fewer
    values of more than one document have no link, and this many less one of the
    most frequent values need no lookup: some rarer one is shared too. In the last
    pass, pairs of sets of at most ``whole`` shingles that pass the filter are verified
    where they meet, others when all are gathered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    share = threshold / 100
    rows = materialize(sketches(docs, k, width, id_col, text_col), "sketches")
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("min_id"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # lists of the rarest retained values; a value of one document has no partner
    values = classes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    often = values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n, m = F.first("n"), F.first("m")
    need = F.when(n * 100 <= threshold * k, F.floor((m * threshold + 99) / 100)).otherwise(F.greatest(F.lit(1), F.floor(m * share - 4.75 * F.sqrt(m * (share * (1 - share))))))
    by_rarity = values.join(often, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("v"), need.cast("int").alias("t"))
    prefix = by_rarity.where(F.size("v") >= F.col("t")).select("node", F.array_sort(F.slice(F.col("v.key"), 1, F.size("v") - F.col("t") + 1)).alias("keys"))
    prefix = materialize(prefix, "prefix")
    lists = prefix.select(F.explode("keys").alias("key"), "node")
    sizes = classes.select("node", "n", "sketch")

    def likely(a: Column, b: Column, na: Column, nb: Column) -> Column:
        """Whether the union sketch allows the threshold: a sketch of the whole union
        is exact, else 4.5 standard deviations are granted."""
        margin = F.when(F.greatest(na, nb) * 2 <= k, 0.0).otherwise(4.5 * (share * (1 - share) / k) ** 0.5)
        least = F.lit(share) - margin
        # what both hold bounds the estimate, and is found faster
        return (F.size(F.array_intersect(a, b)) >= least * F.greatest(F.size(a), F.size(b))) & (_estimate(a, b, k) >= least)

    def near(na: Column, nb: Column) -> Column:
        return F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold

    def verify(pairs: DataFrame) -> DataFrame:
        s = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        joined = pairs.join(s("a"), "a").join(s("b"), "b").where(near(F.col("na"), F.col("nb")))
        close = joined.where(likely(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")))
        close = materialize(close.select("a", "b", "na", "nb"), "likely")
        nodes = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = materialize(full_sets(docs, classes.drop("sketch").join(nodes, "node", "left_semi"), width, id_col, text_col), "sets")
        x = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"x{c}"))
        both = close.join(x("a"), "a").join(x("b"), "b").withColumn("i", F.size(F.array_intersect("xa", "xb")))
        links = materialize(both.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * threshold).select("a", "b"), "links")
        discard(close, sets)
        return links

    def compare(mixed: DataFrame) -> DataFrame:
        """Links of nodes that are still apart: whole sets of the shorter ones are
        compared where they meet, pairs of others that may be near are verified."""
        asked = materialize(classes.drop("sketch").join(mixed.select("node").distinct(), "node", "left_semi"), "apart")
        short = full_sets(docs, asked, width, id_col, text_col, whole)
        # a set this short is near to no long one
        sketch = F.when(F.col("n") * 100 >= whole * threshold, F.col("sketch")).alias("sketch")
        about = prefix.join(sizes, "node").join(short, "node").select("node", "n", "keys", "bits", "set", sketch)
        found = materialize(compared(cells(mixed).join(about, "node"), threshold, k), "compared")
        more = verify(found.where("not sure").select("a", "b").distinct())
        links = materialize(found.where("sure").select("a", "b").union(more).distinct(), "links")
        discard(asked, found, more)
        return links

    labels = link(lists, verify, compare)
    named = classes.join(labels, "node", "left").select("f1", "f2", "n", "min_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    final = named.join(least, "root").select("f1", "f2", "n", "component_id")
    out = rows.drop("sketch").join(final, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
