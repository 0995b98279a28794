"""Exact dedup by Patricia tries over length-and-content-hash partitions.

Each task first inserts its own rows in a compressed radix trie (the map-side
combine: of a text repeated in a partition one entry is shuffled). Entries are
dealt by (length, content hash) and inserted, as full byte strings, in the
owning partition's trie, whose terminal nodes keep the preferred identifier and
the row count. A trie over its byte budget spills its largest subtree as a
sorted run; runs of a subtree are merged when it is emitted.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import string
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import materialize, partitions, small_batches

#: ASCII capitals to small letters; other characters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Least preferred identifier: stands for a null one.
LAST = 1 << 70


class PatriciaTrie:
    """Compressed radix trie over byte strings with (best id, count) terminals.

    A node is [label, children by first byte, best, count]; count 0 marks an
    inner node. ``budget`` bounds the label bytes in memory.
    """

    def __init__(self, budget: int = 48 << 20) -> None:
        self.root: list = [b"", {}, LAST, 0]
        self.budget, self.sizes, self.spilled = budget, {}, {}
        self.held = 0

    def insert(self, key: bytes, best: int, count: int) -> None:
        top = key[:1]
        node, at, end = self.root, 0, len(key)
        grown = 0
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, LAST, 0]
                node[1][key[at]] = child
                grown = end - at + 200
                node, at = child, end
                break
            label = child[0]
            same = _common(label, key, at)
            if same < len(label):  # split the edge
                mid = [label[:same], {label[same]: child}, LAST, 0]
                child[0] = label[same:]
                node[1][key[at]] = mid
                grown += 200
                child = mid
            node, at = child, at + same
        node[2] = min(node[2], best)
        node[3] += count
        if grown:
            self.held += grown
            self.sizes[top] = self.sizes.get(top, 0) + grown
            if self.held > self.budget:
                self._spill(max(self.sizes, key=self.sizes.get))

    def _spill(self, top: bytes) -> None:
        node = self.root[1].pop(top[0])
        run = tempfile.TemporaryFile()
        for entry in _walk(node, b""):
            pickle.dump(entry, run, protocol=5)
        self.spilled.setdefault(top, []).append(run)
        self.held -= self.sizes.pop(top)

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, best, count) in key order; one subtree is merged at a time."""
        if self.root[3]:
            yield b"", self.root[2], self.root[3]
        tops = {bytes([k]) for k in self.root[1]} | set(self.spilled)
        for top in sorted(tops):
            node = self.root[1].pop(top[0], None)
            runs = [_replay(r) for r in self.spilled.pop(top, [])]
            if node is not None:
                runs.append(_walk(node, b""))
            last = None
            for key, best, count in heapq.merge(*runs) if len(runs) > 1 else runs[0]:
                if last and last[0] == key:
                    last = (key, min(last[1], best), last[2] + count)
                else:
                    if last:
                        yield last
                    last = (key, best, count)
            if last:
                yield last


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    if key.startswith(label, at):
        return len(label)
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:  # halving keeps the comparison in C
        mid = (lo + hi + 1) // 2
        if key.startswith(label[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node[0]
        if node[3]:
            yield key, node[2], node[3]
        stack.extend((node[1][b], key) for b in sorted(node[1], reverse=True))


def _replay(run) -> Iterator[tuple[bytes, int, int]]:
    run.seek(0)
    while True:
        try:
            yield pickle.load(run)
        except EOFError:
            run.close()
            return


def text_digest(text_col: str) -> Column:
    """SHA-256 of a normalised text (A-Z lower-cased, null as empty), in hexadecimal."""
    return F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase).cast("binary"), 256)


ENTRY = "length long, content_hash long, keep_id long, n long, body binary"
OWNER = "text_sha256 string, keep_id long, group_size long"


def _emit(trie: PatriciaTrie, row, schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for entry in trie.entries():
        rows.append(row(*entry))
        held += len(entry[0]) + 100
        if held > most:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 48 << 20) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``keep`` ("smallest" or "largest") says which identifier of a group stays; a
    null identifier stays only if its group has no other. Of repeated rows (same
    id, same text) one is kept. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sign = {"smallest": 1, "largest": -1}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    entry_schema = pa.schema([("length", pa.int64()), ("content_hash", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
    owner_schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def rank(i: int | None) -> int:
        return LAST if i is None else sign * i

    def ident(best: int) -> int | None:
        return None if best == LAST else sign * best

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.insert(body.translate(LOWER), rank(i), 1)
        yield from _emit(trie, _entry_row, entry_schema)

    def _entry_row(key: bytes, best: int, n: int) -> dict:
        h = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big", signed=True)
        return {"length": len(key), "content_hash": h, "keep_id": ident(best), "n": n, "body": key}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for b in batches:
            for i, n, body in zip(*(b.column(c).to_pylist() for c in ("keep_id", "n", "body"))):
                trie.insert(body, rank(i), n)
        yield from _emit(trie, lambda key, best, n: {"text_sha256": hashlib.sha256(key).hexdigest(), "keep_id": ident(best), "group_size": n}, owner_schema)

    owners = (
        rows.mapInArrow(combine, ENTRY)
        .repartition(partitions(spark), "length", "content_hash")
        .mapInArrow(own, OWNER)
    )
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("__row"))
    keyed = materialize(keyed, "digests")
    # rows repeated with one id and text: one of them stays
    again = keyed.groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first")).where("__n > 1")
    again = again.select(F.col("text_sha256").alias("__sha"), F.col("id").alias("__id"), "__first")
    each = keyed.join(owners, "text_sha256").join(again, (F.col("text_sha256") == F.col("__sha")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    first = F.coalesce(F.col("__first"), F.col("__row")) == F.col("__row")
    return each.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")
