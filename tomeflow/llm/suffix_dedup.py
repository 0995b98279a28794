"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of ``width`` bytes has an anchor: its least-hashed ``gram``. Strings
that are equal have equal anchors at equal offsets, so suffixes need sorting only
among those of one anchor hash and offset. A task finds the anchors of its texts
(and settles runs it repeats itself); anchors seen once are dropped; the bytes
around the others go to the anchor's bucket, where the suffixes whose hash occurs
again are mergesorted. A frequent anchor's runs are cut in ranges of offsets, each
dealt by the hash of the bytes that all its strings have in common. Two suffixes
are compared by prefix polynomial hashes: a binary search finds their common
extension, the byte after it their order. Neighbours with a common extension of
``width`` are compared byte by byte before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import materialize, small_batches
from tomeflow.llm.near_dedup import _BASE, _BYTE, _INVERSE, NULL, _powers, mix

BLOB = "kind int, bucket long, blob binary"
_BLOB = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())])
#: Text bytes whose anchors a task holds before it deals them to the buckets.
_HELD = 32 << 20
#: Strings that are compared at once; a bucket with more takes its anchors in turns.
_STRINGS = 1 << 20
#: From so many buckets on, buckets grow with the table, up to so many times: each task
#: writes to each bucket, and each bucket to each.
_BUCKETS, _GROWN = 256, 8
#: Least bits of a position in a part of a task's texts; longer texts take more.
_POS = 23


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of equal length, byte planes apart, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(1).compress(planes)


def unpack_arrays(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(planes) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


_TABLE: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """First ``n`` powers, kept for the next buffer."""
    if name not in _TABLE or len(_TABLE[name]) < n:
        _TABLE[name] = _powers(base, n)
    return _TABLE[name]


class Hashes:
    """Prefix polynomial hashes of a buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf, n = buf, len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power_table("up", _BASE, n + 1)[:n], out=self.prefix[1:])
        self.down = _power_table("down", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i : i + w] for each i with a whole window."""
    n = len(v) - w + 1
    top = np.iinfo(v.dtype).max
    padded = np.concatenate([v, np.full(-len(v) % w, top, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(bodies: list[bytes], width: int, gram: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document index, document start, anchor, first string, strings) of
    each maximal run of ``width``-byte strings with one anchor."""
    buf = np.frombuffer(b"".join(bodies) + b"\0" * width, np.uint8)
    at = np.cumsum([0, *map(len, bodies)])
    h = Hashes(buf)
    n = int(at[-1])
    none = np.zeros(0, np.int64)
    if n < width:
        return h, none, none, none, none, none
    starts = np.arange(n - gram + 1)
    g = mix(h.of(starts, starts + gram))
    bits = max(_POS, len(buf).bit_length())
    v = (g >> np.uint64(bits) << np.uint64(bits)) | starts.astype(np.uint64)
    anchor = (sliding_min(v, width - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    # strings that end in their document
    valid = np.zeros(len(anchor) + 1, np.int8)
    size = np.diff(at)
    long = np.flatnonzero(size >= width)
    np.add.at(valid, at[long], 1)
    np.add.at(valid, at[long] + size[long] - width + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    new = ok & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]))
    # a document's first string starts a run, whatever came before
    new[at[long]] = True
    first = np.flatnonzero(new)
    stop = np.concatenate((np.flatnonzero(ok & ~np.concatenate((ok[1:], [False]))) + 1, first))
    stop.sort()
    count = stop[np.searchsorted(stop, first, side="right")] - first
    doc = np.searchsorted(at, first, side="right") - 1
    return h, doc, at[doc], anchor[first], first, count


def mergesort(h: Hashes, x: np.ndarray, cls: np.ndarray, width: int) -> np.ndarray:
    """Order of suffixes ``x`` by class, then by their first ``width`` bytes; stable.
    ``cls`` is sorted. Runs are merged bottom up: an element's place is its index
    plus its rank in the sibling run, found by binary search."""
    n = len(x)
    order = np.arange(n)
    start = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    whole = h.of(x, x + width)
    w, most = 1, int(size.max(initial=0))
    while w < most:
        big = np.repeat(size > w, size)
        pos = np.flatnonzero(big)
        base = np.repeat(start, size)[pos]
        limit = np.repeat(start + size, size)[pos]
        run = (pos - base) // w
        sib = base + (run ^ 1) * w
        lo, hi = np.minimum(sib, limit), np.minimum(sib + w, limit)
        first, right = lo.copy(), (run & 1).astype(bool)
        active = np.flatnonzero(lo < hi)
        while active.size:
            mid = (lo[active] + hi[active]) >> 1
            c = compare(h, x, whole, order[mid], order[pos[active]], width)
            below = (c < 0) | ((c == 0) & right[active])
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)
            active = active[lo[active] < hi[active]]
        place = base + (run & ~1) * w + (pos - base - run * w) + (lo - first)
        merged = order.copy()
        merged[place] = order[pos]
        order, w = merged, 2 * w
    return order


def compare(h: Hashes, x: np.ndarray, whole: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Sign of the order of suffixes i and j: the longest common extension by
    binary search over prefix hashes, then the next byte."""
    out = np.zeros(len(i), np.int8)
    differ = np.flatnonzero(whole[i] != whole[j])
    a, b = x[i[differ]], x[j[differ]]
    ext = np.zeros(len(differ), np.int64)
    step = 1 << (width - 1).bit_length() - 1
    while step:
        can = ext + step < width
        s, t = a + ext, b + ext
        e = np.where(can, step, 0)
        ext += np.where(can & (h.of(s, s + e) == h.of(t, t + e)), step, 0)
        step >>= 1
    out[differ] = np.sign(h.buf[a + ext].astype(np.int16) - h.buf[b + ext].astype(np.int16))
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the strings at a and b are equal, byte by byte."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    out = np.ones(len(a), bool)
    for k in [*range(0, width - 7, 8), width - 8]:
        out &= words[a + k] == words[b + k]
    return out


def repeated(h: Hashes, key: np.ndarray, offset: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Of the strings of runs (anchor hash, offset of the first string to its
    anchor, buffer place, count), in document order: whether an equal string came
    earlier, one flag for each string, run by run."""
    total = int(count.sum())
    run = np.repeat(np.arange(len(count)), count)
    j = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    x = first[run] + j
    _, group = np.unique(key, return_inverse=True)
    cls = group[run] * width + (offset[run] - j)
    gone = np.zeros(total, bool)
    # equal strings have one class and one hash: what is alone in both needs no sorting
    both = mix(h.of(x, x + width) + mix(cls.astype(np.uint64)))
    order = np.argsort(both)
    again = both[order[1:]] == both[order[:-1]]
    shared = np.zeros(total, bool)
    shared[order[1:][again]] = shared[order[:-1][again]] = True
    by_class = np.flatnonzero(shared)
    if not len(by_class):
        return gone
    by_class = by_class[np.argsort(cls[by_class], kind="stable")]
    sorted_cls = cls[by_class]
    at = x[by_class]
    order = mergesort(h, at, sorted_cls, width)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(sorted_cls[a] == sorted_cls[b])
    whole = h.of(at, at + width)
    near = near[whole[a[near]] == whole[b[near]]]
    true = same_bytes(h.buf, at[a[near]], at[b[near]], width)
    gone[by_class[b[near[true]]]] = True
    if not true.all():  # a hash collision: settle its classes by the bytes
        for c in np.unique(sorted_cls[b[near[~true]]]):
            seen: set[bytes] = set()
            for e in by_class[sorted_cls == c]:
                s = h.buf[x[e] : x[e] + width].tobytes()
                gone[e] = s in seen
                seen.add(s)
    return gone


def _spans(first: np.ndarray, count: np.ndarray, gone: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the maximal stretches of removed strings in each run."""
    run = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(gone)) - np.repeat(np.cumsum(count) - count, count)
    begin = gone & ((j == 0) | ~np.concatenate(([False], gone[:-1])))
    end = gone & ((j == count[run] - 1) | ~np.concatenate((gone[1:], [False])))
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    return run[b], first[run[b]] + j[b], first[run[e]] + j[e] + width


def same_runs(h: Hashes, first: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int) -> np.ndarray:
    """Runs (in document order) with the bytes and the anchor of an earlier one."""
    end = first + count - 1 + width
    content = mix(h.of(first, end) + count.astype(np.uint64) * _BASE + offset.astype(np.uint64))
    _, one, back = np.unique(content, return_index=True, return_inverse=True)
    own = one[back]
    copy = np.flatnonzero(own != np.arange(len(first)))
    raw = memoryview(h.buf)
    true = [raw[a:b] == raw[c:d] for a, b, c, d in zip(first[copy].tolist(), end[copy].tolist(), first[own[copy]].tolist(), end[own[copy]].tolist())]
    return copy[np.array(true, bool)]


def split_hot(fields: list[np.ndarray], times: np.ndarray, body: dict[tuple[int, int], bytes], width: int, gram: int, hot: int) -> list[np.ndarray]:
    """Runs (hash, doc, tie, first string, offset, strings) with those of anchors of
    more than ``hot`` runs cut in ranges of offsets, the narrower the more runs there
    are. A range's hash is that of the bytes all its strings have in common, so equal
    strings still meet, and strings with other bytes beside the anchor go elsewhere."""
    often = times > hot
    if not often.any():
        return fields
    offsets = width - gram + 1
    cut: list[tuple[int, ...]] = []
    for n, key, doc, tie, first, offset, count in zip(times[often].tolist(), *(f[often].tolist() for f in fields)):
        text, at = body[doc, tie], first + offset
        step = max(1, offsets * hot // n)
        high = offset
        while high > offset - count:
            base = high // step * step
            low = max(base, offset - count + 1)
            common = text[at - base : at + width + 1 - min(base + step, offsets)]
            own = hashlib.blake2b(common + bytes([base]), digest_size=8).digest()
            cut.append((int.from_bytes(own, "little"), doc, tie, at - high, high, high - low + 1))
            high = low - 1
    return [np.concatenate((f[~often], np.array(c, f.dtype))) for f, c in zip(fields, zip(*cut))]


def bucket_count(size: int, per_bucket: int) -> int:
    """Buckets of ``per_bucket`` text bytes; of more, up to a bound, in large tables."""
    n = -(-size // per_bucket)
    return max(8, min(n, max(_BUCKETS, -(-size // (_GROWN * per_bucket)))))


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(kind: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[dict]:
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] for a in arrays]
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
    for s, e in zip(cut, cut[1:]):
        yield {"kind": kind, "bucket": int(bucket[s]), "blob": pack_arrays([a[s:e] for a in arrays])}


_ANCHOR = [np.uint64, np.int64, np.uint64, np.int64, np.uint8, np.uint8]  # hash, doc, tie, first string, offset, strings
_COUNTED = [*_ANCHOR, np.uint32]  # and runs of the anchor
_SPAN = [np.int64, np.uint64, np.int64, np.int64]  # doc, tie, start, end


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 24, per_bucket: int = 4 << 20, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts earlier
    (smaller id, or same document, earlier start); strings are judged on the input.

    One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256[, kept]).
    ``kept`` is binary: a cut can fall inside a character. Null text is empty; a
    null id comes first. Rows of one id are documents of their own, ordered by
    64-bit hashes of their texts; rows equal in id and text count as one document. Empty
    tables give empty results; other columns are ignored. ``width`` is 32 to 255
    and over ``gram``. Work is dealt in buckets of about ``per_bucket`` text bytes (up
    to eight times that in large tables); the runs of an anchor with more than ``hot``
    are dealt over many.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    known = rows.agg(F.sum(F.octet_length("body")).alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("d")).first()
    buckets = bucket_count(known["b"] or 0, per_bucket)
    tied = known["n"] != known["d"]

    def tie(body: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little") if tied else 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(part: list[tuple[int, int, bytes]]) -> None:
            part = sorted(part, key=lambda r: r[:2])
            h, doc, at, anchor, first, count = anchors([r[2] for r in part], width, gram)
            ids, ties = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.uint64)
            key = mix(h.of(anchor, anchor + gram))
            end = first + count - 1 + width
            # settled here: runs equal to an earlier run of this task
            copy = same_runs(h, first, count, anchor - first, width)
            d = doc[copy]
            held[1].append([ids[d], ties[d], first[copy] - at[copy], end[copy] - at[copy]])
            left = np.ones(len(first), bool)
            left[copy] = False
            d = doc[left]
            held[0].append([key[left], ids[d], ties[d], (first - at)[left], (anchor - first)[left].astype(np.uint8), count[left].astype(np.uint8)])

        def dealt() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                fields = [np.concatenate(c) for c in zip(*parts)]
                bucket = doc_bucket(fields[0], buckets) if kind else (fields[0] % np.uint64(buckets)).astype(np.int64)
                if found := list(_by_bucket(kind, bucket, fields)):
                    yield pa.RecordBatch.from_pylist(found, _BLOB)
                parts.clear()

        held: dict[int, list[list[np.ndarray]]] = {0: [], 1: []}
        size = 0
        for batch in _parts(batches, tie):
            chunk(batch)
            size += sum(len(r[2]) for r in batch)
            if size >= _HELD:
                yield from dealt()
                size = 0
        if held[0]:
            yield from dealt()

    def twice(table: pa.Table) -> pa.Table:
        """Anchors of a bucket whose hash occurs again, counted, by document bucket."""
        parts = [unpack_arrays(b.as_py(), _ANCHOR) for b in table.column("blob")]
        fields = [np.concatenate(c) for c in zip(*parts)]
        _, back, n = np.unique(fields[0], return_inverse=True, return_counts=True)
        keep = n[back] > 1
        fields = [f[keep] for f in fields] + [n[back][keep].astype(np.uint32)]
        return pa.Table.from_pylist(list(_by_bucket(2, doc_bucket(fields[1], buckets), fields)), _BLOB)

    def contexts(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The bytes of the runs of wanted anchors, by anchor bucket."""
        parts = [unpack_arrays(b.as_py(), _COUNTED) for b in wanted.column("blob")]
        if not parts:
            return pa.Table.from_pylist([], _BLOB)
        *fields, times = (np.concatenate(c) for c in zip(*parts))
        body = {(i, tie(b)): b for i, b in zip(texts.column("doc").to_pylist(), (x.as_py() for x in texts.column("body")))}
        key, doc, ties, first, offset, count = split_hot(fields, times, body, width, gram, hot)
        order = np.argsort(key % np.uint64(buckets), kind="stable")
        at = (key % np.uint64(buckets)).astype(np.int64)[order]
        out = []
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
        for s, e in zip(cut, cut[1:]):
            i = order[s:e]
            blob = pack_arrays([a[i] for a in (key, doc, ties, first, offset, count)])
            raw = b"".join(body[d, t][f : f + c - 1 + width] for d, t, f, c in zip(doc[i].tolist(), ties[i].tolist(), first[i].tolist(), count[i].tolist()))
            raw = zstandard.ZstdCompressor(1).compress(raw)
            out.append({"kind": 3, "bucket": int(at[s]), "blob": len(blob).to_bytes(8, "little") + blob + raw})
        return pa.Table.from_pylist(out, _BLOB)

    def settle(table: pa.Table) -> pa.Table:
        """Stretches of repeated strings of a bucket, by document bucket."""
        heads, raws = [], []
        for b in table.column("blob"):
            b = b.as_py()
            n = int.from_bytes(b[:8], "little")
            heads.append(unpack_arrays(b[8 : 8 + n], _ANCHOR))
            raws.append(zstandard.ZstdDecompressor().decompress(b[8 + n :]))
        key, doc, ties, first, offset, count = (np.concatenate(c) for c in zip(*heads))
        count, offset = count.astype(np.int64), offset.astype(np.int64)
        size = count - 1 + width
        place = np.cumsum(size) - size
        raw = b"".join(raws)
        del raws
        turns = max(1, -(-int(count.sum()) // _STRINGS))
        turn = (key // np.uint64(buckets) % np.uint64(turns)).astype(np.int64)
        found = []
        for t in range(turns):
            mine = np.flatnonzero(turn == t)
            order = mine[np.lexsort((first[mine], ties[mine], doc[mine]))]
            runs, near = count[order], size[order]
            h = Hashes(np.frombuffer(b"".join([raw[a:b] for a, b in zip(place[order].tolist(), (place + size)[order].tolist())]) + b"\0" * width, np.uint8))
            spot = np.cumsum(near) - near
            # whole runs that came earlier need no sorting
            copy = same_runs(h, spot, runs, offset[order], width)
            left = np.ones(len(runs), bool)
            left[copy] = False
            gone = np.ones(int(runs.sum()), bool)
            gone[np.repeat(left, runs)] = repeated(h, key[order][left], offset[order][left], spot[left], runs[left], width)
            run, start, end = _spans(first[order], runs, gone, width)
            who = order[run]
            found.append([doc[who], ties[who], start, end])
        spans = [np.concatenate(c) for c in zip(*found)]
        return pa.Table.from_pylist(list(_by_bucket(1, doc_bucket(spans[0], buckets), spans)), _BLOB)

    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b.as_py(), _SPAN) for b in spans.column("blob")]
        doc, ties, start, end = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, k) for k in _SPAN]
        order = np.lexsort((start, ties, doc))
        doc, ties, start, end = doc[order], ties[order], start[order], end[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (ties[1:] != ties[:-1]))) if len(doc) else np.zeros(0, bool)
        at = np.append(np.flatnonzero(new), len(doc))
        where = {(int(doc[s]), int(ties[s])): (s, e) for s, e in zip(at, at[1:])}
        out = []
        for i, body in zip(texts.column("doc").to_pylist(), (x.as_py() for x in texts.column("body"))):
            s, e = where.get((i, tie(body)), (0, 0))
            kept, last, spans_n, reach = [], 0, 0, -1
            for b, f in zip(start[s:e].tolist(), end[s:e].tolist()):
                if b > reach:  # neither overlaps nor touches what is removed so far
                    kept.append(body[last:b])
                    spans_n += 1
                    reach = f
                reach = max(reach, f)
                last = reach
            kept.append(body[last:])
            left = b"".join(kept)
            row = {"doc": i, "n_bytes": len(body), "n_removed": len(body) - len(left), "n_spans": spans_n, "kept_sha256": hashlib.sha256(left).hexdigest()}
            out.append(row | ({"kept": left} if keep_text else {}))
        return pa.Table.from_pylist(out, result)

    result = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])])
    ddl = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = doc_bucket(np.array(b.column(0).to_pylist(), np.int64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), b.column(1)], names=["bucket", "doc", "body"])

    texts = rows.mapInArrow(label, "bucket long, doc long, body binary").groupBy("bucket")
    # a row repeated whole must not count as an earlier copy of itself
    once = rows.distinct() if tied else rows
    found = materialize(once.mapInArrow(find, BLOB), "anchors")
    again = found.where("kind = 0").groupBy("bucket").applyInArrow(twice, BLOB)
    shipped = texts.cogroup(again.groupBy("bucket")).applyInArrow(contexts, BLOB)
    settled = shipped.groupBy("bucket").applyInArrow(settle, BLOB)
    spans = settled.union(found.where("kind = 1"))
    final = texts.cogroup(spans.groupBy("bucket")).applyInArrow(cut, ddl)
    ident = F.when(F.col("doc") != NULL, F.col("doc")).alias(id_col)
    return final.select(ident, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))


def _parts(batches: Iterator[pa.RecordBatch], tie, most: int = 2 << 20) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows (doc, tie, body) in parts of about ``most`` bytes; a longer text is a
    part of its own."""
    part, held = [], 0
    for b in batches:
        for doc, body in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
            if part and held + len(body) > most:
                yield part
                part, held = [], 0
            part.append((doc, tie(body), body))
            held += len(body)
    if part:
        yield part
