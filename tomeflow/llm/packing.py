"""Best-fit packing of token pieces with swap-based local search.

Texts are tokenised where they lie; only piece sizes are shuffled. Pieces are
dealt to groups of bounded size; a group is packed best fit decreasing, then
documents are exchanged one for one, two for one or moved between underfull
bins, each step raising the summed squared fill, until bins empty or no step is
left. Bins that stay underfull are opened and packed again across groups.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import materialize, small_batches

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Longest run of white space that the byte ranks' splitter is given: its backtracking
#: takes stack for each character of one.
LONG_BLANK = 50_000
_BLANKS = re.compile(r"\s+")


class TokenIds:
    """Ids of a tokenizer file, ``ranks`` (the same vocabulary as byte ranks) being
    a faster way to the same ids; texts with a special token's string or a very long
    run of white space, and files without ranks, go through the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) > LONG_BLANK and any(m.end() - m.start() > LONG_BLANK for m in _BLANKS.finditer(text))):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def token_pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, limit: int = 2048, eos: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document (ids, then ``eos``). Documents over
    ``limit`` ids are cut, from their end, in pieces of ``limit``: only the first
    may be shorter. Null text counts as empty: one piece, the ``eos``. Texts are
    tokenised whole, however long; an empty table gives no piece."""
    small_batches(docs.sparkSession, 500)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenIds(path, ranks, pattern)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(ids_of(text), np.uint32(eos)).astype("<u4")
                first = len(ids) % limit or limit
                at = [0, *range(first, len(ids), limit), len(ids)]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(at, at[1:]))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE)


def pack(sizes: np.ndarray, limit: int, sweeps: int = 4000) -> np.ndarray:
    """Bin number of each size (1..limit)."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    fill: list[int] = []
    by_slack: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0  # bit s: a bin with slack s exists
    for i in order:
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            slack = s + (fits & -fits).bit_length() - 1
            b = by_slack[slack].pop()
            if not by_slack[slack]:
                mask &= ~(1 << slack)
        else:
            b, slack = len(bins), limit
            bins.append([])
            fill.append(0)
        bins[b].append(int(i))
        fill[b] += s
        left = slack - s
        if left:
            by_slack[left].append(b)
            mask |= 1 << left
    local_search(bins, fill, sizes, limit, sweeps)
    out = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def local_search(bins: list[list[int]], fill: list[int], sizes: np.ndarray, limit: int, sweeps: int) -> None:
    """Empty underfull bins, in place. The victim is the least filled bin; a step
    takes fill d from it to a bin of slack >= d that is fuller after the step than
    the victim was before it, so that the sum of squared fills grows by
    2 d (fill - victim's fill + d) > 0. Steps, best first: move a document,
    exchange one for one, exchange two of the victim's for one. The search ends when
    the least number of bins is reached, no bin has a step left, or ``sweeps`` victims
    have been asked: a bound of the time only, no document is left out."""
    least = -(-sum(fill) // limit)
    stuck: set[int] = set()
    moved = False
    for _ in range(sweeps):
        live = [b for b in range(len(bins)) if bins[b]]
        if len(live) <= least:
            return
        open_ = [b for b in live if fill[b] < limit and b not in stuck]
        if not open_ and moved:  # the others have changed: ask all again
            stuck, moved = set(), False
            continue
        if not open_:
            return
        v = min(open_, key=lambda b: (fill[b], b))
        others = [b for b in live if b != v and fill[b] < limit]
        step = best_step(bins, fill, sizes, limit, v, others)
        if step is None:
            stuck.add(v)
            continue
        gain, give, b, back = step
        for i in give:
            bins[v].remove(i)
            bins[b].append(i)
        if back >= 0:
            bins[b].remove(back)
            bins[v].append(back)
        fill[v] -= gain
        fill[b] += gain
        moved = True


def best_step(bins: list[list[int]], fill: list[int], sizes: np.ndarray, limit: int, v: int, others: list[int]) -> tuple[int, list[int], int, int] | None:
    """(fill taken, documents of bin ``v``, other bin, document given back or -1) of the
    step that takes most from ``v``, a move before an exchange; None if there is none."""
    if not others:
        return None
    slack = np.array([limit - fill[b] for b in others])
    own = sorted(bins[v], key=lambda i: -sizes[i])
    for i in own:
        if (fits := np.flatnonzero(slack >= sizes[i])).size:
            return int(sizes[i]), [i], others[int(fits[np.argmin(slack[fits])])], -1
    item = np.array([i for b in others for i in bins[b]])
    owner = np.repeat(np.arange(len(others)), [len(bins[b]) for b in others])
    # only what an exchange can give back: for each size, the bin with the most room
    room, held = slack[owner], sizes[item]
    order = np.lexsort((-room, held))
    room, held, item, owner = room[order], held[order], item[order], owner[order]
    # sums of one or two documents; of equal sums one is tried
    gives = {int(sizes[i]): [i] for i in own}
    for x in range(len(own)):
        for y in range(x + 1, len(own)):
            gives.setdefault(int(sizes[own[x]] + sizes[own[y]]), [own[x], own[y]])
    best = None
    for s, give in sorted(gives.items(), reverse=True):
        if best is not None and s - int(held[0]) <= best[0]:
            break  # smaller sums take less
        gain = s - held
        ok = np.flatnonzero((gain > 0) & (gain <= room))
        if ok.size:
            j = ok[np.argmax(gain[ok])]
            if best is None or gain[j] > best[0]:
                best = (int(gain[j]), give, others[int(owner[j])], int(item[j]))
    return best


def _pack_groups(pieces: DataFrame, limit: int, level: int, per_group: int) -> DataFrame:
    """Pack groups of about ``per_group`` pieces; adds bin_key, offset and fill."""
    n = pieces.count()
    groups = max(1, -(-n // per_group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "__row"], ascending=[False, True, True, True]).reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        bins = pack(sizes, limit)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        new = np.r_[True, np.diff(bins[order]) > 0]
        base = np.maximum.accumulate(np.where(new, starts, 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = starts - base
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return pdf.assign(sequence_id=(level << 60) + (int(key[0]) << 28) + bins, offset=offset, fill=fill)[[f.name for f in schema]]

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(level), "__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(lambda key, pdf: one(key, pdf.drop(columns="__group")), schema)


def best_fit_pack(pieces: DataFrame, limit: int = 2048, per_group: int = 20_000) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with (sequence_id,
    offset): bins of at most ``limit``, offsets gapless from 0.

    Groups are dealt by row, so neither a hot id nor repeated rows gather in one;
    ``per_group`` bounds what a task holds. An empty table gives an empty result.
    """
    table = materialize(pieces, "pieces").withColumn("__row", F.monotonically_increasing_id())
    full = table.where(F.col("length") == limit).withColumn("sequence_id", F.lit(3 << 60) + F.col("__row")).withColumn("offset", F.lit(0).cast("long"))
    first = materialize(_pack_groups(table.where(F.col("length") < limit), limit, 1, per_group), "packed")
    under = first.where(F.col("fill") < limit * 0.995).drop("sequence_id", "offset", "fill")
    again = _pack_groups(under, limit, 2, per_group)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*cols).union(first.where(F.col("fill") >= limit * 0.995).select(*cols)).union(again.select(*cols))
