"""Spelling variant grouping by a bit-sliced position index.

The vocabulary's index has a bitset for each (position, letter): bit w is set if
word w has that letter there. A word is looked up letter by letter: word-parallel
recurrences carry the set of words that agree so far (zero errors) and three sets
with one error, aligned at the same position (a letter replaced), at the next one (a
letter inserted) and at the one before (a letter deleted).

Two words with one edit agree in all but the part where it lies. Words are dealt to
groups by what is left when one half is taken out, so that near words share a group
and no word meets the whole vocabulary. A group that is too large is dealt again by
halves of its part, down to parts of one letter, whose groups the alphabet bounds.
Each block of groups has an index over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import BROADCAST_KEYS, discard, materialize, partitions

#: Words of an index block, the most words and characters of a group before it is dealt again.
BLOCK, MOST, MOST_CHARS = 1024, 4096, 1 << 20
#: Rounds of pointer doubling; each form occurs at least twice as often as its word.
ROUNDS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 5, least: int = 3, slip: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of at least ``least_length`` code points that occur
    ``least`` times. Words are maximal runs of Latin letters, A-Z lower-cased; where
    ``slip`` divides the crc32 of ``<id>:<run>``, the run loses one code point (a
    seeded misspelling). A null id counts as an empty text, a null text has no words."""
    lowered = F.translate(text_col, _UPPER, _LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run")
    ).where(F.length("run") >= least_length)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(parts: DataFrame) -> DataFrame:
    """Rows (node, word, a, lo, hi) with ``key``: what a word of ``a`` letters, or of
    one more, has before ``lo`` and after ``hi``."""
    rest = F.col("a") - F.col("hi")
    left, right = F.col("word").substr(F.lit(1), F.col("lo")), F.col("word").substr(F.length("word") - rest + 1, rest)
    return parts.select("node", "word", "a", "lo", "hi", F.xxhash64("a", "lo", "hi", left, right).alias("key"))


def _halves(parts: DataFrame) -> DataFrame:
    mid = F.expr("cast((lo + hi) div 2 as int)")
    spans = F.explode(F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct(mid.alias("l"), F.col("hi").alias("h"))))
    return parts.select("node", "word", "a", spans.alias("s")).select("node", "word", "a", F.col("s.l").alias("lo"), F.col("s.h").alias("hi"))


def groups(words: DataFrame, most: int = MOST, most_chars: int = MOST_CHARS) -> list[DataFrame]:
    """Tables (node, word, a, lo, hi, key) of groups that hold every near pair of
    ``words`` (node, word): words of a or a + 1 letters that agree outside their
    part [lo, hi). Groups over the bounds are dealt again by halves."""
    least = words.agg(F.min(F.length("word"))).first()[0] or 0
    size = F.length("word")
    frames = words.select("node", "word", F.explode(F.array(size, size - 1)).alias("a")).where(F.col("a") >= least)
    rows = materialize(_keyed(_halves(frames.select("*", F.lit(0).alias("lo"), F.col("a").alias("hi")))), "frames")
    out = []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars"), F.max(F.col("hi") - F.col("lo")).alias("part"))
        hot = materialize(sizes.where((F.col("n") > 1) & (F.col("part") > 1) & ((F.col("n") > most) | (F.col("chars") > most_chars))).select("key"), "hot-frames")
        n = hot.limit(BROADCAST_KEYS + 1).count()
        if n == 0:
            return [*out, rows]
        hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
        out.append(rows.join(hot, "key", "left_anti").select(*rows.columns))
        rows = materialize(_keyed(_halves(rows.join(hot, "key", "left_semi"))), "frames")


def _bits(rows: np.ndarray, count: int, words: int) -> np.ndarray:
    """(count, words) uint64: bitset of the columns j with rows[j] = r (none if negative)."""
    hit = np.zeros((count, words * 64), np.uint8)
    at = np.flatnonzero(rows >= 0)
    hit[rows[at], at] = 1
    return np.packbits(hit, axis=1, bitorder="little").view(np.uint64)


def one_error(parts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) positions of the ``parts`` of one group that differ by one
    inserted, deleted or replaced code point. Parts are in descending length."""
    size = np.array([len(p) for p in parts], np.int64)
    n, longest = len(parts), int(size[0])
    words = -(-n // 64)
    codes = np.full((n, longest), -1, np.int64)
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    letters, numbers = np.unique(flat, return_inverse=True)
    inside = np.arange(longest)[None, :] < size[:, None]
    codes[inside] = numbers
    count = len(letters)
    nothing = np.zeros((count, words), np.uint64)
    index = lambda p: _bits(codes[:, p], count, words) if 0 <= p < longest else nothing
    of_size = _bits(size, longest + 2, words)  # row s: parts of s letters
    longer = np.bitwise_or.accumulate(of_size[::-1], axis=0)[::-1]  # row s: parts of s letters or more
    same = _bits(group, int(group.max()) + 1, words)
    zero = np.repeat(longer[:1], n, 0)
    replaced, deleted, inserted = np.zeros_like(zero), np.zeros_like(zero), np.repeat(longer[1:2], n, 0)
    before, here, after = nothing, index(0), index(1)
    found, live, i = [], n, 0
    while True:
        now = int(np.searchsorted(-size, -i, "left"))  # parts longer than i go on
        if now < live:
            end = slice(now, live)
            near = (replaced[end] & ~zero[end] & of_size[i]) | (inserted[end] & of_size[i + 1])
            near = near | (deleted[end] & of_size[i - 1]) if i else near
            near &= same[group[end]]
            some = np.flatnonzero(near.any(1))
            q, w = np.nonzero(np.unpackbits(near[some].view(np.uint8), axis=1, bitorder="little"))
            found.append((some[q] + now, w))
            live = now
        if not live:
            break
        letter = codes[:live, i]
        agree = here[letter]
        z = zero[:live]
        deleted = (deleted[:live] & before[letter]) | z
        replaced = (replaced[:live] & agree) | (z & longer[i + 1])
        zero = z & agree
        inserted = (inserted[:live] & after[letter]) | zero
        i += 1
        before, here, after = here, after, index(i + 1)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (key, node, word, lo, rest) of whole groups, about ``most`` at a time;
    groups of one word are left out. Rows come in order of key."""
    block: list[tuple] = []
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if group and group[0][0] != row[0]:
                if len(group) > 1:
                    if block and len(block) + len(group) > most:
                        yield block
                        block = []
                    block = block + group
                group = []
            group.append(row)
    if len(group) > 1:
        if block and len(block) + len(group) > most:
            yield block
            block = []
        block = block + group
    if block:
        yield block


def near_pairs(words: DataFrame, block: int = BLOCK, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """Distinct (a, b): nodes of ``words`` (node, word; words distinct) that differ by
    exactly one inserted, deleted or replaced code point, in both directions."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            part = lambda r: r[2][r[3] : len(r[2]) - r[4]]
            rows.sort(key=lambda r: -len(part(r)))
            group = np.unique([r[0] for r in rows], return_inverse=True)[1]
            q, w = one_error([part(r) for r in rows], group)
            # a group's key is a hash: the letters outside the part are compared too
            sure = [rows[x][2][: rows[x][3]] == rows[y][2][: rows[y][3]] and rows[x][2][len(rows[x][2]) - rows[x][4] :] == rows[y][2][len(rows[y][2]) - rows[y][4] :] for x, y in zip(q, w)]
            node = np.array([r[1] for r in rows], np.int64)
            keep = np.array(sure, bool)
            yield pa.RecordBatch.from_arrays([pa.array(node[q[keep]]), pa.array(node[w[keep]])], names=["a", "b"])

    found = []
    for part in groups(words, most, most_chars):
        rows = part.select("key", "node", "word", "lo", (F.col("a") - F.col("hi")).alias("rest"))
        dealt = rows.repartition(partitions(words.sparkSession), "key").sortWithinPartitions("key")
        found.append(dealt.mapInArrow(search, "a long, b long"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of a word's chain of forms, by
    pointer doubling; words without a form are no rows."""
    cur = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        over = cur.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        moved = materialize(cur.join(over, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__w").isNotNull().alias("more")), "roots")
        discard(cur)
        cur = moved.drop("more")
        if moved.where("more").isEmpty():
            return cur
        cur._tomeflow_path = moved._tomeflow_path
    raise RuntimeError("roots: forms go in circles")


def spelling_variants(docs: DataFrame, least_length: int = 5, least: int = 3, ratio: int = 2, slip: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``vocabulary``.

    ``form`` is the near word of largest n (of equal ones the first in code-point
    order), if that is at least ``ratio`` times the word's own, else null; ``root`` is
    what following forms ends at. Repeated rows count as often as they occur; words of
    any length are compared whole; an empty table gives no rows; other columns are
    ignored. ``ratio`` must be over 1, so that chains of forms end."""
    counted = vocabulary(docs, least_length, least, slip, id_col, text_col)
    words = materialize(counted.withColumn("node", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words.select("node", "word"))
    other = words.select(F.col("node").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    joined = words.join(best, F.col("node") == F.col("a"), "left")
    usual = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = materialize(
        joined.select("word", F.when(usual, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, -F.col("best.less")).alias("form_n")), "variants"
    )
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
