"""Fuzzy line dedup by MinHash.

A line's set is its ``width``-character shingles. The hashes of a set, sorted, are one
permutation of it, as a circle: a key is a run of ``RUN`` of its values that begins at
the first of one of ``RANGES`` ranges. Two lines of similarity 0.8 or more have, of
the elements of their union, at most one in five to themselves, so some run of four is
common to them: sets of up to ``SHORT`` give all of their runs and miss no link,
longer ones share none of their runs with a chance of 3e-5 at most. Equal lines are
collapsed by a 128-bit hash first; candidates are verified by exact Jaccard
similarity of the shingle sets, and joined by star contraction over links.

Lines that stay apart in a list of more than ``SMALL`` get a bitmap of their set. Two
bitmaps differ in no more bits than two sets in elements, so lists are split by set
size, and their members told apart where they meet, without losing a link.

All of it is column functions and DataFrame operations. ``sets``, ``bitmap`` and
``bands`` say parts of it for arrays.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import BROADCAST_KEYS, discard, materialize, mix, reclaim
from tomeflow.llm.linking import cross_pairs, link

#: Values of a signature, and how many make a band.
VALUES, ROWS = 80, 4
BANDS = VALUES // ROWS
#: Ranges of hash values in which a run of a line's sorted set begins, and elements of a run.
RANGES, RUN = 20, 4
#: Sets of up to so many shingles give the run at each of their elements.
SHORT = 40
#: Rounds of drawn pivots, and parts in which lists are made, so that the shuffle of one is gone before the next.
ROUNDS, PARTS = 1, 2
#: 64-bit words of a bitmap, and of one that is made in columns.
WORDS, COLUMNS = 16, 32
#: Lists of up to so many lines give all their pairs.
SMALL = 8
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint32(0xFFFFFFFF)
#: Ranges that an empty one borrows from, draw after draw; in the end all are asked.
DONORS = [*np.random.default_rng(7).integers(0, VALUES, (96, VALUES)), *[(np.arange(VALUES) + k) % VALUES for k in range(1, VALUES)]]
#: Fills up lines shorter than a shingle; no character has this code.
_PAD = (0x110001).to_bytes(4, "little")


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of ``width`` codes."""
    if width == 1:
        return codes
    half = width // 2
    g = _windows(codes, half)
    both = g[: len(g) - half] * np.uint64(pow(_BASE, half, 1 << 64)) + g[half:]
    if width % 2:
        both = both[: len(codes) - width + 1] * np.uint64(_BASE) + codes[width - 1 :]
    return both


def shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): hashes of the shingles of the lines, repeats included, one
    line after the other, and how many each has. A line of fewer than ``width``
    characters is one shingle."""
    raw = [s.encode("utf-32-le", "surrogatepass") + _PAD * max(0, width - len(s)) for s in lines]
    size = np.array([len(r) // 4 for r in raw], np.int64)
    codes = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64), size
    every = mix(_windows((codes + np.uint64(1)) * np.uint64(_BASE), width))
    counts = size - width + 1
    starts = np.cumsum(size) - size
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return every[at], counts


def signatures(lines: list[str], width: int) -> np.ndarray:
    """(lines, VALUES): the smallest hash of each range."""
    hashes, counts = shingles(lines, width)
    place = ((hashes >> np.uint64(32)) * np.uint64(VALUES)) >> np.uint64(32)
    out = np.full(len(lines) * VALUES, _NONE)
    np.minimum.at(out, np.repeat(np.arange(len(lines)) * VALUES, counts) + place.astype(np.int64), hashes.astype(np.uint32))
    out = out.reshape(len(lines), VALUES)
    # an empty range takes the value of the first in its own draw of ranges that has one
    given = out.copy()
    row, place = np.nonzero((out == _NONE) & (out != _NONE).any(1, keepdims=True))
    for draw in DONORS:
        value = given[row, draw[place]]
        have = value != _NONE
        out[row[have], place[have]] = value[have]
        row, place = row[~have], place[~have]
        if not row.size:
            break
    return out


def bands(lines: list[str], width: int) -> np.ndarray:
    """(lines, BANDS): hashed groups of values, with their number."""
    values = signatures(lines, width).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(_BASE)
    for k in range(ROWS):
        keys = mix(keys + values[:, k * BANDS : (k + 1) * BANDS])
    return keys.view(np.int64)


def sets(lines: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each line."""
    hashes, counts = shingles(lines, width)
    out, end = [], 0
    for n in counts.tolist():
        h = np.sort(hashes[end : end + n])
        fresh = np.empty(n, bool)
        fresh[:1] = True
        np.not_equal(h[1:], h[:-1], out=fresh[1:])
        out.append(h[fresh])
        end += n
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    if len(x) < len(y):
        x, y = y, x
    at = x.searchsorted(y)
    at[at == len(x)] = 0
    return int(np.count_nonzero(x[at] == y)) if len(x) else 0


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bitmap in which each hash of a set gives one of 64 * ``WORDS`` bits."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(found % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of every line; null text has no line."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return each.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def shingle_hashes(line: str, width: int) -> Column:
    """Hashes of a line's shingles, repeats included: its code points are laid out four
    bytes each once (bound as ``b``), so that a shingle is cut without a walk over the
    line. A line of fewer than ``width`` characters is one shingle."""
    size = 4 * width
    one = f"transform(sequence(0, greatest(octet_length(b) - {size}, 0), 4), i -> xxhash64(substring(b, i + 1, {size})))"
    return F.expr(f"transform(array(encode({line}, 'UTF-32')), b -> {one})[0]")


WORD_NAMES = [f"b{w}" for w in range(COLUMNS)]


def bitmaps(rows: DataFrame, width: int) -> DataFrame:
    """(node, n, b0, b1, ...) of rows (node, n, line): set size and bitmap."""
    each = rows.select("node", "n", F.explode(shingle_hashes("line", width)).alias("x"))
    word, bit = F.col("x").bitwiseAND(COLUMNS - 1), F.expr(f"shiftleft(1L, cast(shiftright(x, {COLUMNS.bit_length() - 1}) & 63 as int))")
    each = each.select("node", "n", word.alias("word"), bit.alias("bit"))
    return each.groupBy("node", "n").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(x) for w, x in enumerate(WORD_NAMES)])


def total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def keyed_lines(full: DataFrame, width: int) -> DataFrame:
    """(node, h1, h2, first, rows, n, head, key), written: each distinct line with its
    first place, number of rows and set size, once for each of its keys; ``head``
    marks one of these rows."""
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("line").alias("line"))
    own = ["node", "h1", "h2", "first", "rows"]
    classes = classes.select(F.monotonically_increasing_id().alias("node"), *own[1:], F.sort_array(F.array_distinct(shingle_hashes("line", width))).alias("set"))
    each = classes.select(*own, "set", F.posexplode("set").alias("i", "x"))
    place = lambda x: F.expr(f"shiftright(shiftright({x}, 32) * {RANGES}, 32)")
    begins = (F.col("i") == 0) | (F.size("set") <= SHORT) | (place("x") != place("get(set, i - 1)"))
    run = [F.expr(f"get(set, (i + {k}) % size(set))") for k in range(RUN)]
    return materialize(each.where(begins).select(*own, F.size("set").cast("long").alias("n"), (F.col("i") == 0).alias("head"), F.xxhash64(*run).alias("key")), "lines")


def line_dedup(docs: DataFrame, threshold: float = 0.8, width: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: (doc_id, line_no, component_doc_id, component_line_no, kept).

    Lines are linked when the Jaccard similarity of their shingle sets is at
    least ``threshold`` (taken as the simplest ratio near it, so that equality is
    exact); components keep their first line (by id, then number; a null id comes
    first). Lines of white space alone are linked with nothing and kept. A null
    text has no lines, an empty one has one blank line; repeated rows of an id give
    repeated result rows. Empty tables give empty results; other columns are
    ignored.
    """
    every = lines(docs, id_col, text_col)
    full = every.where(F.regexp_like("line", F.lit("(?U)\\S")))
    ratio = Fraction(threshold).limit_denominator(10_000)
    p, q = ratio.numerator, ratio.denominator
    place = F.struct("doc_id", "line_no")
    keyed = keyed_lines(full, width)
    reclaim(docs.sparkSession)
    classes = keyed.where("head").drop("head", "key")
    texts: list[DataFrame] = []
    maps: list[DataFrame] = []

    def whole(nodes: DataFrame) -> DataFrame:
        """(node, n, line) of nodes, written."""
        wanted = materialize(classes.select("node", "n", "h1", "h2").join(nodes, "node", "left_semi"), "wanted")
        few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        found = full.select("h1", "h2", "line").join(F.broadcast(wanted) if few else wanted, ["h1", "h2"])
        out = materialize(found.groupBy("node", "n").agg(F.first("line").alias("line")), "texts")
        discard(wanted)
        return out

    def sized(pairs: DataFrame) -> DataFrame:
        """The pairs whose set sizes allow the threshold."""
        size = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
        return pairs.join(size("a"), "a").join(size("b"), "b").where(q * F.least("na", "nb") >= p * F.greatest("na", "nb")).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are as similar as the threshold."""
        t = lambda x: texts[0].select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("line").alias(f"t{x}"))
        both = F.size(F.array_intersect(shingle_hashes("ta", width), shingle_hashes("tb", width)))
        links = pairs.join(t("a"), "a").join(t("b"), "b").where((p + q) * both >= p * (F.col("na") + F.col("nb")))
        return materialize(links.select("a", "b"), "links")

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among the first pairs, which name every line that shares a list."""
        pairs = materialize(pairs, "pairs")
        texts.append(whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        links = verified(sized(pairs))
        discard(pairs)
        return links

    def split(mixed: DataFrame) -> DataFrame:
        """Lists of members whose set sizes are near enough."""
        maps.append(materialize(bitmaps(texts[0].join(mixed.select("node").distinct(), "node", "left_semi"), width), "bits"))
        level = lambda x: F.floor(F.log(x) / F.log(F.lit(threshold**-2)))
        # a hair above the largest size, as its logarithm is rounded
        sizes = maps[0].select("node", F.sequence(level(F.col("n")), level(F.col("n") / threshold * (1 + 1e-9))).alias("levels"))
        each = mixed.join(sizes, "node").select("key", "node", F.explode("levels").alias("level"))
        return each.select(F.xxhash64("key", "level").alias("key"), "node")

    def match(left: str, right: str) -> Column:
        """Whether set sizes and bitmaps allow the threshold: with d elements apart,
        the intersection is (n + m - d) / 2 and the union (n + m + d) / 2."""
        n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
        apart = total([F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}"))) for w in WORD_NAMES])
        return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * apart <= (q - p) * (n + m))

    def settle(pairs: DataFrame) -> DataFrame:
        """The links among pairs, of which bitmaps tell most apart."""
        x, y = maps[0].alias("x"), maps[0].alias("y")
        near = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(match("x", "y"))
        return verified(near.select("a", "b"))

    def compare(mixed: DataFrame) -> DataFrame:
        pairs = cross_pairs(mixed, lambda keys: keys.join(maps[0], "node"), match)
        links = verified(pairs)
        discard(pairs)
        return links

    labels = link(keyed.select("key", "node"), verify, compare, rounds=ROUNDS, native=True, split=split, settle=settle, small=SMALL, parts=PARTS)
    # lines that occur once and have no link stay as they are
    linked = classes.select("node", "h1", "h2", "rows", "first").join(labels, "node", "left").where("rows > 1 or root is not null")
    linked = materialize(linked.select("h1", "h2", "first", F.coalesce("root", "node").alias("root")), "linked")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    heads = materialize(linked.join(heads, "root").select("h1", "h2", "head"), "heads")
    few = heads.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    out = every.select("doc_id", "line_no", "h1", "h2").join(F.broadcast(heads) if few else heads, ["h1", "h2"], "left")
    head = F.coalesce("head", place)
    return out.select(
        F.col("doc_id").alias(id_col), "line_no", head["doc_id"].alias("component_doc_id"), head["line_no"].alias("component_line_no"), head.eqNullSafe(place).alias("kept")
    )
