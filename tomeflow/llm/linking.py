"""Verified links within candidate lists, without a group's all-pairs join.

A list is a key with the nodes that carry it, each once. Lists of a few nodes give
all their pairs; in longer ones round one compares each node with two pivots, so a
group of copies collapses by as many comparisons as it has rows. Later rounds look only at lists
that still hold several components and compare their members with a pivot drawn
anew. At the end the members outside a list's largest component are compared with
the rest: by ``cross_pairs``, inside a join, or in blocks. Every pair of a list thus is compared or already connected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import BROADCAST_KEYS, components, discard, materialize, reclaim

Verify = Callable[[DataFrame], DataFrame]
#: From nodes to the columns by which pairs of them are tested.
Payload = Callable[[DataFrame], DataFrame]


def shared_lists(lists: DataFrame, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pivots, members): (key, c, p0, p1) of lists of two nodes or more, with two
    pivots each, and (key, node, c, p0, p1) of those of more than two. Pivots are
    minima and maxima, so a hot key is combined before any shuffle, and most lists
    need no look at their members. They are made in ``parts`` of the keys."""
    every = []
    for k in range(parts):
        own = lists.where(F.pmod("key", F.lit(parts)) == k) if parts > 1 else lists
        found = own.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("p0"), F.max("node").alias("p1"))
        every.append(materialize(found.where("p0 <> p1"), "pivots"))
        if parts > 1:
            del found
            reclaim(lists.sparkSession)
    pivots = every[0]
    if parts > 1:
        pivots = materialize(reduce(DataFrame.union, every), "pivots")
        discard(*every)
    longer = pivots.where("c > 2")
    few = longer.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return pivots, materialize(lists.join(F.broadcast(longer) if few else longer, "key"), "lists")


def star_pairs(pivots: DataFrame, members: DataFrame, small: int) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of lists of ``small`` nodes or fewer (a bound
    of (small - 1) / 2 pairs for a row), and each node of others with their pivots."""
    pair = members.where(F.col("c") > small).select("node", F.explode(F.array("p0", "p1")).alias("p")).where("p <> node")
    pair = pair.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).union(pivots.where("c = 2").select("p0", "p1"))
    if small > 2:
        few = members.where(F.col("c") <= small)
        other = few.select(F.col("key").alias("__k"), F.col("node").alias("b"))
        pair = pair.union(few.join(other, (F.col("key") == F.col("__k")) & (F.col("node") < F.col("b"))).select("node", "b"))
    return pair.distinct()


def mixed_lists(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp, major): lists with several components, and the largest."""
    roots = labels.withColumnRenamed("node", "__n")
    labelled = shared.select("key", "node").join(roots, F.col("node") == F.col("__n"), "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    sizes = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("__c"))
    major = sizes.groupBy("key").agg(F.max_by("comp", "__c").alias("major"), F.count(F.lit(1)).alias("__k")).where("__k > 1").drop("__k")
    return materialize(labelled.join(major, "key"), "mixed")


def drawn_pairs(mixed: DataFrame, draw: int, pivots: int = 3, hands: int = 4) -> DataFrame:
    """Distinct (a, b) of members and pivots of their list drawn by hash. Lists of a
    hand draw alike, so that the many lists of one group share a few pivots."""
    drawn = [F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(draw * pivots + k), F.pmod("key", F.lit(hands)), "node")).alias(f"p{k}") for k in range(pivots)]
    each = mixed.join(mixed.groupBy("key").agg(*drawn), "key").select("node", "comp", F.explode(F.array(*[f"p{k}" for k in range(pivots)])).alias("p"))
    pair = each.where(F.col("comp") != F.col("p.comp"))
    return pair.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def cross_pairs(mixed: DataFrame, payload: Payload, match: Callable[[str, str], Column]) -> DataFrame:
    """Distinct (a, b) in one list but different components, for which ``match(l, r)`` holds
    (columns of ``payload(nodes)`` under those aliases, and ``l.key``). A pair is given
    in the first list that both are in only."""
    keys = mixed.groupBy("node").agg(F.collect_list("key").alias("keys"))
    rows = materialize(mixed.join(payload(keys), "node"), "cross")
    on = (
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.comp") != F.col("r.comp"))
        & ((F.col("r.comp") == F.col("r.major")) | (F.col("l.node") < F.col("r.node")))
        & match("l", "r")
        & (F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key"))
    )
    pairs = rows.where("comp <> major").alias("l").join(rows.alias("r"), on)
    pairs = materialize(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct(), "apart")
    discard(rows)
    return pairs


def relabel(labels: DataFrame, links: DataFrame, native: bool = False) -> DataFrame:
    """``labels`` (node, root) after more links: components of roots are contracted."""
    node = labels.withColumnRenamed("node", "__n").withColumnRenamed("root", "__r")
    up = links.join(node, F.col("a") == F.col("__n"), "left").select(F.coalesce("__r", "a").alias("a"), "b")
    up = up.join(node, F.col("b") == F.col("__n"), "left").select("a", F.coalesce("__r", "b").alias("b"))
    merged = components(up, native=native).select(F.col("node").alias("__old"), F.col("root").alias("__new"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.union(fresh.select("node", F.col("node").alias("root")))
    joined = every.join(merged, F.col("root") == F.col("__old"), "left")
    return materialize(joined.select("node", F.coalesce("__new", "root").alias("root")), "labels")


def link(
    lists: DataFrame, verify: Verify, last_pass: Verify, rounds: int = 2, native: bool = False, split: Callable[[DataFrame], DataFrame] | None = None,
    settle: Verify | None = None, small: int = 2, parts: int = 1,
) -> DataFrame:
    """(node, root) of every node with a verified link. ``verify`` gets distinct
    pairs (a, b) and returns a written table (a, b) of the true links among them;
    ``last_pass`` gets the lists (key, node, comp, major) that hold several components
    in the end, and returns such a table too.
    ``rounds`` of drawn pivots only save comparisons in the last pass. ``native``
    keeps to DataFrame functions. ``split`` makes finer lists (key, node) of those
    that still hold several components; ``settle`` verifies drawn pairs, if they can
    be filtered better then (else ``verify`` does). Lists of up to ``small`` nodes are settled by round one."""
    pivots, members = shared_lists(lists, parts)
    links = verify(star_pairs(pivots, members, small))
    labels = components(links, native=native)
    mixed = mixed_lists(members.where(F.col("c") > small), labels)
    discard(links, pivots, members)
    if split:
        last, mixed = mixed, mixed_lists(split(mixed.select("key", "node")), labels)
        discard(last)
    for draw in range(rounds):
        links = (settle or verify)(drawn_pairs(mixed, draw))
        if links.isEmpty():
            break
        labels = relabel(labels, links, native)
        last, mixed = mixed, mixed_lists(mixed, labels)
        discard(links, last)
    links = last_pass(mixed)
    discard(mixed)
    if not links.isEmpty():
        labels = relabel(labels, links, native)
    discard(links)
    return labels
