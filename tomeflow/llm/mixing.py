"""Mixing sources to target weights by Poisson replication.

A source of size s and target share w gets the mean repetition rate
w * total / s. Each document's count is the inverse of that Poisson
distribution at a uniform number hashed from its id, and from the row where
several have one id or none; documents are exploded by their counts and shuffled
globally by a second hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeflow.llm.common import BROADCAST_KEYS, gapless, materialize, partitions, uniform

#: Up to so many sources, of so many bytes of names, their rates are broadcast;
#: beyond, they are joined with salt.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 16 << 20
#: Copies that one row unrolls to at a time.
UNROLLED = 1 << 16


def poisson_inverse(rate: float, u: np.ndarray) -> np.ndarray:
    """The least k with P(X <= k) > u. Terms are summed over twelve deviations and
    thirty to either side of the mean, whatever the rate; what lies outside is less
    than a draw can tell."""
    if rate <= 0:
        return np.zeros(len(u), np.int64)
    reach = 12 * math.sqrt(rate) + 30
    low, high = max(0, int(rate - reach)), int(rate + reach)
    steps = np.log(rate) - np.log(np.arange(low + 1, high + 1, dtype=np.float64))
    logs = np.concatenate(([0.0], np.cumsum(steps))) + (low * math.log(rate) - rate - math.lgamma(low + 1))
    return low + np.searchsorted(np.cumsum(np.exp(logs)), u, side="right").astype(np.int64)


@F.pandas_udf(T.LongType())  # a type, as a text needs a session when this is imported
def _counts(rate: pd.Series, u: pd.Series) -> pd.Series:
    out = np.zeros(len(rate), np.int64)
    rates, draws = rate.to_numpy(), u.to_numpy()
    values, place = np.unique(rates, return_inverse=True)
    for k, v in enumerate(values):
        own = place == k
        out[own] = poisson_inverse(float(v), draws[own])
    return pd.Series(out)


def source_rates(docs: DataFrame, source_col: str, size: str, weights: dict[str | None, float] | None = None, volume: float = 1.0) -> DataFrame:
    """(source, rate): mean repetitions so that source shares of the summed
    ``size`` meet the weights (equal ones by default; named sources get their
    weight, unnamed none) at ``volume`` times the input's size."""
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.expr(size)).cast("double").alias("__size"))
    if weights is None:
        weighted = sizes.withColumn("__w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "__s string, __w double")
        weighted = sizes.join(F.broadcast(given), F.col("__source").eqNullSafe(F.col("__s")), "left").select("__source", "__size", F.coalesce("__w", F.lit(0.0)).alias("__w"))
    sums = weighted.agg(F.sum("__size").alias("__total"), F.sum(F.when(F.col("__size") > 0, F.col("__w"))).alias("__ws"))
    rate = F.when(F.col("__size") > 0, F.lit(float(volume)) * F.col("__w") / F.col("__ws") * F.col("__total") / F.col("__size")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(sums)).select("__source", F.coalesce(rate, F.lit(0.0)).alias("__rate"))


def _marked(docs: DataFrame, keys: DataFrame, on: list[str], mark: str) -> DataFrame:
    """``docs`` with ``mark``: true where ``on`` occurs in the distinct ``keys``, else null."""
    keys = materialize(keys.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(on)], F.lit(True).alias(mark)), "keys")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = [F.col(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(on)]
    return docs.join(F.broadcast(keys) if few else keys, same, "left").drop(*[f"__k{n}" for n in range(len(on))])


def row_hash(docs: DataFrame):
    """A hash of all columns; those with maps in them are hashed as JSON."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*columns)


def own_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``__own``: what tells a row from others of its id (a hash of its
    columns, and a row number for rows repeated whole); null for an id, null too,
    of one row. Rows are hashed only where their id repeats. Hashes skip nulls, so such
    rows hash by their id alone."""
    ids = docs.select(F.col(id_col).alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    repeated = materialize(ids.where("__n > 1").select("__id"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("__own", F.lit(None).cast("long"))
    rows = docs.select("*", F.monotonically_increasing_id().alias("__row")).withColumn("__id", F.col(id_col))
    rows = _marked(rows, repeated, ["__id"], "__many").withColumn("__hash", F.when(F.col("__many"), row_hash(docs)))
    counts = rows.where("__many").groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    rows = _marked(rows, counts.where("__n > 1").select("__id", "__hash"), ["__id", "__hash"], "__copy")
    own = F.xxhash64("__hash", F.when(F.col("__copy"), F.col("__row")))
    return rows.withColumn("__own", F.when(F.col("__many"), own)).drop("__row", "__hash", "__id", "__many", "__copy")


def poisson_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: str = "octet_length(text) + 16", weights: dict | None = None, volume: float = 1.0, seed: int = 23) -> DataFrame:
    """``docs`` with ``__own`` (see ``own_rows``), ``__rate`` and ``__count``. Null
    sources form a source of their own; a null size counts 16 bytes; every row has
    its own draw, rows of one id or of none too."""
    size = f"coalesce({size}, 16)"
    rates = materialize(source_rates(docs, source_col, size, weights, volume), "rates")
    docs = own_rows(docs, id_col)
    n, names = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("__source").cast("string"))), F.lit(0))).first()
    if n <= BROADCAST_SOURCES and names <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__source")))
    else:  # many sources: salt, so that a hot source is spread over tasks
        salts = partitions(docs.sparkSession)
        spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn("__salt2", F.pmod(F.xxhash64(F.lit(seed + 2), id_col, "__own"), F.lit(salts)).cast("int"))
        joined = salted.join(spread, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__salt2") == F.col("__salt"))).drop("__salt", "__salt2")
    u = uniform(F.col(id_col), F.col("__own"), seed=seed)
    return joined.withColumn("__count", _counts(F.col("__rate"), u)).drop("__source")


def _copies(counted: DataFrame, out: str) -> DataFrame:
    """A row for each copy, numbered by ``out``; many copies are unrolled in two steps,
    so that no long array is built."""
    spans = counted.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1, F.lit(UNROLLED).cast("long"))))
    each = F.explode(F.sequence("__at", F.least(F.col("__at") + UNROLLED, "__count") - 1))
    return spans.withColumn(out, each).drop("__at")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: str = "octet_length(text) + 16", weights: dict | None = None, volume: float = 1.0, seed: int = 23) -> DataFrame:
    """``docs`` replicated and globally shuffled; adds ``mix_copy`` (from 0) and
    ``mix_key`` (the shuffle's order, unsigned), with an underscore after them where
    ``docs`` has such a column. An empty table stays empty."""
    copy, key = free_name(docs, "mix_copy"), free_name(docs, "mix_key")
    counted = poisson_counts(docs, id_col, source_col, size, weights, volume, seed).where("__count > 0")
    copies = _copies(counted, copy).drop("__rate", "__count")
    keyed = copies.withColumn(key, F.xxhash64(F.lit(seed + 1), id_col, copy, "__own")).drop("__own")
    return keyed.repartition(partitions(docs.sparkSession), key).sortWithinPartitions(key)


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: str = "octet_length(text) + 16", weights: dict | None = None, volume: float = 1.0, seed: int = 23) -> DataFrame:
    """The mix without texts: (id, source, n_copies, copy, rate, position), one
    row per emitted copy; ``position`` is its gapless place in the shuffle. Null ids
    and null sources are kept as such; an empty table gives no row."""
    counted = poisson_counts(docs, id_col, source_col, size, weights, volume, seed).where("__count > 0")
    flat = counted.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), "__count", F.round("__rate", 9).alias("rate"), "__own")
    rows = _copies(flat, "copy").withColumnRenamed("__count", "n_copies").withColumn("__key", F.xxhash64(F.lit(seed + 1), "__id", "copy", "__own")).drop("__own")
    ranked = gapless(rows, "__key", ["__id", "copy"], "position")
    return ranked.select(F.col("__id").alias(id_col), "source", "n_copies", "copy", "rate", F.col("position").cast("long").alias("position"))


def expected_share(rate: float, k: int) -> float:
    """P(count = k) of the Poisson distribution, for tests and reports."""
    return math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
