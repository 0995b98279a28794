"""Legible names and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.operators.hierarchy import paths


def symbol_id(*parts: Column) -> Column:
    """SHA-1 of a canonical text."""
    return F.sha1(F.concat_ws("-", *parts))


def raw_name(name: Column, kind: Column, func_class: Column | None = None, safe_operator: Column | None = None, kind_rank: Column | None = None) -> Column:
    """Name, else the operator's safe name, else a reserved name: '2' and the
    class of a special function, '_NN' and the kind of an unnamed symbol."""
    reserved = F.concat(F.lit("_"), F.lpad(F.coalesce(kind_rank, F.lit(0)).cast("string"), 2, "0") if kind_rank is not None else F.lit("00"), kind)
    special = F.when(func_class.isin("constructor", "destructor", "conversion"), F.concat(F.lit("2"), func_class)) if func_class is not None else None
    return F.coalesce(*[x for x in (special, safe_operator, F.when(name != "", name)) if x is not None], reserved)


def _common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two texts of at most ``most`` characters:
    the number of prefix lengths at which they agree."""
    return F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))), F.lit(0))


def legible_names(symbols: DataFrame, raw: str = "raw", scope: str = "parent_id", hex_id: str = "id", width: int = 40) -> DataFrame:
    """Adds ``legible``: the raw name where it is unique in its scope, else with
    '-0' and the shortest id prefix that separates it from every other holder. In
    id order only the neighbours matter, so a name held n times costs n log n."""
    w = Window.partitionBy(scope, raw).orderBy(hex_id)
    before, after = F.lag(hex_id).over(w), F.lead(hex_id).over(w)
    near = symbols.withColumn("__b", before).withColumn("__a", after)
    same = F.greatest(_common_prefix(F.col(hex_id), F.col("__b"), width), _common_prefix(F.col(hex_id), F.col("__a"), width))
    tail = F.concat(F.lit("-0"), F.substring(F.col(hex_id), F.lit(1), same + 1))
    alone = F.col("__b").isNull() & F.col("__a").isNull()
    return near.withColumn("legible", F.when(alone, F.col(raw)).otherwise(F.concat(F.col(raw), tail))).drop("__b", "__a")


def legible_paths(symbols: DataFrame, legible: bool = True) -> DataFrame:
    """(id, path): legible names from the root; the plain hex id when off."""
    if not legible:
        return symbols.select("id", F.array(F.lower("id")).alias("path"))
    return paths(symbols, F.col("legible")).select("id", "path")


def id_text(hex_id: Column, style: str = "base64") -> Column:
    """Id in padded base-64 or hex of either case."""
    return {"base64": F.base64(F.unhex(hex_id)), "hex": F.lower(hex_id), "HEX": F.upper(hex_id)}[style]
