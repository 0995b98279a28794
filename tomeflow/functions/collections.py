"""Array and map functions of the template helper library, as native column
expressions. Arrays are typed; objects are maps or structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeflow.functions.logic import truthy
from tomeflow.functions.strings import Int, Str, c, i, s, wrap


def arr(*items: Str) -> Column:
    return F.array(*[c(x) for x in items])


def range_(start: Int, stop: Int | None = None, step: int = 1) -> Column:
    """Half-open integer range; a negative step counts down; empty if it cannot move."""
    a, b = (F.lit(0), i(start)) if stop is None else (i(start), i(stop))
    last = b - (1 if step > 0 else -1)
    some = a < b if step > 0 else a > b
    return F.when(some, F.sequence(a, F.when(some, last).otherwise(a), F.lit(step))).otherwise(F.array().cast("array<int>"))


def size(a: Str) -> Column:
    return F.size(c(a))


def length(x: Str) -> Column:
    return F.length(c(x))


def keys(m: Str) -> Column:
    return F.map_keys(c(m))


def values(m: Str) -> Column:
    return F.map_values(c(m))


def items(m: Str) -> Column:
    return F.map_entries(c(m))


def delete(a: Str, item: Str) -> Column:
    """Without the items equal to ``item``."""
    return F.array_remove(c(a), s(item))


def delete_key(m: Str, key: str) -> Column:
    return F.map_filter(c(m), lambda k, v: k != key)


def has(a: Str, item: Column) -> Column:
    return F.coalesce(F.array_contains(c(a), item), F.lit(False))


def has_key(m: Str, key: str) -> Column:
    return F.map_contains_key(c(m), key)


def has_any(a: Str, wanted: Column) -> Column:
    return F.coalesce(F.arrays_overlap(c(a), wanted), F.lit(False))


def get(a: Str, index: Int, default: Column | None = None) -> Column:
    """Item at a wrapped index, or the default."""
    found = F.get(c(a), wrap(index, F.size(c(a))))
    return found if default is None else F.coalesce(found, default)


def get_key(m: Str, key: str, default: Column | None = None) -> Column:
    found = F.try_element_at(c(m), F.lit(key))
    return found if default is None else F.coalesce(found, default)


lookup = get_key


def first(a: Str) -> Column:
    return F.try_element_at(c(a), F.lit(1))


def last(a: Str) -> Column:
    return F.try_element_at(c(a), F.lit(-1))


def reverse(a: Str) -> Column:
    return F.reverse(c(a))


def reverse_map(m: Str) -> Column:
    """Entries of a map from last to first."""
    return F.reverse(F.map_entries(c(m)))


def index_of(a: Str, item: Column) -> Column:
    """0-based position, or -1."""
    return F.array_position(c(a), item) - 1


def key_of(m: Str, value: Column) -> Column:
    """First key with the value."""
    return F.try_element_at(F.transform(F.filter(F.map_entries(c(m)), lambda e: e["value"] == value), lambda e: e["key"]), F.lit(1))


def update(a: Str, b: Str) -> Column:
    """The first array followed by the second one's unseen items."""
    return F.concat(c(a), F.array_except(c(b), c(a)))


def update_map(a: Str, b: Str) -> Column:
    """Overlay: the second map wins."""
    return F.map_concat(F.map_filter(c(a), lambda k, v: ~F.map_contains_key(c(b), k)), c(b))


def concat(*arrays: Str) -> Column:
    return F.concat(*[c(a) for a in arrays])


def sort(a: Str) -> Column:
    return F.array_sort(c(a))


def sort_by(a: Str, key: str) -> Column:
    """Structs by a field; those lacking it come first; stable by position."""
    indexed = F.transform(c(a), lambda x, k: F.struct(x[key].isNotNull().cast("int").alias("has"), x[key].alias("by"), k.alias("at"), x.alias("item")))
    return F.transform(F.sort_array(indexed), lambda x: x["item"])


def filter_by(a: Str, *keys_: str, kind: str = "string") -> Column:
    """Structs of which any of the fields is truthy."""
    return F.filter(c(a), lambda x: _any(x, keys_, kind))


def any_of_by(a: Str, *keys_: str, kind: str = "string") -> Column:
    return F.exists(c(a), lambda x: _any(x, keys_, kind))


def _any(x: Column, keys_: tuple[str, ...], kind: str) -> Column:
    out = truthy(x[keys_[0]], kind)
    for k in keys_[1:]:
        out = out | truthy(x[k], kind)
    return out


def fill(a: Str, value: Column, start: Int = 0, stop: Int | None = None) -> Column:
    """Overwrites a wrapped index range."""
    n = F.size(c(a))
    lo, hi = wrap(start, n), n if stop is None else wrap(stop, n)
    return F.transform(c(a), lambda x, k: F.when((k >= lo) & (k < hi), value).otherwise(x))


def count(a: Str, item: Column) -> Column:
    return F.size(F.filter(c(a), lambda x: x.eqNullSafe(item)))


def replace(a: Str, old: Column, new: Column) -> Column:
    return F.transform(c(a), lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def chunk(a: Str, n: int) -> Column:
    """Pieces of ``n`` items."""
    return F.transform(range_(F.lit(0), F.size(c(a)), n), lambda k: F.slice(c(a), k + 1, F.lit(n)))


def chunk_text(x: Str, n: int) -> Column:
    return F.transform(range_(F.lit(0), F.length(c(x)), n), lambda k: F.substring(c(x), k + 1, F.lit(n)))


def group_by(a: Str, key: str) -> Column:
    """Map of a field's values to their structs; items without it are dropped; keys
    in first-seen order."""
    kept = F.filter(c(a), lambda x: x[key].isNotNull())
    seen = F.array_distinct(F.transform(kept, lambda x: x[key]))
    return F.map_from_arrays(seen, F.transform(seen, lambda k: F.filter(kept, lambda x: x[key] == k)))


def pluck(a: Str, key: str) -> Column:
    return F.transform(c(a), lambda x: x[key])


def unique(a: Str) -> Column:
    return F.array_sort(F.array_distinct(c(a)))


def flatten(a: Str, path: str) -> Column:
    """Inner arrays at a dotted path, concatenated; missing ones are empty."""
    inner = F.filter(F.transform(c(a), lambda x: x.getField(path) if "." not in path else _path(x, path)), lambda y: y.isNotNull())
    return F.flatten(inner)


def flatten_unique(a: Str, path: str, key: str) -> Column:
    """As ``flatten``, keeping the first item of each key."""
    flat = flatten(a, path)
    names = F.transform(flat, lambda x: x[key])
    return F.filter(flat, lambda x, k: F.array_position(names, x[key]) == k + 1)


def _path(x: Column, path: str) -> Column:
    for name in path.split("."):
        x = x[name]
    return x


def each(a: Str, text: Callable[[Column, Column, Column], Column], empty: str = "") -> Column:
    """Concatenated text of the items: ``text(item, index, is_last)``; ``empty`` for
    an empty array or none."""
    n = F.size(c(a))
    body = F.array_join(F.transform(c(a), lambda x, k: text(x, k, k == n - 1)), "")
    return F.when(c(a).isNull() | (n == 0), F.lit(empty)).otherwise(body)
