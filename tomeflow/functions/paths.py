"""Text-only path functions ('/' separated), as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeflow.functions.strings import Str, c


def parent_dir(p: Str) -> Column:
    """Up to and with the last '/' before the last name; '' without one."""
    return F.regexp_extract(c(p), "(?s)^(.*/)?[^/]+/?$", 1)


def file_name(p: Str) -> Column:
    return F.substring_index(c(p), "/", -1)


def extension(p: Str) -> Column:
    return F.regexp_extract(file_name(p), "(\\.[^.]*)$", 1)


def with_extension(p: Str, ext: str) -> Column:
    return F.concat(F.regexp_replace(c(p), "\\.[^./]*$", ""), F.lit("." + ext.lstrip(".")))


def append(a: Str, b: Str) -> Column:
    """Joined by one '/'; an absolute second path replaces the first."""
    joined = F.concat(F.regexp_replace(c(a), "/+$", ""), F.lit("/"), c(b))
    return F.when(F.startswith(c(b), F.lit("/")) | (c(a) == ""), c(b)).otherwise(joined)


def is_absolute(p: Str) -> Column:
    return F.regexp_like(c(p), F.lit("^(/|[A-Za-z]:[\\\\/])"))


def absolute(p: Str, base: Str) -> Column:
    return F.when(is_absolute(p), c(p)).otherwise(append(base, p))


def posix_style(p: Str) -> Column:
    return F.replace(c(p), F.lit("\\"), F.lit("/"))


def is_dirsy(p: Str) -> Column:
    return F.endswith(c(p), F.lit("/"))


def make_dirsy(p: Str) -> Column:
    return F.when(is_dirsy(p), c(p)).otherwise(F.concat(c(p), F.lit("/")))


def has_prefix(p: Str, prefix: Str) -> Column:
    """Whether a path is the prefix or lies under it."""
    base = F.regexp_replace(c(prefix), "/+$", "")
    return (F.regexp_replace(c(p), "/+$", "") == base) | F.startswith(c(p), F.concat(base, F.lit("/")))


def normalize(p: Str) -> Column:
    """Lexically without '.', '..' and repeated '/'."""
    parts = F.filter(F.split(c(p), "/"), lambda x: (x != "") & (x != "."))
    rooted = F.startswith(c(p), F.lit("/"))

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        keep = F.when((x == "..") & rooted & (F.size(acc) == 0), acc).otherwise(F.concat(acc, F.array(x)))
        return F.when(up, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(keep)

    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    out = F.when(rooted, F.concat(F.lit("/"), body)).otherwise(body)
    return F.when(c(p).isNotNull() & (out == "") & (c(p) != ""), F.lit(".")).otherwise(out)


def _names(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def relative(target: Str, base_dir: Str) -> Column:
    """Lexically relative path of ``target`` from directory ``base_dir``."""
    t, b = _names(c(target)), _names(c(base_dir))
    shared = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size(t), F.size(b))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, k: F.struct(
            (acc["n"] + F.when(acc["on"] & (F.get(t, k) == F.get(b, k)), 1).otherwise(0)).alias("n"),
            (acc["on"] & F.coalesce(F.get(t, k) == F.get(b, k), F.lit(False))).alias("on"),
        ),
        lambda acc: acc["n"],
    )
    ups = F.array_repeat(F.lit(".."), F.greatest(F.lit(0), F.size(b) - shared))
    downs = F.slice(t, shared + 1, F.size(t))
    out = F.array_join(F.concat(ups, downs), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def relativize(to: Str, source: Str) -> Column:
    """URL of page ``to`` as seen from page ``source``: './' is explicit, a hash is
    kept, the same page is its hash or file name; '#' for no target."""
    target, base = c(to), c(source)
    hash_at = F.locate("#", target)
    path = F.when(hash_at > 0, F.substring(target, F.lit(1), hash_at - 1)).otherwise(target)
    tag = F.when(hash_at > 0, F.substring(target, hash_at, F.length(target))).otherwise(F.lit(""))
    same = F.when(tag != "", tag).when(is_dirsy(path), F.lit("./")).otherwise(file_name(path))
    rel = relative(path, parent_dir(base))
    dotted = F.when(F.startswith(rel, F.lit("../")) | F.startswith(rel, F.lit("./")), rel).otherwise(F.concat(F.lit("./"), rel))
    return (
        F.when(target.isNull() | (target == ""), F.lit("#"))
        .when(~F.startswith(target, F.lit("/")), target)
        .when(base.isNull() | (base == ""), target)
        .when(path == base, same)
        .otherwise(F.concat(dotted, tag))
    )


def depth_prefix(url: Str) -> Column:
    """'../' for each directory level of a page's url."""
    levels = F.size(_names(c(url)))
    return F.repeat(F.lit("../"), F.greatest(F.lit(0), levels - 1))
