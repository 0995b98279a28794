"""String functions of the template helper library, as native column expressions.

Positions are characters from 0; an index outside the string is wrapped by
``wrap``. Null input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str
Int = Column | int


def c(x: Str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def i(x: Int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def s(x: Str) -> Column:
    """A column, or a literal when given a plain string."""
    return x if isinstance(x, Column) else F.lit(x)


def wrap(index: Int, n: Column) -> Column:
    """Index as is within 0..n, else modulo n (0 for an empty value)."""
    k = i(index)
    safe = F.when(n == 0, F.lit(1)).otherwise(n)
    return F.when(n == 0, F.lit(0)).when((k < 0) | (k > n), ((k % safe) + safe) % safe).otherwise(k)


def capitalize(x: Str) -> Column:
    return F.concat(F.upper(F.substring(c(x), 1, 1)), F.substring(c(x), 2, 1 << 30))


def _fill(fill: str, n: Column) -> Column:
    """``n`` characters of a repeated fill text."""
    return F.substring(F.repeat(F.lit(fill), n), 1, n)


def center(x: Str, width: int, fill: str = " ") -> Column:
    """Pads by half the gap, rounded down, on either side."""
    gap = F.greatest(F.lit(0), F.floor((F.lit(width) - F.length(c(x))) / 2)).cast("int")
    return F.concat(_fill(fill, gap), c(x), _fill(fill, gap))


def ljust(x: Str, width: int, fill: str = " ") -> Column:
    return F.concat(c(x), _fill(fill, F.greatest(F.lit(0), F.lit(width) - F.length(c(x)))))


def rjust(x: Str, width: int, fill: str = " ") -> Column:
    return F.concat(_fill(fill, F.greatest(F.lit(0), F.lit(width) - F.length(c(x)))), c(x))


def slice_(x: Str, start: Int, stop: Int | None = None) -> Column:
    """Characters start..stop with wrapped bounds; empty if start >= stop."""
    n = F.length(c(x))
    a = wrap(start, n)
    b = n if stop is None else wrap(stop, n)
    return F.when(a >= b, F.when(c(x).isNotNull(), F.lit(""))).otherwise(F.substring(c(x), a + 1, b - a))


def count(x: Str, sub: str, start: Int = 0, stop: Int | None = None) -> Column:
    """Overlapping occurrences of ``sub`` that begin before ``stop``."""
    n = F.length(c(x))
    a = wrap(start, n)
    b = n if stop is None else wrap(stop, n)
    at = F.sequence(a, F.greatest(a, b - 1))
    hits = F.filter(at, lambda k: (k < b) & (F.substring(c(x), k + 1, F.lit(len(sub))) == sub))
    return F.when(c(x).isNotNull(), F.size(hits))


def starts_with(x: Str, prefix: str, start: Int = 0, stop: Int | None = None) -> Column:
    return F.startswith(slice_(x, start, stop), F.lit(prefix))


def ends_with(x: Str, suffix: str, start: Int = 0, stop: Int | None = None) -> Column:
    return F.endswith(slice_(x, start, stop), F.lit(suffix))


def expandtabs(x: Str, n: int = 8) -> Column:
    """Each tab becomes ``n`` spaces; columns are not counted."""
    return F.replace(c(x), F.lit("\t"), F.lit(" " * n))


def tab_stops(x: Str, n: int = 8) -> Column:
    """Tabs advance to the next multiple of ``n`` columns."""
    parts = F.split(c(x), "\t")
    return F.aggregate(
        F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), F.element_at(parts, 1),
        lambda acc, part: F.concat(acc, F.repeat(F.lit(" "), F.lit(n) - F.length(acc) % n), part),
    )


def find(x: Str, sub: str, start: Int = 0) -> Column:
    """First position of ``sub`` from ``start``, or -1."""
    return F.locate(sub, c(x), 1) - 1 if isinstance(start, int) and start == 0 else F.locate(sub, c(x), int(start) + 1) - 1


def rfind(x: Str, sub: str, start: Int = 0) -> Column:
    """Last position of ``sub`` at or before ``start`` (default 0), or -1."""
    head = F.substring(c(x), F.lit(1), i(start) + len(sub))
    back = F.locate(sub[::-1], F.reverse(head))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back - len(sub) + 1)


def includes(x: Str, sub: str) -> Column:
    return F.contains(c(x), F.lit(sub))


def char_at(x: Str, index: Int) -> Column:
    return F.substring(c(x), wrap(index, F.length(c(x))) + 1, F.lit(1))


def _all(x: Str, cls: str) -> Column:
    return F.regexp_like(c(x), F.lit(f"\\A{cls}*\\z"))


def is_alnum(x: Str) -> Column:
    return _all(x, "[0-9A-Za-z]")


def is_alpha(x: Str) -> Column:
    return _all(x, "[A-Za-z]")


def is_ascii(x: Str) -> Column:
    return _all(x, "[\\x00-\\x7F]")


def is_digit(x: Str) -> Column:
    return _all(x, "[0-9]")


def is_lower(x: Str) -> Column:
    return _all(x, "[a-z]")


def is_upper(x: Str) -> Column:
    return _all(x, "[A-Z]")


def is_printable(x: Str) -> Column:
    return _all(x, "[\\x20-\\x7E]")


def is_space(x: Str) -> Column:
    return _all(x, "[ \\t\\n\\x0B\\f\\r]")


def is_title(x: Str) -> Column:
    """No ASCII letter after a letter is a capital, none after a non-letter small."""
    return ~F.regexp_like(c(x), F.lit("(^|[^A-Za-z])[a-z]")) & ~F.regexp_like(c(x), F.lit("[A-Za-z][A-Z]"))


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper(x: Str) -> Column:
    return F.translate(c(x), _LOW, _UP)


def lower(x: Str) -> Column:
    return F.translate(c(x), _UP, _LOW)


def swap_case(x: Str) -> Column:
    return F.translate(c(x), _LOW + _UP, _UP + _LOW)


def join(sep: str, array: Str) -> Column:
    """Texts of an array with separators, none while the result is still empty."""
    return F.aggregate(c(array), F.lit(""), lambda acc, x: F.when(acc == "", F.coalesce(x, F.lit(""))).otherwise(F.concat(acc, F.lit(sep), F.coalesce(x, F.lit("")))))


_BLANK = " \t\r\n\x0b\x0c"


def strip(x: Str, chars: str = _BLANK) -> Column:
    return F.btrim(c(x), F.lit(chars))


def lstrip(x: Str, chars: str = _BLANK) -> Column:
    return F.ltrim(c(x), F.lit(chars))


def rstrip(x: Str, chars: str = _BLANK) -> Column:
    return F.rtrim(c(x), F.lit(chars))


def partition(x: Str, sep: str) -> Column:
    """[before, separator, after] of the first separator, [x, '', ''] without."""
    at = F.locate(sep, c(x))
    return F.when(at == 0, F.array(c(x), F.lit(""), F.lit(""))).otherwise(
        F.array(F.substring(c(x), F.lit(1), at - 1), F.lit(sep), F.substring(c(x), at + len(sep), F.length(c(x))))
    )


def rpartition(x: Str, sep: str) -> Column:
    """[before, separator, after] of the last separator, ['', '', x] without."""
    at = rfind(x, sep, F.length(c(x)))
    return F.when(at < 0, F.array(F.lit(""), F.lit(""), c(x))).otherwise(
        F.array(F.substring(c(x), F.lit(1), at), F.lit(sep), F.substring(c(x), at + len(sep) + 1, F.length(c(x))))
    )


def remove_prefix(x: Str, prefix: str) -> Column:
    return F.when(F.startswith(c(x), F.lit(prefix)), F.substring(c(x), len(prefix) + 1, 1 << 30)).otherwise(c(x))


def remove_suffix(x: Str, suffix: str) -> Column:
    return F.when(F.endswith(c(x), F.lit(suffix)), F.substring(c(x), F.lit(1), F.length(c(x)) - len(suffix))).otherwise(c(x))


def _quoted(sep: str) -> str:
    return "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replace(x: Str, old: str, new: str, n: int | None = None) -> Column:
    """All occurrences; with ``n`` the text after the n-th match is dropped."""
    if n is None:
        return F.replace(c(x), F.lit(old), F.lit(new))
    parts = F.split(c(x), _quoted(old))
    cut = F.concat(F.array_join(F.slice(parts, 1, n), new), F.lit(new))
    return F.when(F.size(parts) > n, cut).otherwise(F.array_join(parts, new))


def split(x: Str, sep: str = " ", n: int | None = None) -> Column:
    """Pieces between separators; with ``n`` the rest after n pieces is dropped."""
    parts = F.split(c(x), _quoted(sep))
    return parts if n is None else F.slice(parts, 1, n)


def rsplit(x: Str, sep: str = " ", n: int | None = None) -> Column:
    """Pieces from right to left."""
    parts = F.reverse(F.split(c(x), _quoted(sep)))
    return parts if n is None else F.slice(parts, 1, n)


def split_lines(x: Str, keepends: bool = False) -> Column:
    """Splits at each CR and each LF (so CRLF gives an empty item); no empty item at
    the end."""
    if keepends:
        return F.filter(F.split(c(x), "(?<=[\\r\\n])"), lambda p: p != "")
    parts = F.split(c(x), "[\\r\\n]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def zfill(x: Str, width: int) -> Column:
    signed = F.substring(c(x), 1, 1).isin("+", "-")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(c(x))))
    return F.when(signed, F.concat(F.substring(c(x), 1, 1), zeros, F.substring(c(x), 2, 1 << 30))).otherwise(F.concat(zeros, c(x)))


def repeat(x: Str, n: Int) -> Column:
    return F.repeat(c(x), F.greatest(F.lit(0), i(n)))


# HTML escapes.
HTML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;", "`": "&#x60;", "=": "&#x3D;"}
# Entities of the characters that AsciiDoc reserves.
ASCIIDOC = {
    "~": "&#126;", "^": "&circ;", "_": "&lowbar;", "*": "&ast;", "`": "&grave;", "#": "&num;", "[": "&lsqb;", "]": "&rsqb;", "{": "&lcub;", "}": "&rcub;",
    "<": "&lt;", ">": "&gt;", "\\": "&bsol;", "|": "&verbar;", "-": "&hyphen;", "=": "&equals;", "&": "&amp;", ";": "&semi;", "+": "&plus;", ":": "&colon;",
    ".": "&period;", '"': "&quot;", "'": "&apos;", "/": "&sol;",
}


def escape(x: Str) -> Column:
    out = c(x)
    for k, v in HTML.items():  # the ampersand comes first
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def escape_asciidoc(x: Str) -> Column:
    table = F.create_map(*[F.lit(y) for kv in ASCIIDOC.items() for y in kv])
    return F.array_join(F.transform(F.split(c(x), ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def safe_anchor_id(x: Str) -> Column:
    return F.replace(F.translate(lower(x), " _", "--"), F.lit(":"), F.lit(""))


def strip_namespace(x: Str) -> Column:
    """Text after the last ':' that is outside (), [] and <>."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("tail"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch.isin("(", "[", "<"), 1).when(ch.isin(")", "]", ">"), -1).otherwise(0)
        tail = F.when((ch == ":") & (acc["depth"] == 0), F.lit("")).otherwise(F.concat(acc["tail"], ch))
        return F.struct(depth.alias("depth"), tail.alias("tail"))

    return F.aggregate(F.split(c(x), ""), state, step, lambda acc: acc["tail"])


def detag(x: Str) -> Column:
    """Drops everything from '<' to the next '>' (or the end)."""
    return F.regexp_replace(c(x), "(?s)<[^>]*>?", "")


def words(x: Str) -> Column:
    """Parts of an identifier: at separators, and before a capital after a small
    letter or digit."""
    spaced = F.regexp_replace(c(x), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(spaced, "[^0-9A-Za-z]+", " "), " "), lambda w: w != "")


def kebab_case(x: Str) -> Column:
    return lower(F.array_join(words(x), "-"))


def snake_case(x: Str) -> Column:
    return lower(F.array_join(words(x), "_"))


def pascal_case(x: Str) -> Column:
    return F.array_join(F.transform(words(x), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def camel_case(x: Str) -> Column:
    p = pascal_case(x)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def reindent(x: Str, n: int = 0) -> Column:
    """Removes the indentation common to the non-blank lines, then adds ``n``."""
    rows = F.split(c(x), "\n")
    used = F.filter(rows, lambda r: F.trim(r) != "")
    common = F.coalesce(F.array_min(F.transform(used, lambda r: F.length(r) - F.length(F.ltrim(r)))), F.lit(0))
    return F.array_join(F.transform(rows, lambda r: F.when(F.trim(r) == "", F.lit("")).otherwise(F.concat(F.lit(" " * n), F.substring(r, common + 1, F.length(r))))), "\n")


def collapse_whitespace(x: Str) -> Column:
    """Runs of white space become one space, if any run has two or more."""
    return F.when(F.regexp_like(c(x), F.lit("\\s\\s")), F.regexp_replace(c(x), "\\s+", " ")).otherwise(c(x))


def base16(x: Str, upper_case: bool = True) -> Column:
    """Case of a hex id text."""
    return F.upper(c(x)) if upper_case else F.lower(c(x))


def base64_id(x: Str) -> Column:
    """Padded base-64 of a hex id text."""
    return F.base64(F.unhex(c(x)))
