"""Logic, type, number and date helpers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(x: Column, kind: str | T.DataType) -> Column:
    """false, 0, '' and null are falsy; arrays, maps and structs are truthy."""
    name = kind if isinstance(kind, str) else kind.simpleString()
    if name == "boolean":
        out = x
    elif name in ("tinyint", "smallint", "int", "bigint", "long", "float", "double") or name.startswith("decimal"):
        out = x != 0
    elif name == "string":
        out = x != ""
    else:
        out = x.isNotNull()
    return F.coalesce(out, F.lit(False))


def empty(x: Column, kind: str | T.DataType) -> Column:
    """Falsy, or an array without items; a number never is."""
    name = kind if isinstance(kind, str) else kind.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint", "long", "float", "double"):
        return x.isNull()
    if name.startswith("array"):
        return F.coalesce(F.size(x) == 0, F.lit(True))
    return ~truthy(x, kind)


def and_(*xs: Column, kind: str = "boolean") -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & truthy(x, kind)
    return out


def or_(*xs: Column, kind: str = "string", default: Column | None = None) -> Column:
    """First truthy value, else ``default``."""
    return F.coalesce(*[F.when(truthy(x, kind), x) for x in xs], *([default] if default is not None else []))


def not_(*xs: Column, kind: str = "boolean") -> Column:
    """Whether any argument is falsy."""
    return ~and_(*xs, kind=kind)


def eq(x: Column, *others: Column) -> Column:
    out = F.lit(True)
    for y in others:
        out = out & x.eqNullSafe(y)
    return out


def ne(x: Column, *others: Column) -> Column:
    return ~eq(x, *others)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, null first: a comparator for ``array_sort``."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def select(cond: Column, a: Column, b: Column, kind: str = "boolean") -> Column:
    """``b`` when the condition is empty, else ``a``."""
    return F.when(empty(cond, kind), b).otherwise(a)


def increment(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) + 1


def add(*xs: Column) -> Column:
    out = xs[0].cast("bigint")
    for x in xs[1:]:
        out = out + x
    return out


def sub(*xs: Column) -> Column:
    out = xs[0].cast("bigint")
    for x in xs[1:]:
        out = out - x
    return out


def mul(*xs: Column) -> Column:
    out = xs[0].cast("bigint")
    for x in xs[1:]:
        out = out * x
    return out


def div(*xs: Column) -> Column:
    """Integer division, truncated towards zero; null by zero."""
    out = xs[0].cast("bigint")
    for x in xs[1:]:
        out = F.when(x != 0, (out - out % x) / x).cast("bigint")
    return out


def plus(a: Column, b: Column, a_kind: str, b_kind: str) -> Column:
    """Sum of two numbers, else the concatenation of their texts."""
    number = ("int", "bigint", "long", "smallint", "tinyint")
    return a + b if a_kind in number and b_kind in number else F.concat(a.cast("string"), b.cast("string"))


def kind_of(t: T.DataType) -> str:
    """Kind name of a column's type: string, array, object, number, boolean, null."""
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.MapType | T.StructType):
        return "object"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    return "null" if isinstance(t, T.NullType) else "undefined"


def is_kind(x: Column, t: T.DataType, kind: str) -> Column:
    """Kind test; a null is of kind 'null' whatever the type."""
    if kind == "null":
        return x.isNull()
    return x.isNotNull() & F.lit(kind_of(t) == kind)


def year() -> Column:
    return F.year(F.current_date())


def to_json(x: Column) -> Column:
    return F.to_json(x)
