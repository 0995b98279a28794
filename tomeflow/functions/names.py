"""Fixed name tables: operators and enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Operator name, safe name, short name, readable name, readable name
# with two parameters where it differs; in the order that sorting uses.
OPERATORS = [
    ("operator new", "operator_new", "nw", "New", None),
    ("operator delete", "operator_del", "dl", "Delete", None),
    ("operator new[]", "operator_arr_new", "na", "New array", None),
    ("operator delete[]", "operator_arr_del", "da", "Delete array", None),
    ("operator+", "operator_plus", "pl", "Unary plus", "Addition"),
    ("operator-", "operator_minus", "mi", "Unary minus", "Subtraction"),
    ("operator*", "operator_star", "ml", "Dereference", "Multiplication"),
    ("operator/", "operator_slash", "dv", "Division", None),
    ("operator%", "operator_mod", "rm", "Modulus", None),
    ("operator^", "operator_xor", "eo", "Bitwise exclusive-or", None),
    ("operator&", "operator_bitand", "an", "Address-of", "Bitwise conjunction"),
    ("operator|", "operator_bitor", "or", "Bitwise disjunction", None),
    ("operator~", "operator_bitnot", "co", "Bitwise negation", None),
    ("operator=", "operator_assign", "as", "Assignment", None),
    ("operator+=", "operator_plus_eq", "ple", "Addition assignment", None),
    ("operator-=", "operator_minus_eq", "mie", "Subtraction assignment", None),
    ("operator*=", "operator_star_eq", "mle", "Multiplication assignment", None),
    ("operator/=", "operator_slash_eq", "dve", "Division assignment", None),
    ("operator%=", "operator_mod_eq", "rme", "Modulus assignment", None),
    ("operator^=", "operator_xor_eq", "eoe", "Bitwise exclusive-or assignment", None),
    ("operator&=", "operator_and_eq", "ane", "Bitwise conjunction assignment", None),
    ("operator|=", "operator_or_eq", "ore", "Bitwise disjunction assignment", None),
    ("operator<<", "operator_lshift", "ls", "Left shift", None),
    ("operator>>", "operator_rshift", "rs", "Right shift", None),
    ("operator<<=", "operator_lshift_eq", "lse", "Left shift assignment", None),
    ("operator>>=", "operator_rshift_eq", "rse", "Right shift", None),
    ("operator!", "operator_not", "nt", "Negation", None),
    ("operator==", "operator_eq", "eq", "Equality", None),
    ("operator!=", "operator_not_eq", "ne", "Inequality", None),
    ("operator<", "operator_lt", "lt", "Less-than", None),
    ("operator<=", "operator_le", "le", "Less-than-or-equal", None),
    ("operator>", "operator_gt", "gt", "Greater-than", None),
    ("operator>=", "operator_ge", "ge", "Greater-than-or-equal", None),
    ("operator<=>", "operator_3way", "ss", "Three-way comparison", None),
    ("operator&&", "operator_and", "aa", "Conjunction", None),
    ("operator||", "operator_or", "oo", "Disjunction", None),
    ("operator++", "operator_inc", "pp", "Increment", None),
    ("operator--", "operator_dec", "mm", "Decrement", None),
    ("operator,", "operator_comma", "cm", "Comma", None),
    ("operator->*", "operator_ptrmem", "pm", "Pointer-to-member", None),
    ("operator->", "operator_ptr", "pt", "Member access", None),
    ("operator()", "operator_call", "cl", "Function call", None),
    ("operator[]", "operator_subs", "ix", "Subscript", None),
    ("operator?", "operator_ternary", "qu", "Ternary", None),
    ("operator co_await", "operator_coawait", "ca", "Coawait", None),
]
# The operators that member sorting calls relational.
RELATIONAL = ["operator!", "operator==", "operator!=", "operator<", "operator<=", "operator>", "operator>=", "operator<=>", "operator<<"]
# Enumeration names by code.
EXTRACTION = ["regular", "see-below", "implementation-defined", "dependency"]
ACCESS = ["none", "public", "protected", "private"]
STORAGE = ["none", "extern", "static", "auto", "register"]
CONSTEXPR = ["none", "constexpr", "consteval"]
REFERENCE = ["", "&", "&&"]
QUALIFIERS = ["", "const", "volatile", "const volatile"]
TYPE_KINDS = ["named", "decltype", "auto", "lvalue-reference", "rvalue-reference", "pointer", "member-pointer", "array", "function"]
TEMPLATE_PARAMS = ["type", "constant", "template"]
COPIED_PARTS = ["all", "brief", "description"]
FUNDAMENTAL = [
    "void", "std::nullptr_t", "bool", "char", "signed char", "unsigned char", "char8_t", "char16_t", "char32_t", "wchar_t", "short", "unsigned short",
    "int", "unsigned int", "long", "unsigned long", "long long", "unsigned long long", "float", "double", "long double",
]
ADMONITION = ["none", "note", "tip", "important", "caution", "warning"]
DIRECTION = ["none", "in", "out", "inout"]


def operators(spark: SparkSession) -> DataFrame:
    """Dimension (rank, operator, safe_name, short_name, readable, readable_binary)."""
    rows = [(k + 1, *row) for k, row in enumerate(OPERATORS)]
    return spark.createDataFrame(rows, "rank int, operator string, safe_name string, short_name string, readable string, readable_binary string")


def with_operator_names(df: DataFrame, operator: str = "operator", arity: str = "param_count") -> DataFrame:
    """Adds operator_rank, safe_name, short_name and readable_name (null for others)."""
    dim = operators(df.sparkSession).withColumnRenamed("operator", "__op")
    joined = df.join(F.broadcast(dim), F.col(operator) == F.col("__op"), "left")
    readable = F.when(F.col(arity) == 2, F.coalesce("readable_binary", "readable")).otherwise(F.col("readable"))
    return joined.withColumn("readable_name", readable).withColumnRenamed("rank", "operator_rank").drop("__op", "readable", "readable_binary")


def enum_name(code: Column, names: list[str]) -> Column:
    """Name of a 0-based code; null outside."""
    return F.get(F.array(*[F.lit(n) for n in names]), code)
