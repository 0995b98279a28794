import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import globs

CASES = [
    ("", "", globs.PATH, True), ("", "a", globs.PATH, False), ("abc", "abc", globs.PATH, True), ("abc", "abcd", globs.PATH, False),
    ("abc*ghi", "abcdefghi", globs.PATH, True), ("abc*ghi", "abcdefg/ghi", globs.PATH, False), ("abc*ghi", "abcdefg::ghi", globs.PATH, True), ("abc*ghi", "abcdefg::ghi", globs.SYMBOL, False),
    ("*", "", globs.PATH, True), ("*", "a/b", globs.PATH, False), ("**", "a/b/c", globs.PATH, True), ("abc**ghi", "abcdefg/ghi", globs.PATH, True), ("a\\*b", "a*b", globs.PATH, True), ("a\\*b", "aab", globs.PATH, False),
    ("a?c", "a/c", globs.PATH, True), ("a?c", "ac", globs.PATH, False), ("a[bc]d", "abd", globs.PATH, True), ("a[b-d]e", "ace", globs.PATH, True), ("a[^b-d]e", "ace", globs.PATH, False), ("a[!b]e", "ace", globs.PATH, True),
    ("{a,b*}c", "bxxc", globs.PATH, True), ("{a,b}c", "cc", globs.PATH, False), ("a.b", "axb", globs.PATH, False), ("A*::**", "AB::c::d", globs.SYMBOL, True), ("A*::**", "AB", globs.SYMBOL, False),
]


@pytest.mark.parametrize("glob,text,delimiter,want", CASES)
def test_regex(glob, text, delimiter, want):
    assert bool(re.match(globs.glob_regex(glob, delimiter), text)) == want


def test_java_and_python_agree(spark):
    rows = [(g, t, d, w) for g, t, d, w in CASES]
    for g, t, d, w in rows:
        got = spark.range(1).select(globs.glob_match(F.lit(t), [g], d)).first()[0]
        assert got == w, (g, t, d)


def test_bad_patterns():
    for bad in ("a[b", "a{b", "a\\"):
        with pytest.raises(ValueError):
            globs.glob_regex(bad)


def test_prefix():
    r = globs.prefix_regex("A*::b")
    assert [bool(re.match(r, t)) for t in ("", "A", "Axx", "Axx::b", "B")] == [True, True, True, True, False]


def test_literal():
    assert globs.is_literal("a::b") and not globs.is_literal("a*") and globs.is_literal("a\\*")
    assert globs.literal_text("a\\*") == "a*" and globs.literal_prefix("ab*c") == "ab"


def test_pattern_table(spark):
    df = spark.createDataFrame([("std::vector",), ("my::x",)], "name string")
    got = globs.match_patterns(df, "name", [("std", "std::**"), ("any", "**"), ("mine", "my::?")]).collect()
    assert sorted((r["name"], r["pattern"]) for r in got) == [("my::x", "any"), ("my::x", "mine"), ("std::vector", "any"), ("std::vector", "std")]


def test_required_literals():
    assert [globs.required_literal(g) for g in ("*-HIGH", "**", "ab[cd]efg?h", "{a,b}c", "a\\*bc*d", "a[]x]", "[!a-c]")] == ["-HIGH", "", "efg", "c", "a*bc", "a", ""]


def test_many_patterns_match_like_single_ones(spark):
    rng = random.Random(1)
    piece = lambda: "".join(rng.choice(["a", "b", ":", "*", "**", "?", "[ab]", "[!b]", "{a,bb}", "\\*"]) for _ in range(rng.randint(1, 6)))
    patterns = [(str(k), piece()) for k in range(300)]
    texts = ["".join(rng.choice("ab:*") for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None]
    want = {(t, n) for t in texts if t is not None for n, g in patterns if re.match(globs.glob_regex(g), t)}
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    assert {tuple(r) for r in globs.match_patterns(df, "name", patterns).collect()} == want


def test_ten_thousand_patterns_in_one_pass():
    index = globs.PatternIndex([(str(k), f"**::f{k:05d}*") for k in range(10_000)])
    began = time.time()
    assert all(index.matches(f"ns::f{k:05d}x") == [str(k)] for k in range(0, 10_000, 7))
    assert time.time() - began < 5
