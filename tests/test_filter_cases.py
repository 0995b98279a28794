"""Classification of whole trees: names are written with the mode they must get
('+' regular, '~' see-below, '?' implementation-defined, '-' dependency)."""

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import filters, hierarchy

MODES = {"+": 0, "~": 1, "?": 2, "-": 3}

#: (rules, tree): a line is depth (two blanks each), mode, kind (n, r or f) and name.
CASES = {
    "include": (
        filters.SymbolRules(include=["a::yes", "b::all", "b::d::yes", "e::f::*7", "R", "empty::*_yes"]),
        """
+n a
  +f yes
  -f no
+n b
  -f no
  -n c
    -f no
  +n all
    +f any
  +n d
    +f yes
    -f no
+n e
  -f no
  +n f
    -f no
    +n x7
      +f any
    +n y7
      +f any
    -n x8
      -f any
+r R
  +f any
  +r inner
    +f any
-n empty
  -f no
""",
    ),
    "exclude": (
        filters.SymbolRules(exclude=["a::no", "a::R", "b", "c::f*", "d::n*::no", "e::n*::f*", "e::n1::g*", "g::h"]),
        """
+n a
  +f yes
  -n no
    -f any
  -r R
    -f any
-n b
  -f any
  -n inner
    -f any
+n c
  -f f0
  -f f1
+n d
  +n n1
    -f no
    +f yes
  +n n2
    -f no
+n e
  +n n1
    -f f0
    -f g0
  +n n2
    -f f0
    +f g0
+n g
  +f yes
  -n h
    -n i
      -f any
""",
    ),
    "modes": (
        filters.SymbolRules(
            exclude=["plain::out", "below::out", "hidden::out", "gone", "gone::out"], see_below=["plain::below", "below", "below::below", "hidden::below", "gone::below"],
            implementation_defined=["plain::hidden", "below::hidden", "hidden", "hidden::hidden", "gone::hidden"],
        ),
        """
+n plain
  +r R
    +r child
      +r grandchild
  ~r below
    -r child
      -r grandchild
  ?r hidden
    ?r child
      ?r grandchild
  -r out
    -r child
~n below
  ~r R
    -r child
  ~r below
  ?r hidden
    ?r child
  -r out
?n hidden
  ?r R
    ?r child
  ?r below
  ?r hidden
  -r out
-n gone
  -r R
  -r below
  -r hidden
  -r out
""",
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_trees_are_classified(spark, name):
    rules, text = CASES[name]
    rows, above = [], []
    for k, line in enumerate(text.strip("\n").split("\n")):
        depth = (len(line) - len(line.lstrip())) // 2
        mode, kind, word = line.strip()[0], line.strip()[1], line.strip()[3:]
        above = [*above[:depth], str(k)]
        rows.append((str(k), above[-2] if depth else None, {"n": "namespace", "r": "record", "f": "function"}[kind], word, MODES[mode]))
    df = spark.createDataFrame(rows, "id string, parent_id string, kind string, name string, want int")
    named = df.join(hierarchy.qualified_names(df).select("id", "qualified_name"), "id")
    got = filters.classify_symbols(named, rules).where(F.col("extraction") != F.col("want")).select("qualified_name", "want", "extraction").collect()
    assert got == []
