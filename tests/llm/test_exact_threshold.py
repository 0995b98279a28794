"""Lines at exactly the threshold, blank lines of other line ends, texts of one long run."""

import string

import numpy as np
import public_tokenizers as P
import pytest

from tomeflow.llm import line_dedup, packing


def components(spark, lines):
    df = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string")
    return {r["doc_id"]: r["component_doc_id"] for r in line_dedup.line_dedup(df).collect()}


def test_extensions_at_four_fifths_are_one_component(spark):
    """A base of 4 shingles and 25 lines of 5 that contain it: exactly 4/5."""
    base = "qwertyuiopa"
    lines = [base + c for c in string.ascii_lowercase[1:]] + [base]
    assert set(components(spark, lines).values()) == {0}


def test_many_at_forty_fiftieths_are_one_component(spark):
    """61 lines: a base of 40 shingles and 60 of 50 that begin with it."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list(string.ascii_lowercase), n))
    base = word(47)
    assert set(components(spark, [base, *[base + word(10) for _ in range(60)]]).values()) == {0}


def test_lines_of_white_space_are_linked_with_nothing(spark):
    df = spark.createDataFrame([(1, "\r\n\t\r\n  \r\nabc def ghi\r"), (2, "\r\n \n\t\r\nabc def ghi\r")], "doc_id long, text string")
    out = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.line_dedup(df).collect()}
    assert [k for k, kept in out.items() if not kept] == [(2, 3)] and len(out) == 8


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6, "a" * 10**6, "x" + "\t \n" * 333_333, " " * 49_999 + "a" + " " * 50_001 + "b"], ids=["blank", "newline", "letter", "mixed", "edges"])
def test_long_runs_have_the_tokenizers_ids(text):
    of = packing.TokenIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert of(text).tolist() == of.tok.encode(text, add_special_tokens=False).ids
