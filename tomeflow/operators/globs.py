"""Glob patterns translated once to Java regular expressions for ``rlike``.

'*' matches any run without the delimiter, '**' any run, '?' any character,
'[..]' a set, '[^..]' or '[!..]' its complement, '{a,b}' one of some globs (not
nested) and a backslash makes the next character literal. The delimiter is '/'
for paths and ':' for symbol names. An empty pattern matches only empty text.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH, SYMBOL = "/", ":"


def _quote(ch: str) -> str:
    return "\\" + ch if re.match(r"[^0-9A-Za-z_]", ch) and ord(ch) < 128 else ch


def _tokens(glob: str, delimiter: str) -> list[str]:
    """Regular expressions of a glob's pieces, in order."""
    out, k, n = [], 0, len(glob)
    while k < n:
        ch = glob[k]
        if ch == "\\":
            if k + 1 >= n:
                raise ValueError(f"stray backslash in glob {glob!r}")
            out.append(_quote(glob[k + 1]))
            k += 2
        elif ch == "*":
            deep = glob[k : k + 2] == "**"
            out.append(".*" if deep else f"[^{_quote(delimiter)}]*")
            k += 2 if deep else 1
        elif ch == "?":
            out.append(".")
            k += 1
        elif ch == "[":
            end = glob.find("]", k + 2 + (glob[k + 1 : k + 2] in ("^", "!")))
            if end < 0:
                raise ValueError(f"unclosed bracket in glob {glob!r}")
            body = glob[k + 1 : end]
            negated = body[:1] in ("^", "!")
            members = "".join(x if x == "-" and 0 < p < len(body[negated:]) - 1 else _quote(x) for p, x in enumerate(body[negated:]))
            out.append(f"[{'^' if negated else ''}{members}]")
            k = end + 1
        elif ch == "{":
            end = glob.find("}", k)
            if end < 0:
                raise ValueError(f"unclosed brace in glob {glob!r}")
            out.append("(?:" + "|".join("".join(_tokens(x, delimiter)) for x in glob[k + 1 : end].split(",")) + ")")
            k = end + 1
        else:
            out.append(_quote(ch))
            k += 1
    return out


def glob_regex(glob: str, delimiter: str = SYMBOL) -> str:
    return "(?s)^" + "".join(_tokens(glob, delimiter)) + "$"


def prefix_regex(glob: str, delimiter: str = SYMBOL) -> str:
    """Matches texts that some continuation turns into a match: nested optional
    groups, one for each piece."""
    tokens = _tokens(glob, delimiter)
    return "(?s)^" + "".join(f"(?:{t}" for t in tokens) + ")?" * len(tokens) + "$"


def is_literal(glob: str) -> bool:
    """Whether a pattern has no special character that is not escaped."""
    return not re.search(r"(?<!\\)(?:\\\\)*[*?\[{]", glob)


def literal_text(glob: str) -> str:
    return re.sub(r"\\(.)", r"\1", glob)


def glob_match(text: Column, globs: list[str], delimiter: str = SYMBOL) -> Column:
    """Whether any pattern matches; literal ones are compared, not searched."""
    literals = [literal_text(g) for g in globs if is_literal(g)]
    rest = [glob_regex(g, delimiter) for g in globs if not is_literal(g)]
    out = text.isin(literals) if literals else F.lit(False)
    for r in rest:
        out = out | F.regexp_like(text, F.lit(r))
    return F.coalesce(out, F.lit(False))


def glob_prefix_match(text: Column, globs: list[str], delimiter: str = SYMBOL) -> Column:
    """Whether something that begins with the text could match a pattern."""
    out = F.lit(False)
    for g in globs:
        out = out | F.regexp_like(text, F.lit(prefix_regex(g, delimiter)))
    return F.coalesce(out, F.lit(False))


def literal_prefix(glob: str) -> str:
    m = re.search(r"[*?\[{\\]", glob)
    return glob[: m.start()] if m else glob


def required_literal(glob: str) -> str:
    """The longest text that every match of a pattern contains ('' if there is none)."""
    runs, run, k = [], "", 0
    while k < len(glob):
        ch = glob[k]
        if ch == "\\":
            run, k = run + glob[k + 1], k + 2
        elif ch in "*?":
            runs, run, k = [*runs, run], "", k + 1
        elif ch == "[":
            runs, run, k = [*runs, run], "", glob.index("]", k + 2 + (glob[k + 1 : k + 2] in ("^", "!"))) + 1
        elif ch == "{":
            runs, run, k = [*runs, run], "", glob.index("}", k) + 1
        else:
            run, k = run + ch, k + 1
    return max([*runs, run], key=len)


class PatternIndex:
    """Many patterns at once: one automaton over their required literals (read in one
    pass over a text) names the patterns that can match; these alone are tried."""

    def __init__(self, patterns: list[tuple[str, str]], delimiter: str = SYMBOL) -> None:
        import ahocorasick

        self.names = [n for n, _ in patterns]
        self.regex = [glob_regex(g, delimiter) for _, g in patterns]
        self.compiled: dict[int, re.Pattern] = {}
        by_literal: dict[str, list[int]] = {}
        for k, (_, g) in enumerate(patterns):
            by_literal.setdefault(required_literal(g), []).append(k)
        self.always = by_literal.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for literal, which in by_literal.items():
            self.automaton.add_word(literal, which)
        if by_literal:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[str]:
        """Names of the patterns that match, in their order."""
        if text is None:
            return []
        asked = set(self.always)
        if len(self.automaton):
            for _, which in self.automaton.iter(text):
                asked.update(which)
        out = []
        for k in sorted(asked):
            if k not in self.compiled:
                self.compiled[k] = re.compile(self.regex[k])
            if self.compiled[k].match(text):
                out.append(self.names[k])
        return out


#: Up to so many patterns are one column expression; more go through an index.
FEW_PATTERNS = 16
_INDEXES: dict[str, PatternIndex] = {}


def match_patterns(df: DataFrame, text: str, patterns: list[tuple[str, str]], delimiter: str = SYMBOL) -> DataFrame:
    """(df's columns, pattern name) for each matching pattern of a list of (name,
    glob). A few patterns are tried on texts with their literal prefix. More are
    broadcast once, as text; each Python worker makes one index of them, and a text
    is read once for all of them, whatever their number."""
    if len(patterns) <= FEW_PATTERNS:
        rules = [(n, literal_prefix(g), glob_regex(g, delimiter)) for n, g in patterns]
        hits = F.array_compact(F.array(*[F.when(F.startswith(F.col(text), F.lit(p)) & F.regexp_like(F.col(text), F.lit(r)), F.lit(n)) for n, p, r in rules]))
        return df.withColumn("pattern", F.explode(hits))
    shared = df.sparkSession.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        index = _INDEXES.get(key)
        if index is None:
            _INDEXES.clear()
            index = _INDEXES[key] = PatternIndex(shared.value, delimiter)
        codes, distinct = pd.factorize(texts, use_na_sentinel=False)
        found = [index.matches(None if pd.isna(t) else t) for t in distinct]
        return pd.Series([found[c] for c in codes])

    return df.withColumn("pattern", F.explode(named(F.col(text))))
