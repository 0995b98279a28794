"""Personal data in texts: patterns propose spans, validators confirm them, context
words adjust their score.

Spans of the four base kinds (e-mail, IP address, card, phone) are kept whatever
their score. Further kinds (bank accounts, social-security numbers, short card
numbers, phone numbers without a country code) are kept from a score on: a pattern's
own, raised by a checksum that holds and by words that go with the kind nearby,
lowered by words that speak against it. Everything happens where a text lies: no
shuffle, and every scan is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import small_batches

#: Code points before and after a span in which context words count.
REACH = 48
#: What a confirmed checksum, a word for and a word against a kind add to a score.
CONFIRMED, WORD_FOR, WORD_AGAINST = 0.4, 0.35, -0.3
#: Least score of a span of a further kind.
LEAST = 0.6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of those before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's check digits hold (remainder 1 of 97)."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each '@': a local part has none, so it starts where its run does."""
    pos, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            pos = m.end()
        at = text.find("@", max(pos, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four by four of the numbers of a dotted chain; parts over 255 drop a match."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) < 4 and int(v or 0) < 256 for p in four):
                yield at, end
            at = end + 1


def numbers(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of digits, single blanks or hyphens between them, that pass Luhn."""
    for m in _NUMBER.finditer(text):
        d = _digits(m.group())
        if least <= len(d) <= most and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, written in one or in groups of four; of the ends that groups
    allow, the last whose check digits hold."""
    for m in _IBAN.finditer(text):
        s, ends = m.start(), [m.end(), *[m.start() + k.start() for k in reversed(list(re.finditer("\x20", m.group())))]]
        for e in ends:
            plain = text[s:e].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield s, e
                break


def social(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        yield m.span()


@dataclass(frozen=True)
class Kind:
    """``find`` gives confirmed spans; ``checked`` says that a checksum was among what
    confirmed them; ``needs`` is a character class that a text must have."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    checked: bool
    words: frozenset[str]
    against: frozenset[str]
    base: bool = False
    needs: str = "[0-9]"


_NOT_A_PERSON = frozenset("version release isbn issn order invoice serial model article item page chapter build".split())
_CARD_WORDS = frozenset("card cards credit debit visa mastercard amex payment carte karte tarjeta".split())
_PHONE_WORDS = frozenset("phone telephone tel call mobile cell fax contact telefon telefono handy".split())

#: Base kinds come in the order that breaks ties of a start.
KINDS = (
    Kind("email", emails, 0.8, False, frozenset("mail email contact write".split()), frozenset(), base=True, needs="@"),
    Kind("ip", addresses, 0.6, False, frozenset("ip host server address network client".split()), _NOT_A_PERSON, base=True),
    Kind("card", lambda t: numbers(t, 14, 19), 0.3, True, _CARD_WORDS, _NOT_A_PERSON, base=True),
    Kind("phone", phones, 0.7, False, _PHONE_WORDS, _NOT_A_PERSON, base=True, needs="[+]"),
    Kind("iban", accounts, 0.4, True, frozenset("iban account bank konto compte cuenta bic swift".split()), _NOT_A_PERSON),
    Kind("ssn", social, 0.4, False, frozenset("ssn social security taxpayer".split()), _NOT_A_PERSON),
    Kind("short_card", lambda t: numbers(t, 12, 13), 0.0, True, _CARD_WORDS, _NOT_A_PERSON),
    Kind("local_phone", local_phones, 0.3, False, _PHONE_WORDS, _NOT_A_PERSON),
)

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"


def context_score(text: str, start: int, end: int, kind: Kind, reach: int = REACH) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    score = kind.score + CONFIRMED * kind.checked + WORD_FOR * bool(near & kind.words) + WORD_AGAINST * bool(near & kind.against)
    return round(min(1.0, max(0.0, score)), 4)


def spans_of(text: str, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST, reach: int = REACH) -> list[tuple]:
    """(kind, start, end, score, base) by start, then order of ``kinds``; positions are
    code points, ends exclusive. A span of a further kind that overlaps one of a base
    kind is left out."""
    base, more = [], []
    for order, kind in enumerate(kinds):
        if not re.search(kind.needs, text):
            continue
        for s, e in kind.find(text):
            score = context_score(text, s, e, kind, reach)
            if kind.base or score >= least:
                (base if kind.base else more).append((s, order, kind.name, e, score, kind.base))
    for s, order, name, e, score, _ in more:
        if not any(x[0] < e and s < x[3] for x in base if x[5]):
            base.append((s, order, name, e, score, False))
    return [(name, s, e, score, is_base) for s, _, name, e, score, is_base in sorted(base)]


def masked(text: str, spans: list[tuple]) -> str:
    """``text`` with each span, overlapping ones as one, replaced by its kind's name."""
    out, pos = [], 0
    for name, s, e, *_ in spans:
        if s >= pos:
            out += [text[pos:s], f"<{name}>"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]])


def find_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST, reach: int = REACH, mask: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans[, masked]) of each row: ``spans`` is an array of (kind, start, end,
    score, base), by start, then kind; ``masked`` the text with kinds in their place.

    A null text counts as empty and has no spans. Rows are judged one by one, so
    repeated rows and null ids give a row each, and an empty table gives none; other
    columns are ignored. Whole texts are searched, however long."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [id_col, "spans", *(["masked"] if mask else [])]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [spans_of(t, kinds, least, reach) for t in texts]
            listed = pa.array([[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in f] for f in found], pa.list_(SPAN))
            more = [pa.array([masked(t, f) for t, f in zip(texts, found)], pa.string())] if mask else []
            yield pa.RecordBatch.from_arrays([b.column(0), listed, *more], names=names)

    return rows.mapInArrow(search, f"`{id_col}` long, spans {SPAN_SQL}" + (", masked string" if mask else ""))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of base spans and all spans as a text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, *[count(k.name) for k in KINDS if k.base], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        *[count(k.name) for k in KINDS if not k.base],
    )
