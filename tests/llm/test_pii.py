"""Personal data: base spans against plain regular expressions, added ones by example."""

import hashlib
import random
import re
import time

from tomeflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = [int(c) for c in d[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m.group())]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_base_spans_match_plain_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "x_y%z@", "@", ".", "1.2.3.4", "999", "300.1.1.1", "1.2.3.4.5.6.7.8.9", " ", "-", "+", "+1 (555) 123-4567", "4539 1488 0343 6467", "4539148803436467", "(", ")", "12", "000001", "é", "𝒳", "a.b", "user@host.example.com_c@d.e", "\n", "0", "+49 30 901820"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in pii.spans_of(text) if s[4]] == base(text), text


def test_added_kinds_and_scores():
    of = lambda t: [(s[0], t[s[1] : s[2]]) for s in pii.spans_of(t)]
    assert of("IBAN GB82 WEST 1234 5698 7654 32 please") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert of("DE89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert of("DE88370400440532013000") == []  # check digits fail
    assert of("my ssn is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert of("item 123-45-6789") == [] and of("ssn 666-45-6789") == [] and of("123-45-6789") == []
    assert of("phone: (555) 123-4567") == [("local_phone", "(555) 123-4567")]
    assert of("call +1 (555) 123-4567 now") == [("phone", "+1 (555) 123-4567")]
    near = pii.spans_of("server 10.0.0.1")[0][3]
    assert near > pii.spans_of("10.0.0.1")[0][3] > pii.spans_of("version 10.0.0.1")[0][3]


def test_masking():
    text = "Mail a@b.example or +1 555 123 4567."
    assert pii.masked(text, pii.spans_of(text)) == "Mail <email> or <phone>."


def test_query_on_odd_rows(spark):
    rows = [(1, "Mail é𝒳 a@b.example"), (2, None), (2, None), (None, ""), (3, "x" * 500 + "@" + "1" * 500 + "." * 100 + " a@b.c" * 5000), (4, "4539148803436467")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as kind", "1 as spans", "map(1, 2) as `start`")
    got = sorted((tuple(r) for r in pii.digest(pii.find_personal_data(df)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)
    want = []
    for doc, text in rows:
        found = base(text or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        n = [sum(k == kind for k, *_ in found) for kind in PATTERNS]
        want.append((doc, *n, hashlib.sha256(written.encode()).hexdigest(), written))
    assert got == sorted(want, key=str)
    assert pii.find_personal_data(df.limit(0), mask=True).count() == 0
    assert pii.find_personal_data(df.where("doc_id = 1"), mask=True).first().masked == "Mail é𝒳 <email>"


def test_scans_are_linear():
    began = time.time()
    for text in ("a" * 10**6, "1" * 10**6, "1." * 500_000, "+1" + "(" * 10**6, "a@" * 500_000, "A" * 10**6, "1 " * 500_000, "AB12 " * 200_000, "+" * 10**6):
        pii.spans_of(text)
    assert time.time() - began < 60
