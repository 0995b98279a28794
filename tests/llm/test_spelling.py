"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tomeflow.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least_length=5, least=3, slip=97):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: None for w in words}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-words[x], x))
            form[w] = best if words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = spelling.spelling_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, **{k: v for k, v in kw.items() if k in ("slip", "least")})
    return got


def corpus(seed, n, alphabet="abcdé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            k = rng.randrange(len(w))
            r = rng.random()
            w = w[:k] + w[k + 1 :] if r < 0.2 else w[:k] + rng.choice(alphabet) + w[k:] if r < 0.4 else w[:k] + rng.choice(alphabet) + w[k + 1 :] if r < 0.6 else w
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(words)))
    return rows


def test_variants_match_brute_force(spark):
    got = check(spark, corpus(1, 80), slip=3)
    assert any(r[1] for r in got)
    chain = check(spark, [(d, "aaaaa " * 3 + "aaaab " * 8 + "aaabb " * 20 + "aabbb " * 40) for d in (1,)], slip=1 << 40)
    assert {r[0]: r[2] for r in chain} == dict.fromkeys(["aaaaa", "aaaab", "aaabb", "aabbb"], "aabbb")


def test_odd_rows(spark):
    rows = [(None, "Straße straße STRASSE, naïve×naïve"), (None, None), (1, ""), (1, "12 .. --"), (2, "naïve×naïve " * 3), (2, "naïve×naïve " * 3), (3, "abcdefgh" * 4000), (4, "abcdefgh" * 4000), (5, "abcdefgh" * 4000 + "x"), (6, ("abcdefgh" * 4000 + "x ") * 3)]
    check(spark, rows)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string, word string, n int")).count() == 0


def test_large_groups_are_dealt_by_halves(spark):
    """One ending and one beginning hold nearly all words; bounds of 8 words make every group be dealt again."""
    rng = random.Random(3)
    words = sorted({"anfang" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) + "endung" for _ in range(250)})
    df = spark.createDataFrame(list(enumerate(words)), "node long, word string")
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    for most in (8, 4096):
        got = [tuple(r) for r in spelling.near_pairs(df, block=16, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_index_in_one_block():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(200)}, key=lambda w: -len(w))
    group = np.array([rng.randrange(3) for _ in words])
    q, w = spelling.one_error(words, group)
    assert set(zip(q.tolist(), w.tolist())) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if group[i] == group[j] and one_edit(a, b)}
