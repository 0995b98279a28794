"""The pipeline's near-dedup stage on null and repeated ids; groups that stay apart."""

import numpy as np

import corpus_pipeline
from tomeflow.llm import near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_component_is_kept(spark):
    text = lambda t: " ".join(f"{t}{k}" for k in range(60))
    near = lambda t, k: text(t) + f" extra{k}"
    data = [(None, near("a", k)) for k in range(3)]  # null ids only
    data += [(5, near("b", 0)), (5, near("b", 1)), (3, near("b", 2))]  # a repeated id
    data += [(5, near("c", 0)), (2, near("c", 1)), (5, text("d"))]  # the same id elsewhere, and alone
    data += [(None, near("e", 0)), (9, near("e", 1))] + [(8, text("f"))] * 2 + [(None, ""), (11, None), (12, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.stage_near(spark, docs, "").collect()]
    nulls = [r for r in kept if r[0] is None and r[1]]
    assert len(nulls) == 1 and nulls[0] in data[:3]
    rest = [r for r in kept if r not in nulls]
    want = [(3, near("b", 2)), (2, near("c", 1)), (5, text("d")), (9, near("e", 1)), (8, text("f")), (None, ""), (11, None), (12, " ")]
    assert sorted(map(str, rest)) == sorted(map(str, want))


def test_a_group_that_stays_apart_is_told_apart(spark):
    """Texts of one base, most of them alike but below the threshold, some above it."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(60, 1 + k % 5, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((k, " ".join(words)))
    rows.append((150, " ".join(f"long{k}" for k in range(900))))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {i: min(x, y) if r in (x, y) else r for i, r in up.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, threshold=85).collect()}
    assert got == up and 1 < len(set(up.values())) < 151
