import hashlib
import random
from collections import Counter

import numpy as np

from siltstone.llm import weighted as W


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both) if both else 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(40):
        a = [f"w{rng.randrange(60)}" for _ in range(120)]
        b = a[: 3 * k] + [f"w{rng.randrange(90)}" for _ in range(120 - 3 * k)]
        want[k] = jaccard(" ".join(a), " ".join(b))
        ca, cb = Counter(a), Counter(b)
        rows += [(k, t, ca[t], cb[t]) for t in set(a) | set(b)]
    df = spark.createDataFrame(rows, "k int, term string, a int, b int")
    got = W.samples(df, ["k"], "term", ["a", "b"], 512).select("k", W.likeness(W.F.col("a"), W.F.col("b")).alias("x")).collect()
    errors = np.array([r.x - want[r.k] for r in got])
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.04


def test_contract(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["é", "b", "cc", "😀x", "d\n"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(5 * i, t) for i, t in enumerate(texts)] + [(7, None), (8, ""), (9, " \n\t"), (11, texts[0]), (12, texts[0]), (13, "x" * 40_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, fingerprint string, bucket int").repartition(3)
    want = sorted((i, t or "") for i, t in rows)
    for per in (4, 10_000):
        got = sorted(W.fingerprints(docs, rows_per_bucket=per).collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == [i for i, _ in want]
        for k, (r, (_, t)) in enumerate(zip(got, want, strict=True)):
            nxt = want[(k + 1) % len(want)][1]
            m = len(t) // 4
            edited = t[: len(t) - m] + nxt[:m]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert abs(r.near_edited - jaccard(t, edited)) < 0.35 and abs(r.near_next - jaccard(t, nxt)) < 0.35
            assert r.near_edited == 1.0 if t.split() == edited.split() else True
            same = {x.fingerprint for x in got if x.n_chars == r.n_chars and want[[i for i, _ in want].index(x.doc_id)][1] == t}
            assert same == {r.fingerprint}


def test_nulls_ties_one_row_and_none(spark):
    schema = "doc_id bigint, text string"
    assert W.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = W.fingerprints(spark.createDataFrame([(1, "a b c d e")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    got = W.fingerprints(spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "x y"), (3, "z")], schema), rows_per_bucket=1).collect()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["3", "3", "None", "None"]


def test_quantised_variates_keep_the_collision_rate():
    """Near ties and small similarities: tables of 2^12 and 2^14 steps against the rate that they stand for."""
    rng, n = np.random.default_rng(8), 1_000_000
    r_table, c_table = W.gamma_quantiles(W.R_BITS), np.log(W.gamma_quantiles(W.C_BITS))
    for ws, vs in (([100], [101]), ([1], [100]), ([3, 5, 2], [3, 5, 3]), ([1, 1, 1, 1, 9], [1, 1, 1, 1, 1]), ([50, 1], [1, 50]), ([1] * 20, [1] + [0] * 19)):
        best = []
        r, c, beta = r_table[rng.integers(0, r_table.size, (n // 4, len(ws)))], c_table[rng.integers(0, c_table.size, (n // 4, len(ws)))], rng.random((n // 4, len(ws)))
        for w in (np.array(ws, float), np.array(vs, float)):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.floor(np.log(w) / r + beta)
                a = np.where(w > 0, c - r * (t - beta + 1), np.inf)
            k = a.argmin(axis=1)
            best.append((k, t[np.arange(len(k)), k]))
        same = np.mean((best[0][0] == best[1][0]) & (best[0][1] == best[1][1]))
        want = np.minimum(ws, vs).sum() / np.maximum(ws, vs).sum()
        assert abs(same - want) < 0.0035, (ws, vs, same, want)  # some three standard errors of 250,000 draws
