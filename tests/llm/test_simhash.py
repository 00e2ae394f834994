import random

import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash as S
from siltstone.llm.components import components


def brute_fp(text, k):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, near):
    comp = {n: n for n in nodes}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                a_, b_ = find(a), find(b)
                comp[max(a_, b_)] = min(a_, b_)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("k", [4, 5])
def test_fingerprint_brute_force(k):
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 6, 40, 700]:
        t = "".join(rng.choice(["Ab", "É", "c\x85", "漢"]) + rng.choice([" ", "\n", "\t ", "\x1c", "\x0b"]) for _ in range(n))
        assert S.fingerprint(t, k) == brute_fp(t, k)
    assert S.fingerprint(None, k) == 0


def test_segments_within_two_errors_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    for n in (0, 1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, n, replace=False)) for _ in x])
        (ka, ua), (kb, ub) = S.segment_keys(x), S.segment_keys(x ^ flips)
        for i in range(len(x)):
            assert set(ka[i][ua[i]]) & set(kb[i][ub[i]])


def test_all_pairs_within_bits_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    for n in range(S.MAX_BITS + 1):
        y = x ^ np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in x], dtype=np.uint64)
        (ka, ra), (kb, rb) = S.fuzzy_keys(x.view(np.int64)), S.fuzzy_keys(y.view(np.int64))
        a, b = set(zip(ka.tolist(), ra.tolist(), strict=True)), set(zip(kb.tolist(), rb.tolist(), strict=True))
        assert {r for _, r in a & b} == set(range(len(x)))


@pytest.mark.parametrize(("small", "block"), [(16, 1 << 16), (2, 7), (3, 20)])
def test_linked_like_brute_force(spark, small, block):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps[:3] * 30 + fps)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps} | {0, -1})
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3)
    got = {r.node: r.root for r in components(S.linked(df, 4, small=small, block=block)).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (None, "only one"), (rows[5][0], rows[5][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fp string, rid int").coalesce(2)
    got = S.near_duplicates(docs, shingle=4, bits=4).collect()
    fps = {brute_fp(t, 4) for _, t in rows}
    comp = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d, t in rows:
        c = comp[brute_fp(t, 4)]
        least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
    want = [(d, f"{brute_fp(t, 4):016x}", least[comp[brute_fp(t, 4)]]) for d, t in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, want)) == sorted(key(r[2:5]) for r in got)
    assert sum(r.first for r in got) == len(set(comp.values()))
    kept = S.deduplicated(docs, shingle=4, bits=4)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))
    assert S.near_duplicates(docs.limit(0)).count() == 0
