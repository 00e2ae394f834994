import math
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import pieces as P


@pytest.fixture(scope="module")
def lat():
    return P.Lattice(P.model_path())


def segmentations(lat, text):
    """All segmentations of a text in pieces and their probabilities, by enumeration."""
    shown = " " + text

    def go(i):
        if i == len(shown):
            yield [], 0.0
            return
        for j in range(i + 1, len(shown) + 1):
            t = lat.piece.get(shown[i:j].replace(" ", P.SPACE))
            if t is None and j == i + 1:
                raw = [lat.byte[b] for b in shown[i].encode()]
                ids, p = raw, lat.spelled * len(raw)
            elif t is None:
                continue
            else:
                ids, p = [t], lat.logp[t]
            for rest, q in go(j):
                yield ids + rest, p + q

    found = list(go(0))
    total = sum(math.exp(q) for _, q in found)
    return {tuple(ids): math.exp(q) / total for ids, q in found}


@pytest.mark.parametrize("text", ["the cat", "a1b.\nxé", "漢t  s"])
def test_samples_follow_the_exact_distribution(lat, text):
    want, n = segmentations(lat, text), 20_000
    got = Counter(tuple(x.tolist()) for x in lat.sample([text] * n, np.arange(n).astype(np.uint64)))
    assert set(got) <= set(want)
    assert sum(abs(got[k] / n - p) for k, p in want.items()) / 2 < 0.06


def test_lossless_and_reproducible(lat):
    rng = random.Random(8)
    texts = ["", " ", "\n", "▁", "a▁b ▁", "  two  spaces ", "\0\t\r\n", "😀é漢字 x", "x" * 5000, "don't \"stop\" 1,000.5%"]
    texts += ["".join(rng.choice(["ab", "The", " ", "\n", "▁", ".", "7", "é", "漢", "😀", "\t", "_", "İ", "á"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    seeds = np.arange(len(texts)).astype(np.uint64)
    ids = lat.sample(texts, seeds)
    assert [lat.decode(x.tolist()) for x in ids] == texts
    again = P.Lattice(P.model_path(), max_chunks=50)
    assert all((a == b).all() for k in (0, 100, 300) for a, b in zip(ids[k : k + 60], again.sample(texts[k : k + 60], seeds[k : k + 60]), strict=True))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(ids, lat.sample(texts, seeds + np.uint64(9)), strict=True))


def test_tables(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x y"), (1, "a b"), (5, "word " * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int")
    enc = P.encode(docs)
    assert sorted(map(str, P.decode(enc).collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert len({str(r) for r in enc.where("doc_id = 1").collect()}) == 1
    assert {r.doc_id: r.n_ids for r in P.round_trip(docs).collect()}[2] is None
    assert P.encode(docs.limit(0)).count() == 0
