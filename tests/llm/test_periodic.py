import hashlib
import random
import zlib

import pytest

from siltstone.llm import periodic as P


def brute(words, min_length, min_repeats):
    """All maximal runs, by trying each period at each place; of one stretch the smallest period stays."""
    found, n = {}, len(words)
    for p in range(1, n + 1):
        s = 0
        while s < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e > s and e + p - s >= max(min_length, min_repeats * p):
                found.setdefault((s, e + p - s), p)
            s = e + 1
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeated(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def some_words(rng):
    n, letters = rng.randint(0, 40), rng.choice(["a", "ab", "abc", "abcdefgh"])
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // (2 + rng.randrange(8))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize(("min_length", "min_repeats"), [(6, 4), (2, 2), (4, 3), (1, 2)])
def test_runs_like_brute_force(min_length, min_repeats):
    rng = random.Random(min_length * 10 + min_repeats)
    for _ in range(600):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        for w, (n, runs, rest) in zip(texts, P._found([" ".join(w).encode() for w in texts], min_length, min_repeats), strict=True):
            want = brute(w, min_length, min_repeats)
            assert (n, runs, rest.decode()) == (len(w), want, collapsed(w, want)), w


def test_texts_of_a_block_stay_apart():
    same = [b"a a a", b"a a a", b"a b a b a b a b", b"", b"b a b a"]
    assert [r for _, r, _ in P._found(same, 2, 2)] == [[(0, 3, 1)], [(0, 3, 1)], [(0, 8, 2)], [], [(0, 4, 2)]]


@pytest.mark.parametrize("text", ["a " * 200_000, "a b a " * 60_000])
def test_long_texts(text):
    n, runs, rest = P._found([text.encode()], 6, 4)[0]
    p = 1 if "b" not in text else 3
    assert runs == [(0, n, 1)] if p == 1 else (0, n, 3) in runs
    assert len(rest.split()) == p


def test_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    assert P._found([" ".join(b).encode()], 2, 2)[0][1] == brute(b, 2, 2)


def test_query_columns_like_brute_force(spark, sf_dir):
    rows = [(1, "a b\tc\x0bd"), (1, "a b\tc\x0bd"), (2, None), (3, ""), (None, "x " * 9), (20, "w v w v w v w v w v w v z"), (5, " \n")]
    rows += [(i, "la lo la lo la lo la lo lu " * 3 + "x y " * (i % 7)) for i in range(100, 200)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, runs string, n_words int")
    got = sorted(map(str, (tuple(r) for r in P.digest(P.periodic_runs(P.with_repeats(docs))).collect())))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        w = [x.decode() for x in (repeated(i, w) if i is not None else w)]
        runs = brute(w, 6, 4)
        top = None
        for r in runs:
            top = r if top is None or r[1] * top[2] > top[1] * r[2] else top
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((i, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(w, runs))))
    assert got == sorted(map(str, want))
    assert any("'" in x for x in got) and sum(r[1] > 0 for r in want) > 20
    assert P.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        P.periodic_runs(docs, min_repeats=1)
