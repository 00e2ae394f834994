import base64
import hashlib
import random
from pathlib import Path

import pytest

from siltstone.llm import bytepairs as B


@pytest.fixture(scope="module")
def enc():
    return B.Encoder(B.ranks_path(), B.split_pattern())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, Path(B.ranks_path()).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=B.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def merged(ranks, piece):
    """Plain byte pair merging: the pair of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def trained(rng, letters, n_merges):
    """A small vocabulary by the usual training: the most frequent pair becomes a token."""
    ranks = {bytes([b]): b for b in range(256)}
    word = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 30))).encode() for _ in range(40)]
    for _ in range(n_merges):
        count: dict = {}
        for w in word:
            ids = merged(ranks, w)
            for pair in zip(ids, ids[1:], strict=False):
                count[pair] = count.get(pair, 0) + 1
        if not count:
            break
        spelled = {i: t for t, i in ranks.items()}
        a, b = max(count, key=lambda p: (count[p], p))
        if spelled[a] + spelled[b] in ranks:
            break
        ranks[spelled[a] + spelled[b]] = len(ranks)
    return ranks


@pytest.mark.parametrize("letters", ["ab", "aab", "abcd"])
def test_like_plain_merging(letters):
    rng = random.Random(len(letters))
    for _ in range(6):
        ranks = trained(rng, letters, 40)
        pairs = B.BytePairs(ranks)
        for _ in range(300):
            piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))).encode()
            assert pairs.encode(piece) == merged(ranks, piece)
            assert pairs.decode(pairs.encode(piece)) == piece


def test_like_the_library(enc, library):
    rng = random.Random(5)
    texts = ["", " ", "\n\n  x", "a" * 3000, "ab" * 3000 + "c", "\t \r\n" * 50, "don't 'LL x's", "é漢字 😀👩‍👩‍👧 ́x", "\x00\x1c\x1f\x85 　 z", "<|endoftext|>"]
    texts += ["".join(rng.choice(["the", "inon", " ", "\n", "7", "'s", "é", "漢", "😀", "\t", "_", "İ", " ", "a"]) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(chr(c) for c in range(lo, lo + 97) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 97)]
    for t in texts:
        assert enc.encode(t).tolist() == library.encode_ordinary(t)


def test_long_runs_without_a_border(enc, library):
    for text in ("z" * 200_000, " " * 200_001, "ab" * 100_000):
        ids = enc.encode(text).tolist()
        assert enc.pairs.decode(ids).decode() == text
    text = " ".join(f"word{i}" for i in range(300_000))  # beyond what is split at a time
    assert enc.encode(text).tolist() == library.encode_ordinary(text)


def test_memos_forget(monkeypatch, enc, library):
    monkeypatch.setattr(B, "MEMO", 5)
    small = B.Encoder(B.ranks_path(), B.split_pattern())
    text = " ".join(f"nonesuch{i % 17} word{i}" for i in range(300))
    assert small.encode(text).tolist() == library.encode_ordinary(text) and len(small.known) <= 5 and len(small.pairs.memo) <= 5


def test_bad_vocabularies():
    byte = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="merges"):
        B.BytePairs(byte | {b"abc": 256})
    with pytest.raises(ValueError, match="no token"):
        B.BytePairs({b"a": 0})


def test_tables(spark, sf_dir, library):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x y"), (1, "a b"), (5, "word é " * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int")
    both = B.decode(B.encode(docs))
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in both.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert B.encode(docs.limit(0)).count() == 0 and B.digest(both).where("doc_id = 2").first().n_tokens == 0
    nothing = spark.createDataFrame([(7, None)], "doc_id bigint, ids array<int>")
    assert B.decode(nothing).first().bytes is None
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(r.doc_id, len(i := library.encode_ordinary(r.text or "")), sha(",".join(map(str, i)).encode()), sha((r.text or "").encode())) for r in given.collect()}
    assert {tuple(r) for r in B.digest(B.decode(B.encode(given))).collect()} == want
