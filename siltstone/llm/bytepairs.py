"""Byte-level BPE encoding and decoding: longest matches, backtracking, and a memo of which tokens may stand side by side."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.pieces import _lists

#: Entries that a worker's memos of pieces and of token pairs hold before they start anew.
MEMO = 1 << 18
#: Texts beyond so many characters are split a block of pieces at a time.
_LONG, _BLOCK = 1 << 20, 1 << 16


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairs:
    """A vocabulary of byte strings by rank, in which merges run from the least rank up and from left to right.

    Text that merges leave as tokens t1 t2 ... is the only sequence in which every two neighbours fit: merged by themselves,
    they would stay those two. So the longest token at each place is tried first, shorter ones after it, and where none
    fits its left neighbour, that neighbour is given up and its end is never reached again: time is linear in the text.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.rank, size = ranks, max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        #: Of each token: the two that merge to it (none for a byte), and the longest token that it begins with.
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.shorter = [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.words = ahocorasick.Automaton()
        last_byte = max((i for t, i in ranks.items() if len(t) == 1), default=-1)
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.token[i] = t
            self.words.add_word(t.decode("latin-1"), i)
            heads = [(ranks[t[:k]], k) for k in range(len(t) - 1, 0, -1) if t[:k] in ranks]
            if heads:
                self.shorter[i] = heads[0][0]
            if len(t) > 1:
                made = [(a, b) for a, k in heads if (b := ranks.get(t[k:], size)) < i and a < i and self._fit(a, b)]
                if i < last_byte or len(made) != 1:
                    raise ValueError(f"token {i} isn't what the merges of lower rank leave of its bytes")
                self.halves[i] = made[0]
                self.merged[made[0]] = i
        if sum(len(t) == 1 for t in ranks) < 256:
            raise ValueError("some bytes have no token")
        self.length = [len(t) for t in self.token]
        self.words.make_automaton()

    def _fit(self, left: int, right: int) -> bool:
        """Whether no merge across their border comes before the merges that made both. The tokens at the border are taken apart, latest first."""
        before = len(self.halves)
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left > right:  # of equal ones, the right is made last
                at, before = self.halves[left], left
                left = at[1] if at else -1
            else:
                at, before = self.halves[right], right + 1
                right = at[0] if at else -1
            if not at:
                return True

    def fit(self, left: int, right: int) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[left, right] = self._fit(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids that merging leaves of one piece of text."""
        if piece in self.rank:
            return [self.rank[piece]]
        n, length, shorter, fit = len(piece), self.length, self.shorter, self.fit
        longest = [-1] * n
        for end, t in self.words.iter(piece.decode("latin-1")):  # ends ascend, so the last at a start is the longest
            longest[end + 1 - length[t]] = t
        open_, out, at, t = bytearray(b"\1") * (n + 1), [], 0, longest[0] if n else -1
        while at < n:
            while t >= 0 and not (open_[at + length[t]] and (not out or fit(out[-1], t))):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at] if at < n else -1
            else:
                open_[at] = 0
                t = out.pop()
                at -= length[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Known(dict):
    """Little-endian 32-bit ids of pieces met lately; those of the time before last are forgotten when it is full."""

    def __init__(self, pairs: BytePairs):
        self.pairs, self.before = pairs, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.asarray(self.pairs.encode(piece.encode("utf-8")), "<i4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts: each match of the pattern is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        lines = Path(path).read_bytes().splitlines()
        self.pairs = BytePairs({base64.b64decode(t): int(i) for t, i in map(bytes.split, filter(None, lines))})
        self.pattern, self.known = regex.compile(pattern), _Known(self.pairs)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, _BLOCK)):
            yield some

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(b"".join(map(self.known.__getitem__, some)) for some in self._pieces(text)), "<i4")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the byte-level BPE ids of every text, without special tokens. pattern must match all of a text.

    Null and empty text: no ids. Null ids of rows stay null. Repeated rows get equal ids. Empty table: no row. Other columns are not read.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [enc.encode(t.as_py() or "") for t in some.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes binary): encode()'s rows with the bytes that the ids spell. Null ids: null bytes. An id that the vocabulary lacks raises."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern).pairs
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                spelled = [None if i is None else pairs.decode(i.tolist()) for i in _lists(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(spelled, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, bytes binary")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decode()'s rows."""
    listed = F.array_join("ids", ",")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
