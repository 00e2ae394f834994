"""Best-fit packing: bounded-space online best-fit of token pieces into fixed-length sequences."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts, without special tokens added.

    A byte-level BPE's ids are in the order of its merges, so the tokenizer file's vocabulary also serves as ranks for
    the quicker library. Texts that hold a special token's string, and texts which that library refuses, go to the file's own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        model = json.loads(Path(path).read_text())["model"]
        vocab, merges = model["vocab"], model["merges"]
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if k not in self.special}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"the ids of {path} are not in the order of its merges")
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except Exception:  # its pattern engine gives up on some very long runs
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, *, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece of each document."""
    end = np.asarray([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([enc.encode(text.as_py() or ""), end])
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    out.append((key, k, start, length, zlib.crc32(ids[start : start + length])))
            yield from _batches(out, ("i8", "i4", "i8", "i8", "i8"), ("doc_id", "piece", "start", "length", "ids_crc32"))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def _batches(rows: list[tuple], kinds: tuple, names: tuple) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.from_numpy_dtype(k)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class OpenBins:
    """At most max_open bins at a time; a bitset over their free space finds the best fit.

    An item goes into the open bin that it fills most. If none has room, a new bin opens, and if there are
    max_open already, the fullest is closed first.
    """

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open, self.n_bins = 0, 0, 0

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        found = same.pop()
        if not same:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.max_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.capacity - free


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = 1024, end_id: int = 2, max_open: int = 4096, pieces_per_task: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents and pack their pieces into sequences of at most capacity tokens.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Packing runs side by
    side in as many tasks as there are pieces_per_task pieces, each with max_open open bins, in the order of a hash of the
    piece; so a task's memory is fixed, and what a task leaves unfilled does not grow with the input.

    Null or empty text: one piece with the end id alone. Null ids stay null. Repeated rows are packed each. An empty
    table gives no row. Other columns of docs are not read.
    """
    pieces = cut(token_pieces(docs, path=path or tokenizer_path(), capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col))
    tasks = max(2, -(-pieces.count() // pieces_per_task))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, max_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            seq = pa.array([base + b for b, _ in places], type=pa.int64())
            off = pa.array([o for _, o in places], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), seq, off], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # of a checkpoint, so for good; equal rows go apart
    dealt = pieces.withColumn("__o", order).repartition(tasks, "__o").sortWithinPartitions("__o", "doc_id", "piece", "length", "ids_crc32")
    return dealt.drop("__o").mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")
