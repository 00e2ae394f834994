"""SentencePiece encoding and decoding: forward-filtering, backward-sampling over the lattice of pieces."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Pieces of the model hold spaces only in front and never join letters to other characters, so chunks may end at both.
_CHUNK = re.compile(r"\n| *(?:[^\W\d_]+|[^ \nA-Za-z]+?(?=[^\W\d_]|[ \n]|$))| +")

_CODE_BITS = 21
#: No character.
_NONE = (1 << _CODE_BITS) - 1


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """Pieces of a model and the compiled lattices of the chunks of text seen so far.

    A piece's log probability is sharp times the log of its rank, a unigram model over the model's order of pieces. A
    compiled chunk is a row of nodes, one for each place in it; a node's incoming edges follow one another from head, the
    longest first, with their backward-sampling probabilities cumulated. These figures depend on the chunk alone, so a
    task run again draws the same edges. A character that no piece covers is spelled in byte pieces. The cache is
    emptied beyond max_chunks.
    """

    def __init__(self, path: str, sharp: float = 1.0, max_chunks: int = 120_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.sharp, self.max_chunks = n, sharp, max_chunks
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.piece = {sp.id_to_piece(i): i for i in order}
        self.longest = max(map(len, self.piece))
        self.spelled = -sharp * math.log(2 + n)
        self.logp = np.full(n, self.spelled)
        self.logp[order] = -sharp * np.log(2 + np.arange(len(order)))
        self.raw = [b""] * n
        for p, i in self.piece.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.byte_of = np.asarray([self.byte[b] for b in range(128)])
        self._build_trie()
        self.clear()

    def _build_trie(self) -> None:
        """Steps of the trie of pieces, sorted by (node, code point), and the piece that ends at each node or -1."""
        steps: dict[int, int] = {}
        ends = [-1]
        for p, i in self.piece.items():
            node = 0
            for c in p:
                node = steps.setdefault((node << _CODE_BITS) | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.step_key = np.asarray(sorted(steps), np.int64)
        self.step_to = np.asarray([steps[k] for k in self.step_key.tolist()], np.int64)
        self.ends_piece = np.asarray(ends, np.int64)

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.head, self.cum, self.token, self.prev = array("i"), array("d"), array("i"), array("i")
        self.n_nodes = 0

    def _edges(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Edges of new chunks' lattices, sorted by end and then start: start, end, token and place (the end within its chunk); and the number of nodes.

        All places walk the trie of pieces together, a character further each turn, until none has a longer piece.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        last = np.cumsum(size) - 1
        plain = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code = np.where(plain == ord(" "), ord(SPACE), np.where(plain == ord(SPACE), _NONE, plain))
        code[last] = _NONE
        place = np.arange(len(code)) - np.repeat(last - size + 1, size)
        inside = np.ones(len(code), bool)
        inside[last] = False
        at = np.flatnonzero(inside)
        state, found = np.zeros(len(at), np.int64), []
        for d in range(1, self.longest + 1):
            key = (state << _CODE_BITS) | code[at + d - 1]
            slot = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            hit = self.step_key[slot] == key
            state = self.step_to[slot]
            tok = np.where(hit, self.ends_piece[state], -1)
            if d == 1:
                # a token of several ids: the character's code point beyond the pieces
                c = plain[at]
                tok = np.where(tok >= 0, tok, np.where(c < 128, self.byte_of[np.minimum(c, 127)], self.size + c))
            ends = tok >= 0
            found.append((at[ends], at[ends] + d, tok[ends]))
            at, state = at[hit], state[hit]
            if not at.size:
                break
        s, e, tok = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(e * (self.longest + 1) + s - e, kind="stable")
        return s[order], e[order], tok[order], place[e[order]], len(code)

    def _learn(self, chunks: list[str]) -> None:
        """Forward-filter new chunks, place by place for all at once: each edge into a place gets the share of all ways there that end with it."""
        size, first = self.size, self.n_nodes
        s, e, tok, at, n = self._edges(chunks)
        s, e, self.n_nodes = s + first, e + first, first + n
        self.end.update(zip(chunks, (first - 1 + np.cumsum([len(c) + 1 for c in chunks])).tolist(), strict=True))
        n_bytes = 2 + (tok - size >= 0x800) + (tok - size >= 0x10000)
        logp = np.where(tok < size, self.logp[np.minimum(tok, size - 1)], self.spelled * n_bytes)
        forward, share = np.zeros(n), np.empty(len(e))
        order = np.argsort(at, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            x = forward[s[some] - first] + logp[some]
            heads = np.flatnonzero(np.r_[True, np.diff(e[some]) != 0])
            reps = np.diff(np.r_[heads, len(some)])
            top = np.maximum.reduceat(x, heads)
            w = np.exp(x - np.repeat(top, reps))
            total = np.add.reduceat(w, heads)
            forward[e[some[heads]] - first] = top + np.log(total)
            share[some] = w / np.repeat(total, reps)
        heads = np.flatnonzero(np.r_[True, np.diff(e) != 0])
        reps = np.diff(np.r_[heads, len(e)])
        more = heads[reps > 1]
        left = reps[reps > 1] - 1
        while more.size:
            share[more + 1] += share[more]
            more, left = more[left > 1] + 1, left[left > 1] - 1
        share[heads + reps - 1] = 1
        head = np.zeros(n, np.int32)
        head[e[heads] - first] = len(self.cum) + heads
        for kept, new in ((self.head, head), (self.cum, share), (self.token, tok.astype(np.int32)), (self.prev, s.astype(np.int32))):
            kept.frombytes(new.tobytes())

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of one segmentation of each text, drawn by its seed; the same text and seed give the same ids."""
        if len(self.end) > self.max_chunks:
            self.clear()
        chunks = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(chunks))
        new = set(flat).difference(self.end)
        if new:
            self._learn(list(new))
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        cur = np.fromiter(map(self.end.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(cur)) - np.repeat(np.cumsum(n) - n, n)
        base = _mix(seeds[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        head, cum, token, prev = (np.frombuffer(a, t) if len(a) else np.zeros(0, t) for a, t in ((self.head, np.int32), (self.cum, np.float64), (self.token, np.int32), (self.prev, np.int32)))
        start = cur - np.fromiter(map(len, flat), np.int64, len(flat))
        active, at, steps, step = np.arange(len(cur)), cur, [], 0
        while active.size:
            u = (_mix(base[active] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            e = head[at]
            past = np.flatnonzero(cum[e] <= u)
            while past.size:
                e[past] += 1
                past = past[cum[e[past]] <= u[past]]
            steps.append((active, token[e]))
            at = prev[e]
            on = at > start[active]
            active, at = active[on], at[on]
            step += 1
        count = np.zeros(len(cur), np.int64)
        for a, _ in steps:
            count[a] += 1
        end = np.cumsum(count)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for s, (a, t) in enumerate(steps):
            out[end[a] - 1 - s] = t
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])]
        return [self._spell(out[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _spell(self, tokens: np.ndarray) -> np.ndarray:
        if tokens.size and tokens.max() >= self.size:
            tokens = np.asarray([i for t in tokens.tolist() for i in ([t] if t < self.size else [self.byte[b] for b in chr(t - self.size).encode("utf-8", "surrogatepass")])], np.int32)
        return tokens

    def spelled_out(self, ids: list[int]) -> bytes:
        """UTF-8 of the text: pieces and bytes joined, without the space that encoding puts before."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]

    def decode(self, ids: list[int]) -> str:
        return self.spelled_out(ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(path: str, sharp: float) -> Lattice:
    """One for each Python worker."""
    return Lattice(path, sharp)


def _lists(column: pa.ListArray) -> list[np.ndarray | None]:
    """The ids of each row, None for null."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def encode(docs: DataFrame, *, path: str | None = None, seed: int = 1, sharp: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): a sampled segmentation of every text, the same for the same id, text and seed.

    Null text: null ids; empty text: no ids. Rows with null id share a seed. Repeated rows get equal ids. Empty table: no row.
    """
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(where, sharp)
        for batch in batches:
            keys, texts = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_pylist()
            for at in range(0, len(texts), 64):
                some = texts[at : at + 64]
                ids = lat.sample([t or "" for t in some], keys[at : at + 64])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in some]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 64], lists], names=["doc_id", "ids"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.lit(seed), id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None, sharp: float = 1.0) -> DataFrame:
    """(doc_id, text) of encode()'s rows. Null ids: null text."""
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(where, sharp)
        for batch in batches:
            texts = [None if i is None else lat.decode(i.tolist()) for i in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, *, path: str | None = None, seed: int = 1, sharp: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32): what encode() gives for every text, and a checksum of the text decoded from it.

    Null text: null in all but doc_id.
    """
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(where, sharp)
        for batch in batches:
            ids = _lists(batch.column(1))
            n = [None if i is None else len(i) for i in ids]
            ic = [None if i is None else zlib.crc32(i.astype("<u4")) for i in ids]
            tc = [None if i is None else zlib.crc32(lat.spelled_out(i.tolist())) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, ic, tc))], names=["doc_id", "n_ids", "ids_crc32", "text_crc32"])

    return encode(docs, path=path, seed=seed, sharp=sharp, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, text_crc32 bigint")
