"""SimHash near-dedup: fuzzy keys from the perfect binary Golay code, join on them, verify bit distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, id_and_text, kept_once, row_key
from siltstone.llm.components import components

#: Generator polynomial of the [23, 12, 7] code.
GENERATOR = 0b101011100011
#: (shift, width) of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Any two words of at most this distance share a key.
SEGMENT_ERRORS = 2
#: Two of three segments keep within SEGMENT_ERRORS up to this many differing bits.
MAX_BITS = 5
#: Runs of one key up to this length are compared pair by pair, at once for many runs.
SMALL_RUN = 16
#: Longer runs than this are dealt to other tasks in blocks of this length.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; A-Z lower-cased, words between ASCII white space. No word: 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(np.asarray(hashes[at : at + (1 << 14)], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of a word's low 12 and high 11 bits; by syndrome the error pattern of weight <= 3, its weight, and the five of weight 4."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)])
    high = np.array([syndrome(x << 12) for x in range(1 << 11)])
    leader, weight, fours = np.zeros(2048, np.int64), np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for w in range(5):
        for bits in combinations(range(23), w):
            x = sum(1 << b for b in bits)
            s = int(low[x & 4095] ^ high[x >> 12])
            if w < 4:
                leader[s], weight[s] = x, w
            else:
                fours[s].append(x)
    far = np.array([f or [0] * 5 for f in fours])
    return low, high, leader, weight, far


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of 23-bit words and which of them count.

    The first is the nearest codeword's. A word three bits from it has five more codewords four bits away, whose
    indices count too: with them, words that differ in at most two bits always share an index.
    """
    low, high, leader, weight, far = golay()
    s = low[words & 4095] ^ high[words >> 12]
    keys = np.concatenate([(words ^ leader[s])[:, None], words[:, None] ^ far[s]], axis=1) >> 11
    use = np.ones(keys.shape, bool)
    use[:, 1:] = (weight[s] == 3)[:, None]
    return keys, use


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs: for each two of the three segments, all pairs of their codeword indices."""
    x = fps.view(np.uint64)
    parts = [segment_keys(((x >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    keys, rows = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (ki, ui), (kj, uj) = parts[i], parts[j]
        use = (ui[:, :, None] & uj[:, None, :]).reshape(len(x), 36)
        key = (p << 24) + (ki[:, :, None] * 4096 + kj[:, None, :]).reshape(len(x), 36)
        keys.append(key[use])
        rows.append(np.nonzero(use)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) of each other member of the components of x (distinct, unsigned) under <= bits differing bits."""
    left, members, roots = x, [], []
    while left.size > 1:
        root, left = left[:1], left[1:]
        todo = [root]
        while todo and left.size:
            near = np.bitwise_count(left ^ todo.pop()[0]) <= bits
            if near.any():
                found, left = left[near], left[~near]
                members.append(found)
                roots.append(np.repeat(root, found.size))
                todo += [found[i : i + 1] for i in range(found.size)]
    none = x[:0]
    return (np.concatenate(members), np.concatenate(roots)) if members else (none, none)


class _Union:
    """Union-find over one task's edges, so that it passes on a forest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up, top = self.up, a
        while (p := up.get(top, top)) != top:
            top = p
        while a != top:
            up[a], a = top, up.get(a, a)
        return top

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(a, self.find(a)) for a in list(self.up) if self.find(a) != a]


LINKS = "a bigint, b bigint, key bigint, block int, fps array<bigint>"


def _rows(edges: list[tuple[int, int]], blocks: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    rows = [(a, b, None, None, None) for a, b in edges] + [(None, None, k, n, f) for k, n, f in blocks]
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names=["a", "b", "key", "block", "fps"])


def _link_runs(bits: int, small: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, n_blocks = _Union(), {}
        held_k, held_x = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def link(k: np.ndarray, x: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            lengths = np.diff(np.r_[starts, k.size])
            short = np.repeat(lengths <= small, lengths)
            ks, xs = k[short], x[short]
            for d in range(1, small):
                if ks.size <= d:
                    break
                near = np.flatnonzero((ks[d:] == ks[:-d]) & (np.bitwise_count(xs[d:] ^ xs[:-d]) <= bits))
                for a, b in zip(xs[near].view(np.int64).tolist(), xs[near + d].view(np.int64).tolist(), strict=True):
                    union.add(a, b)
            for i in np.flatnonzero(lengths > small):
                for a, b in zip(*(e.view(np.int64).tolist() for e in forest(x[starts[i] : starts[i] + lengths[i]], bits)), strict=True):
                    union.add(a, b)

        def passed_on(k: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            n_blocks[k] = n_blocks.get(k, -1) + 1
            yield from _rows([], [(k, n_blocks[k], x.view(np.int64))])

        for batch in batches:
            k, x = (np.concatenate([h, c.to_numpy(zero_copy_only=False).view(h.dtype)]) for h, c in zip((held_k, held_x), batch.columns, strict=True))
            if not k.size:
                continue
            last = int(np.searchsorted(k, k[-1]))
            done_k, done_x, held_k, held_x = k[:last], x[:last], k[last:], x[last:]
            if done_k.size and int(done_k[0]) in n_blocks:  # the end of a run that was too long to hold
                end = int(np.searchsorted(done_k, done_k[0], "right"))
                yield from passed_on(int(done_k[0]), done_x[:end])
                done_k, done_x = done_k[end:], done_x[end:]
            if done_k.size:
                link(done_k, done_x)
            while held_x.size > block:
                yield from passed_on(int(held_k[0]), held_x[:block])
                held_k, held_x = held_k[block:], held_x[block:]
            if len(union.up) > 1_000_000:
                yield from _rows(union.edges(), [])
                union.up.clear()
        if held_x.size:
            if int(held_k[0]) in n_blocks:
                yield from passed_on(int(held_k[0]), held_x)
            else:
                link(held_k, held_x)
        yield from _rows(union.edges(), [])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            some = fps[at : at + 4096]
            keys, rows = fuzzy_keys(some)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(some[rows], pa.int64())], names=["key", "fp"])


def linked(fps: DataFrame, bits: int, *, small: int = SMALL_RUN, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of distinct fingerprints (fp) that differ in at most bits bits.

    Every such pair meets under at least one key, and every meeting is verified. A key's run of fingerprints gives a
    forest, not all its pairs; runs longer than block are dealt out as pairs of blocks.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys guarantee 0 to {MAX_BITS} differing bits")
    keyed = fps.select("fp").mapInArrow(_keys, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key", "fp")
    found = cut(keyed.mapInArrow(_link_runs(bits, small, block), LINKS))
    blocks = found.where("key is not null").select("key", "block", "fps")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(*batch.columns, strict=True):
                x = np.unique(np.concatenate([np.asarray(one.as_py(), np.int64), np.asarray(two.as_py(), np.int64)]).view(np.uint64))
                m, r = forest(x, bits)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(r.view(np.int64))], names=["a", "b"])

    two = blocks.toDF("key", "block2", "fps2")
    pairs = blocks.join(two, (blocks["key"] == two["key"]) & (F.col("block") <= F.col("block2"))).select("fps", "fps2").repartition(F.xxhash64("fps", "fps2"))
    return found.where("key is null").select("a", "b").union(pairs.mapInArrow(across, "a bigint, b bigint")).distinct()


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(rid, k1, k2, doc_id, fp): a row for each row of docs; rid is its place in this scan, k1 and k2 name its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray([fingerprint(t.as_py(), shingle) for t in batch.column(4)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(fps)], names=["rid", "k1", "k2", "doc_id", "fp"])

    own, text = id_and_text(id_col, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *row_key(own, text), own.alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "rid bigint, k1 bigint, k2 bigint, doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, fingerprint, component_id, first): one row for each row of docs; k1 and k2 name its id and text.

    Rows whose fingerprints differ in at most bits bits are linked. component_id is the smallest doc_id that links
    reach, itself included; null where all of these are null. first: exactly one row of each component has it, with the
    smallest (doc_id, rid), null ids last. Rows with no word have fingerprint 0 and are linked like any other. Repeated
    rows are linked as equal texts. An empty table gives no row. Other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("d"))
    roots = components(linked(nodes, bits)).withColumnRenamed("node", "fp")
    nodes = cut(nodes.join(roots, "fp", "left").select("fp", "d", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("d").alias("component_id"))
    classes = nodes.join(least, "root").select("fp", "root", "component_id")
    out = rows.join(classes, "fp", "left")
    # ids first, then the place in the scan; a component without any id keeps its first row
    lowest = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("low"))
    keep = nodes.join(lowest, "fp").groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.rid").alias("rid"), F.lit(True).alias("first"))
    fp_hex = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.join(keep, "rid", "left").select("k1", "k2", "doc_id", fp_hex.alias("fingerprint"), "component_id", F.coalesce("first", F.lit(False)).alias("first"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() does not call first, with all its columns. Of rows with equal id and text any one may stay."""
    found = near_duplicates(docs, shingle=shingle, bits=bits, id_col=id_col, text_col=text_col)
    judged = cut(found.groupBy("k1", "k2").agg(F.bool_or("first").alias("first"), F.count("*").alias("n")).where("not first or n > 1").select("k1", "k2", "first"))
    return kept_once(docs, row_key(*id_and_text(id_col, text_col)), judged)
