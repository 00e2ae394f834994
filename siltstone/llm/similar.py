"""Texts of Jaccard similarity 0.8 and more, by SimHash: soft-decoded Golay keys, join on them, verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, id_and_text, kept_once, matched, row_key
from siltstone.llm.components import components
from siltstone.llm.simhash import GENERATOR

#: 64-bit words of a wide fingerprint, and the segments of 23 bits that it is cut into.
WIDE_WORDS = 6
SEGMENTS = WIDE_WORDS * 64 // 23
#: Codewords of each segment: the nearest ones.
NEAREST = 2
#: Each segment makes keys with so many that follow it, the last's followers being the first: every two segments meet once.
FOLLOWERS = SEGMENTS // 2
#: Two texts with one key are a candidate if the first 128 bits of their fingerprints differ in at most this many. Bits of texts
#: of similarity 0.8 differ with probability 0.15 at most: 41 or more of 128 do in 1.3 of a million such pairs.
LOOSE_BITS = 40
#: Runs of one key of at most this many texts are compared at once for all runs; longer ones one by one.
SHORT_RUN = 24
#: Texts that share a segment's codeword are compared in pairs of blocks of about this many.
BLOCK = 1 << 16
#: Counts below this of one codeword in one task aren't told when blocks are planned.
FEW = 64
#: Texts whose keys are packed together.
BATCH = 4096
#: Keys are dealt in so many parts for each shuffle partition, so that partitions are alike in size.
PARTS = 8
#: Groups of more shingle hashes than this are compared in blocks of about so many.
BLOCK_HASHES = 1 << 20
PROFILE = "k1 bigint, k2 bigint, doc_id bigint, node bigint, x0 bigint, x1 bigint, codes binary, n_hashes int"


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of all shingles; fewer words than that: of the whole sequence; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, w.size)
    h = np.full(w.size - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h ^ w[i : i + h.size], i)
    return np.unique(h)


def short_hashes(h: np.ndarray) -> np.ndarray:
    """The set that texts are verified on: 32 bits of each shingle's hash, sorted."""
    return np.unique((_mixed(h, 99) >> np.uint64(32)).astype("<u4"))


def margins(h: np.ndarray) -> np.ndarray:
    """By how much each bit of the wide SimHash is decided: set less unset, over all shingles."""
    counts = np.zeros(WIDE_WORDS * 64, np.int64)
    for at in range(0, h.size, 255):  # so that sums fit in bytes
        some = h[at : at + 255]
        wide = np.stack([_mixed(some, s) for s in range(1, WIDE_WORDS + 1)], axis=1).astype("<u8")
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * counts - h.size) / max(h.size, 1) ** 0.5


@lru_cache(maxsize=1)
def codebook() -> np.ndarray:
    """(2048, 23) of +1 and -1: half of the Golay codewords; the others are their complements."""
    words = []
    for i in range(2048):
        x = i << 11
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        words.append((i << 11) | x)
    return (((np.array(words)[:, None] >> np.arange(23)) & 1) * 2 - 1).astype(np.float32)


def segment_codes(m: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS, NEAREST) indices of the codewords nearest to each segment, unsure bits weighing less; the nearest first."""
    book, out, row = codebook(), np.empty((len(m), SEGMENTS, NEAREST), np.uint16), np.arange(len(m))
    for s in range(SEGMENTS):
        score = m[:, 23 * s : 23 * s + 23].astype(np.float32) @ book.T
        size = np.abs(score)
        for c in range(NEAREST):
            # a complement is as far below as its word is above, so it is never among the two nearest
            best = size.argmax(axis=1)
            out[:, s, c] = best * 2 + (score[row, best] < 0)
            size[row, best] = -1
    return out


def followers(i: int) -> list[int]:
    """The segments that segment i makes keys with: of each two segments, one is a follower of the other."""
    last = FOLLOWERS if SEGMENTS % 2 or i < SEGMENTS // 2 else FOLLOWERS - 1
    return [(i + d) % SEGMENTS for d in range(1, last + 1)]


def keys_of(codes: np.ndarray) -> np.ndarray:
    """(n, keys) of segment_codes(): for each two segments, each two of their codeword indices.

    By pigeonhole, texts meet if any two segments have a codeword in common.
    """
    c = codes.reshape(-1, SEGMENTS, NEAREST).astype(np.int64)
    pairs = [((i * SEGMENTS + j) << 24) + (c[:, i, :, None] * 4096 + c[:, j, None, :]).reshape(len(c), -1) for i in range(SEGMENTS) for j in followers(i)]
    return np.concatenate(pairs, axis=1)


def profiles(docs: DataFrame, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """PROFILE of every row. node names the sequence of lower-cased words; codes are those of its segments."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, marks, sizes, known = [], [], [], _WordHashes()
        for t in batch.column(3):
            words = words_of(t.as_py())
            h = shingle_hashes(words, shingle, known)
            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            marks.append(margins(h))
            sizes.append(short_hashes(h).size)
        m = np.stack(marks)
        first = np.ascontiguousarray(np.packbits(m[:, :128] > 0, axis=1, bitorder="little").view("<i8").T)
        codes = [c.astype("<u2").tobytes() for c in segment_codes(m)]
        node = np.array(nodes, np.uint64).view(np.int64)
        columns = [*(batch.column(i) for i in range(3)), pa.array(node), pa.array(first[0]), pa.array(first[1]), pa.array(codes, pa.binary()), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PROFILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield rows(batch.slice(at, 512))

    own = docs.select(*row_key(*id_and_text(id_col, text_col)), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, PROFILE)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SEGMENTS, NEAREST)


def planned_blocks(nodes: DataFrame, block: int = BLOCK, few: int = FEW) -> dict[int, int]:
    """Into how many blocks the texts of a codeword of a segment fall, where more than one: by segment * 4096 + codeword.

    At most 65,536 counts, whatever the input. Codewords that few texts of a task have aren't counted there, so a block may be larger by
    few texts a task. That affects the size of blocks and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENTS * 4096, np.int64)
        for batch in batches:
            total += np.bincount((_codes(batch.column(0)) + np.arange(SEGMENTS)[:, None] * 4096).ravel().astype(np.int64), minlength=total.size)
        many = np.flatnonzero(total >= few)
        yield pa.RecordBatch.from_arrays([pa.array(many.astype(np.int32)), pa.array(total[many])], names=["code", "n"])

    found = nodes.select("codes").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    return {r.code: -(-r.n // block) for r in found.collect()}


def _dealt(parts: int, blocks: dict[int, int]):
    """(part, segment, groups, nodes, bits, codes) from rows (node, x0, x1, codes): many texts, packed by part.

    A part has texts of one segment, by groups that share a codeword there; a text goes to the group of each codeword of each of its
    segments, and takes along the codewords of the segment's followers. Codewords in blocks have a group for each two blocks.
    """
    n_blocks = np.ones(SEGMENTS * 4096, np.int64)
    for k, n in blocks.items():
        n_blocks[k] = n

    def packed(node: np.ndarray, bits: np.ndarray, codes: np.ndarray, s: int) -> pa.RecordBatch:
        row, group = np.repeat(np.arange(len(node)), NEAREST), codes[:, s].ravel().astype(np.int64) + s * 4096
        n = n_blocks[group]
        if (n > 1).any():  # to each pair of its own block with another
            own = (_mixed(node[row].view(np.uint64), 11) % n.astype(np.uint64)).astype(np.int64)
            row, group, own = np.repeat(row, n), np.repeat(group, n), np.repeat(own, n)
            other = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            group = group | np.minimum(own, other) << 16 | np.maximum(own, other) << 40
        part = (_mixed(group.view(np.uint64), 7) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, row, group = part[order], row[order], group[order]
        own, starts = np.unique(part, return_index=True)
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), row.size], strict=True))
        follow = np.ascontiguousarray(codes[:, followers(s)]).reshape(len(node), -1)
        blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (group, node[row], bits[row], follow[row])]
        return pa.RecordBatch.from_arrays([pa.array((own * SEGMENTS + s).astype(np.int64)), *blobs], names=["part", "groups", "nodes", "bits", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                node, *x = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                bits, codes = np.stack(x, axis=1), _codes(some.column(3))
                for s in range(SEGMENTS):
                    yield packed(node, bits, codes, s)

    return run


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of 64-bit words differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def tree(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of the rows of x under at most bits differing bits."""
    left, a, b = np.arange(len(x)), [], []
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            t = todo.pop()
            near = _far(x[left], x[t]) <= bits
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(found.size, t))
                b.append(found)
                todo += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that edges (a, b) join it to."""
    low = np.arange(n)
    while True:
        one, two = low[a], low[b]
        apart = one != two
        if not apart.any():
            return low
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(low, np.maximum(one, two), np.minimum(one, two))
        while (low[low] != low).any():
            low = low[low]


def _edges_of_part(group: np.ndarray, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of edges with the same components as all pairs of a group that share a follower's codeword and are near by x."""
    all_a, all_b = [], []
    place = np.repeat(np.arange(group.size), NEAREST)
    of = np.unique(group, return_inverse=True)[1] << 12
    for f in range(codes.shape[1]):
        k = (of[:, None] + codes[:, f]).ravel()
        order = np.argsort(k, kind="stable")
        ks, at = k[order], place[order]
        starts = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
        lengths = np.diff(np.r_[starts, ks.size])
        short = np.repeat((lengths <= SHORT_RUN) & (lengths > 1), lengths)
        k2, p2 = ks[short], at[short]
        for d in range(1, min(SHORT_RUN, k2.size)):
            same = np.flatnonzero(k2[d:] == k2[:-d])
            if not same.size:
                break
            one, two = p2[same], p2[same + d]
            near = _far(x[one], x[two]) <= LOOSE_BITS
            all_a.append(one[near])
            all_b.append(two[near])
        for i in np.flatnonzero(lengths > SHORT_RUN):
            run = at[starts[i] : starts[i] + lengths[i]]
            one, two = tree(x[run], LOOSE_BITS)
            all_a.append(run[one])
            all_b.append(run[two])
    none = np.zeros(0, np.int64)
    return (np.concatenate(all_a), np.concatenate(all_b)) if all_a else (none, none)


def _forest_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of packed rows, sorted by part: a task's forest over its parts' edges, each node with the least that it is joined to."""
    held, part, found = [[], [], [], []], None, []

    def edges() -> np.ndarray:
        group, node, x, codes = (np.frombuffer(b"".join(b), t) for b, t in zip(held, ("<i8", "<i8", "<u8", "<u2"), strict=True))
        a, b = _edges_of_part(group, x.reshape(-1, 2), codes.reshape(group.size, -1, NEAREST))
        return _spanning(node[a], node[b])

    for batch in batches:
        for p, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if part is not None:
                    found.append(edges())
                part, held = p, [[], [], [], []]
            for to, blob in zip(held, blobs, strict=True):
                to.append(blob)
    if part is not None:
        found.append(edges())
        a, b = _spanning(*np.concatenate(found, axis=1))
        for at in range(0, a.size, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000]), pa.array(b[at : at + 10_000])], names=["a", "b"])


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(2, edges): each node of edges (a, b) but the least ones, and the least that it is joined to."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    low = forest(nodes.size, at[: a.size], at[a.size :])
    up = np.flatnonzero(low != np.arange(nodes.size))
    return np.stack([nodes[up], nodes[low[up]]])


def candidates(nodes: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of nodes (node, x0, x1, codes) that meet under a key and are near by their first bits."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-PARTS * partitions // SEGMENTS)
    nodes = nodes.coalesce(max(1, -(-nodes.count() // BATCH)))  # fewer texts a task would make nearly empty packs
    keyed = nodes.select("node", "x0", "x1", "codes").mapInArrow(_dealt(parts, planned_blocks(nodes, block, few)), "part bigint, groups binary, nodes binary, bits binary, codes binary")
    return keyed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_forest_of_parts, "a bigint, b bigint").distinct()


class _Sets:
    """Hash sets of texts with an index from each hash to the texts that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, self.sizes = len(sets), np.array([s.size for s in sets], np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.holders = owner[np.argsort(self.ids, kind="stable")]
        counts = np.bincount(self.ids)
        self.ends, self.own = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(self.sizes)]
        #: The mean number of texts that have a text's hashes: an original has the commonest ones of its copies.
        self.common = np.bincount(owner, counts[self.ids], self.n) / np.maximum(self.sizes, 1)

    def near(self, p: int, similarity: float) -> np.ndarray:
        """Whether each text is near enough to text p."""
        mine = [self.holders[self.ends[i] : self.ends[i + 1]] for i in self.ids[self.own[p] : self.own[p + 1]]]
        same = np.bincount(np.concatenate(mine), minlength=self.n) if mine else np.zeros(self.n, np.int64)
        return same / np.maximum(self.sizes[p] + self.sizes - same, 1) >= similarity


def near_links(sets: list[np.ndarray], similarity: float, part: np.ndarray | None = None, asking: np.ndarray | None = None, main: int | None = None) -> tuple[list[int], list[int]]:
    """Positions (a, b) of links with the same components as all pairs of distinct hash sets of at least that similarity.

    A pair is only left out if its texts are already joined: every text is compared with all others until the rest are one
    component. Texts whose shingles are the commonest come first, since an original joins its copies at once. With part (what is joined
    already), asking and main: only texts that ask are compared with all others, and only while they aren't in the part main.
    """
    index, a, b = _Sets(sets), [], []
    part = np.arange(index.n) if part is None else part.copy()
    at_main = np.flatnonzero(part == main)[:1] if main is not None else None
    order = np.argsort(-index.common, kind="stable")
    done = np.zeros(index.n, bool) if asking is None else ~asking
    while True:
        left = part[at_main] if main is not None else np.bincount(part, minlength=1).argmax()
        todo = ~done[order] & (part[order] != left if np.size(left) else True)
        if not todo.any():
            return a, b
        p = order[todo.argmax()]
        done[p] = True
        near = np.flatnonzero(index.near(p, similarity) & (part != part[p]))
        if near.size:
            parts, first = np.unique(part[near], return_index=True)
            a += [int(p)] * first.size
            b += near[first].tolist()
            part[np.isin(part, parts)] = part[p]


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list, dict[int, tuple]]]:
    """(key, {node: its other columns}) of batches in order of their first n_keys columns, which a column node follows; equal rows of a node count once."""
    key, rows = None, {}
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k, node, rest = list(values[:n_keys]), values[n_keys], values[n_keys + 1 :]
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, {}
            rows[node] = max(rows.get(node, rest), rest)  # a node that asks and is there counts as one that asks
    if rows:
        yield key, rows


def _edges(nodes: list[int], found: tuple[list[int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.int64()) for x in found], names=["a", "b"])


def _grouped_links(similarity: float):
    """Links within each group: rows (root, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 1):
            if len(rows) > 1:
                yield _edges(list(rows), near_links([np.frombuffer(s, "<u4") for (s,) in rows.values()], similarity))

    return run


def _leaders(most: int):
    """(root, node, common) of the texts with the commonest hashes of each block: rows (root, block, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, _), rows in _by_key(batches, 2):
            index, nodes = _Sets([np.frombuffer(s, "<u4") for (s,) in rows.values()]), list(rows)
            best = np.argsort(-index.common, kind="stable")[:most]
            share = index.common / index.n
            yield pa.RecordBatch.from_arrays([pa.array([root] * best.size, pa.int64()), pa.array([nodes[i] for i in best], pa.int64()), pa.array(share[best])], names=["root", "node", "common"])

    return run


def _asked_links(similarity: float):
    """Links between those that ask and all of a block: rows (root, block, turn, node, asks, part, main, shingles); main is a part, the same in all rows of a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 3):
            asks, parts, mains, sets = zip(*rows.values(), strict=True)
            names, part = np.unique(np.array(parts, np.int64), return_inverse=True)
            at = np.flatnonzero(names == mains[0])
            yield _edges(list(rows), near_links([np.frombuffer(s, "<u4") for s in sets], similarity, part, np.array(asks), int(at[0]) if at.size else -1))

    return run


def _met_sets(shingle: int):
    """(root, n, block, node, shingles) from (root, n, block, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, known = batch.slice(at, 512), _WordHashes()
                sets = [short_hashes(shingle_hashes(words_of(t.as_py()), shingle, known)).tobytes() for t in some.column(4)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["root", "n", "block", "node", "shingles"])

    return run


#: Texts of a large group that all of its texts are compared with first: the ones of the commonest hashes.
PIVOTS = 8


def large_group_links(sets: DataFrame, similarity: float, block_hashes: int) -> DataFrame:
    """Links within groups in blocks, of sets (root, n, block, node, shingles), a checkpoint.

    All texts of a group are compared with a few pivots. What these don't join to the group's largest part asks: it is compared with all texts of the group,
    in blocks. So a group of copies of one text takes time in proportion to its size, and no pair is left out unless its texts are joined.
    """
    by_block = sets.select("root", "block", "node", "shingles").repartition("root", "block").sortWithinPartitions("root", "block")
    best = by_block.mapInArrow(_leaders(2), "root bigint, node bigint, common double")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("common"), "node"))
    pivots = best.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("node")
    ask = cut(matched(sets, cut(pivots), ["node"], "inner").select("root", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(0).alias("turn"), "node", F.lit(True).alias("asks"), F.col("node").alias("part"), F.lit(0).cast("bigint").alias("main"), "shingles"))
    there = sets.select("root", "block", F.lit(0).alias("turn"), "node", F.lit(False).alias("asks"), F.col("node").alias("part"), F.lit(0).cast("bigint").alias("main"), "shingles")
    run = lambda rows: rows.repartition("root", "block", "turn").sortWithinPartitions("root", "block", "turn").mapInArrow(_asked_links(similarity), "a bigint, b bigint")
    first = cut(run(there.unionByName(ask)))

    known = sets.select("root", "n", "block", "node", (F.length("shingles") / 4).cast("int").alias("n_hashes"))
    known = known.join(components(first).withColumnRenamed("root", "joined"), "node", "left").withColumn("part", F.coalesce("joined", "node")).drop("joined")
    main = known.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    known = cut(known.join(main, "root"))
    out = known.where("part <> main")
    turns = out.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_hashes") / block_hashes)).cast("int").alias("turns"))
    asked = cut(out.join(turns, "root").select("node", F.pmod(F.xxhash64("node", F.lit(5)), F.col("turns")).cast("int").alias("turn")))
    told = sets.join(known.select("node", "part", "main"), "node")
    ask = told.join(asked, "node").select("root", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "turn", "node", F.lit(True).alias("asks"), "part", "main", "shingles")
    there = told.join(turns, "root").select("root", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "node", F.lit(False).alias("asks"), "part", "main", "shingles")
    return first.unionByName(run(there.unionByName(ask)))


def group_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame, *, shingle: int, similarity: float, id_col: str, text_col: str, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Links (a, b) with the same components as all near enough pairs within a component of edges, on whole shingle sets.

    Only texts with an edge are read again. A group's texts meet in one task; those of over block_hashes hashes go in blocks, see large_group_links().
    """
    own = cut(nodes.select("node", "low.k1", "low.k2", "n_hashes").join(components(edges), "node"))
    size = own.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_hashes") / block_hashes)).cast("int").alias("n"))
    placed = cut(own.join(size, "root").select("k1", "k2", "node", "root", "n", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block")))
    texts = docs.select(*row_key(*id_and_text(id_col, text_col)), F.col(text_col).cast("string").alias("text"))
    sets = lambda some: matched(texts, some, ["k1", "k2"], "inner").select("root", "n", "block", "node", "text").mapInArrow(_met_sets(shingle), "root bigint, n int, block int, node bigint, shingles binary")
    small = sets(placed.where("n = 1")).select("root", "node", "shingles").repartition("root").sortWithinPartitions("root")
    links = small.mapInArrow(_grouped_links(similarity), "a bigint, b bigint")
    large = placed.where("n > 1")
    if large.isEmpty():
        return links
    # equal rows of a node are one
    return links.unionByName(large_group_links(cut(sets(large).dropDuplicates(["node"])), similarity, block_hashes))


def classes(docs: DataFrame, *, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, n, group_id, first): one row for each distinct id and text; n rows of docs have them. See groups()."""
    rows = cut(profiles(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("low")
    nodes = cut(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("x0", "x1", "codes", "n_hashes")), low))
    links = group_links(docs, nodes, candidates(nodes), shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    rooted = cut(nodes.select("node", "low").join(components(links), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("least"))
    of = rooted.join(least, "root").select("node", F.col("least.doc_id").alias("group_id"), F.col("least.k1").alias("f1"), F.col("least.k2").alias("f2"))
    each = rows.groupBy("k1", "k2", "doc_id", "node").agg(F.count("*").alias("n"))
    return each.join(of, "node").select("k1", "k2", "doc_id", "n", "group_id", ((F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).alias("first"))


def groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, first): one row for each row of docs.

    Texts are linked if at least similarity of their sets of word shingles is common, A-Z lower-cased; equal word
    sequences always are. group_id is the smallest doc_id that links reach, itself included; null where all of these
    are null. first: exactly one row of each group has it, one with the smallest id, null ids last; of equal ids, the one with the
    least hash of its text. Null and wordless texts are equal to each other and to no other. Fewer words than a shingle make one
    shingle. An empty table gives no row. Other columns are not read.
    """
    found = classes(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    each = found.select("doc_id", "group_id", "first", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
    return each.select("doc_id", "group_id", (F.col("first") & (F.col("i") == 1)).alias("first"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that groups() does not call first, with all its columns.

    Rows are known by hashes of id and text, so scans may split the table in any way. Of rows with equal id and text any one may stay.
    """
    found = classes(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    judged = cut(found.where("not first or n > 1").select("k1", "k2", "first"))
    return kept_once(docs, row_key(*id_and_text(id_col, text_col)), judged)
