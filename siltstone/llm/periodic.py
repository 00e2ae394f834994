"""Periodic run detection: branching tandem repeats of words from a suffix tree, merged into maximal runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are searched together; a longer text makes a block of its own.
BLOCK = 1 << 18
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def _sorted_suffixes(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of the block in order, and the ranks of all places by their next 1, 2, 4 ... words; ranks of equal ones are equal.

    first: rank of the word at each place, where equal words of different texts differ. Each round sorts only places whose
    next words another place shares; a rank is that of the first of its equals, so ranks of the others stand.
    """
    n = first.size
    order = np.argsort(first, kind="stable")
    key = first[order]
    heads = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, at, 0))
    ranks, step = [rank], 1
    slots = at
    while slots.size:
        alone = np.concatenate([heads[1:], [True]]) & heads
        slots, places = slots[~alone], order[slots[~alone]]
        if not slots.size:
            break
        ahead = places + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[places] * (n + 1) + second
        by = np.argsort(both, kind="stable")  # slots ascend by rank, so each group keeps its slots
        order[slots], both = places[by], both[by]
        heads = np.concatenate([[True], both[1:] != both[:-1]])
        rank = rank.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(heads, slots, 0))
        ranks.append(rank)
        step *= 2
    return order, ranks


def _shared(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at places a and b have in common at their start."""
    n, out = ranks[0].size, np.zeros(a.size, np.int64)
    live = np.arange(a.size)
    for k, rank in reversed(list(enumerate(ranks))):
        x, y = a[live] + out[live], b[live] + out[live]
        there = np.maximum(x, y) < n
        same = np.zeros(live.size, bool)
        same[there] = rank[x[there]] == rank[y[there]]
        out[live[same]] += 1 << k
    return out


def _lower_before(depth: np.ndarray, strict: bool) -> np.ndarray:
    """For each place k > 0 the last place before it of lower (or, if not strict, no greater) depth; place 0 has none lower."""
    at = np.arange(depth.size) - 1
    live = np.arange(1, depth.size)
    while live.size:
        p = at[live]
        go = (depth[p] >= depth[live]) if strict else (depth[p] > depth[live])
        live = live[go]
        at[live] = at[at[live]]  # all between that place and its own are no lower either
    return at


def _branching(ranks: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all tandem repeats that the word after them does not prolong.

    An inner node of the suffix tree is a border between neighbouring sorted suffixes, of the depth that these share; its two
    sides reach to the next borders of less depth. From each leaf of the smaller side, the leaf a depth before or after it is
    sought in the other side: two such leaves share just as many words as they lie apart.
    """
    n = order.size
    none = np.zeros(0, np.int64)
    first = ranks[0][order]
    near = np.flatnonzero(first[1:] == first[:-1]) + 1
    if not near.size:
        return none, none
    depth = np.zeros(n + 1, np.int64)  # of the border before each slot; borders 0 and n end all
    depth[near] = _shared(ranks, order[near - 1], order[near])
    # borders of some depth, each stretch of them between two of none
    spots = np.unique(np.concatenate([near, near - 1, near + 1, [0, n]]))
    spots = spots[spots <= n]
    d = depth[spots]
    low = spots[_lower_before(np.concatenate([[-1], d[1:]]), True)]
    high = spots[::-1][_lower_before(np.concatenate([[-1], d[::-1][1:]]), False)][::-1]
    here = np.flatnonzero(d > 0)
    mid, low, high, d = spots[here], low[here], high[here], d[here]  # sides: slots low..mid-1 and mid..high-1
    left = mid - low <= high - mid
    size = np.where(left, mid - low, high - mid)
    starts, periods = [], []
    slot_of = np.empty(n, np.int64)
    slot_of[order] = np.arange(n)
    ends = np.cumsum(size)
    for a in range(0, int(ends[-1]), 1 << 20):  # pairs of node and leaf, a bounded number at a time
        pair = np.arange(a, min(a + (1 << 20), int(ends[-1])))
        node = np.searchsorted(ends, pair, side="right")
        leaf = order[np.where(left[node], low[node], mid[node]) + pair - (ends[node] - size[node])]
        by, other_low, other_high = d[node], np.where(left, mid, low)[node], np.where(left, high, mid)[node]
        for shift in (1, -1):
            partner = leaf + shift * by
            ok = (partner >= 0) & (partner < n)
            slot = slot_of[np.where(ok, partner, 0)]
            ok &= (slot >= other_low) & (slot < other_high)
            starts.append(np.minimum(leaf, partner)[ok])
            periods.append(by[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _prolonged(word: np.ndarray, end: int, period: int, begin: int) -> int:
    """Where the stretch up to end begins in which words a period apart are equal; begin: where the text does."""
    at, step = end - period, 64
    while at > begin:
        a = max(begin, at - step)
        differ = np.flatnonzero(word[a:at] != word[a + period : at + period])
        if differ.size:
            return a + int(differ[-1]) + 1
        at, step = a, step * 2
    return begin


def runs_of(word: np.ndarray, begin: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of min_length words and min_repeats periods at least, in any order.

    word: ids, which texts of the block share; begin: where the texts begin, and the end of the last. Tandem repeats are
    rotated to the left as far as words allow; those that end at one place are taken by rising period, and a repeat that
    lies within a run of a smaller period has that run's rotations, so it is the same run.
    """
    n = word.size
    if not n:
        return []
    text = np.repeat(np.arange(begin.size - 1), np.diff(begin))
    order, ranks = _sorted_suffixes(text * (int(word.max()) + 1) + word)
    start, period = _branching(ranks, order)
    # the words before must go on the same way for as long as the least run needs; a few are looked at together
    need = np.maximum(min_length, min_repeats * period) - 2 * period
    for k in range(1, 9):
        on = need < k
        before = start - k
        same = before >= begin[text[start]]
        same[same] = word[before[same]] == word[(before + period)[same]]
        start, period, need = (x[on | same] for x in (start, period, need))
    by = np.lexsort((period, start + 2 * period))
    out: list[tuple[int, int, int]] = []
    last_end = least = -1
    for s, p in zip(start[by].tolist(), period[by].tolist(), strict=True):
        end = s + 2 * p
        if end == last_end and least <= s:
            continue  # lies within a run of a smaller period
        a = _prolonged(word, end, p, int(begin[text[s]]))
        least = min(a, least) if end == last_end else a
        last_end = end
        if end - a >= max(min_length, min_repeats * p):
            out.append((a, end - a, p))
    return out


def _found(texts: list[bytes], min_length: int, min_repeats: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text: its number of words, its runs by start and period, and the text without repeats."""
    words = [t.split() for t in texts]
    ids = _Ids()
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    flat = np.fromiter((i for w in words for i in map(ids.__getitem__, w)), np.int64, int(begin[-1]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, length, p in runs_of(flat, begin, min_length, min_repeats):
        k = int(np.searchsorted(begin, s, side="right")) - 1
        runs[k].append((s - int(begin[k]), length, p))
    out = []
    for w, r in zip(words, runs, strict=True):
        r.sort(key=lambda x: (x[0], x[2]))
        kept = w
        if r:
            stays = np.ones(len(w), bool)
            for s, length, p in r:
                stays[s + p : s + length] = False
            kept = [w[i] for i in np.flatnonzero(stays)]
        out.append((len(w), r, b" ".join(kept)))
    return out


def _blocks(column: pa.Array) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in column:
        held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= 6 * BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame, *, min_length: int = 6, min_repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): one row for each row of docs.

    Words are what lies between ASCII white space. A run is a stretch of words of smallest period p (words p apart are equal), of
    min_length words and min_repeats (2 or more) periods at least, that neither neighbouring word prolongs; runs come by start,
    then period. collapsed has the words that no run holds after its first p ones, joined by a space.

    Null and blank text: no words, no runs, collapsed empty. Null ids stay null; repeated rows are searched each. Empty table:
    no row. Other columns of docs are not read. A task holds a block of texts at a time, or one text if that is longer.
    """
    if min_repeats < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
        for batch in batches:
            at = 0
            for some in _blocks(batch.column(1)):
                found = _found(some, min_length, min_repeats)
                flat = [x for _, r, _ in found for x in r]
                ends = pa.array(np.cumsum([0, *(len(r) for _, r, _ in found)]), pa.int32())
                values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], fields=list(kind))
                collapsed = pa.array([c.decode("utf-8", "surrogatepass") for _, _, c in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(some)], pa.array([n for n, _, _ in found], pa.int64()), pa.ListArray.from_arrays(ends, values), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(some)

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def with_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), where the texts of a tenth of the ids end in a repeated stretch.

    h = crc32 of the decimal id, g = h div 10. If h % 10 = 0 and the text has n > 0 words, each word i >= a becomes word a + (i - a) % p
    for a = g % n, p = 1 + (n - a) div (3 + g % 8), and words are joined by a space. Null ids and other texts stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("bigint").cast("string"))
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    own = own.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.expr("1 + floor((size(w) - a) / (3 + floor(h / 10) % 8))"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of periodic_runs()'s rows: number of runs, the one of greatest length by period (ties: first start, then period), and checksums."""

    def told(r: Column) -> Column:
        return F.concat_ws(",", r["start"], r["length"], r["period"])

    lines = F.array_join(F.transform("runs", lambda r: F.concat(told(r), F.lit("\n"))), "")
    # exact: a / b > c / d as a * d > c * b; runs come by start and period, so the first of equals stays
    longest = F.aggregate("runs", F.col("runs")[0], lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = F.col("top")
    milli = F.expr("1000 * top.length div top.period")
    return out.select("doc_id", "n_runs", top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
