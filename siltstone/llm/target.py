"""Target-distribution importance resampling: hashed word n-grams of documents weighed against those of a target."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut

#: Words that a task's dictionary holds before it starts anew, and bytes of text that are taken together.
MOST_WORDS, BLOCK = 1 << 20, 1 << 21
#: Words are what lies between ASCII characters other than digits and letters; A-Z count as a-z.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """Integers of distinct words, and each one's bytes."""

    def __init__(self):
        self.spelled: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.spelled)
        self.spelled.append(word)
        return i


class Features:
    """Buckets of the runs of 1 to longest consecutive words of texts. A run is a tuple of word ids; each distinct tuple of a block is spelled and hashed once."""

    def __init__(self, longest: int, n_buckets: int):
        self.longest, self.n_buckets = longest, n_buckets
        self.words, self.hashed = Words(), np.zeros(0, np.int64)

    def _word_buckets(self) -> np.ndarray:
        new = [zlib.crc32(w) % self.n_buckets for w in self.words.spelled[self.hashed.size :]]
        self.hashed = np.concatenate([self.hashed, np.asarray(new, np.int64)])
        return self.hashed

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text; and for each length of runs, their buckets and the texts they belong to, in order."""
        if len(self.words) > MOST_WORDS:
            self.words, self.hashed = Words(), np.zeros(0, np.int64)
        lists = [list(map(self.words.__getitem__, t.translate(_PLAIN).split())) for t in texts]
        size = np.asarray([len(x) for x in lists], np.int64)
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(texts)), size)
        out = [(self._word_buckets()[ids], owner)]
        tuples, run, at = [(i,) for i in range(len(self.words))] if self.longest > 1 else [], ids, np.arange(ids.size)
        for k in range(2, self.longest + 1):  # runs of k words: one of k - 1 and the word after it
            at = at[at + k - 1 < ids.size]
            stays = owner[at] == owner[np.minimum(at + k - 1, ids.size - 1)]
            run, at = run[: at.size][stays], at[stays]
            keys, which = np.unique(run * len(self.words) + ids[at + k - 1], return_inverse=True)
            tuples = [(*tuples[key // len(self.words)], key % len(self.words)) for key in keys.tolist()]
            buckets = np.asarray([zlib.crc32(b" ".join(map(self.words.spelled.__getitem__, t))) % self.n_buckets for t in tuples], np.int64)
            run = which
            out.append((buckets[which], owner[at]))
        return size, out


def _blocks(column: pa.Array) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for t in column:
        held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        n += len(held[-1])
        if n >= BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def bucket_counts(texts: DataFrame, *, longest: int, n_buckets: int) -> np.ndarray:
    """Features of all of texts (text) by bucket: each task sums its own, Spark the tasks'. n_buckets numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, n_buckets), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for some in _blocks(batch.column(0)):
                for buckets, _ in features.of(some)[1]:
                    total += np.bincount(buckets, minlength=n_buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["b", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """Of each bucket: floor(scale * log ratio of its smoothed share of target and of raw features)."""
    b, s_all, t_all = raw.size, int(raw.sum()), int(target.sum())
    return np.asarray([math.floor(scale * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(texts: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        features = Features(longest, gain.size)
        for batch in batches:
            at = 0
            for some in _blocks(batch.column(1)):
                n_words, found = features.of(some)
                n, weight = (np.zeros(len(some), np.int64) for _ in range(2))
                for buckets, owner in found:
                    ends = np.searchsorted(owner, np.arange(len(some) + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                    n += np.diff(ends)
                    weight += np.diff(sums[ends])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(some)], *map(pa.array, (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])
                at += len(some)

    return texts.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """rows, a checkpoint, with their place (1, 2, 3...) by order: sorted by ranges, then counted by partition, so that no task has them all."""
    by = cut(rows.orderBy(*order, F.monotonically_increasing_id()))  # ids of a checkpoint stand
    own = by.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes, before, offsets = {r["__part"]: r["n"] for r in own.groupBy("__part").agg(F.count("*").alias("n")).collect()}, 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    first = rows.sparkSession.createDataFrame(offsets, "__part int, __before bigint")
    return own.join(F.broadcast(first), "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, n_buckets: int = 10_000, percent: int = 10, least_words: int = 20, scale: int = 1000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), all bigint: one row for each row of docs.

    Features are the runs of 1 to longest consecutive words, repeats counted, by crc32 modulo n_buckets. A bucket's gain is the log ratio
    of its share among the features of target and of docs, one added to each count, times scale, floored; weight sums a row's gains.
    score adds a Gumbel variate of seed and id, also times scale and floored. Of the N rows of least_words words or more, the
    floor(percent * N / 100) of highest score are drawn: rank is their place (ties: smaller id, null ids last; of repeated rows any), else null.

    Null text: no words, weight 0, not drawn. A null id counts as an empty one in the variate. Empty docs: no row; empty target: all
    its shares are equal. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    goal = target.select(F.col(target_col).cast("string").alias("text"))
    gain = gains(bucket_counts(own, longest=longest, n_buckets=n_buckets), bucket_counts(goal, longest=longest, n_buckets=n_buckets), scale)
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 32))
    score = F.col("weight") + F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("bigint")
    scored = cut(_weighed(own, gain, longest).withColumn("score", score))
    fit = scored.where(F.col("n_words") >= least_words)
    n_drawn = percent * fit.count() // 100
    places = ranked(fit, F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = places.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
