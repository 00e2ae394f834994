"""Quality classifier: importance resampling by hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, id_and_text, row_key, without
from siltstone.llm.symbols import blocks, strings, sums, trigrams

N_BUCKETS = 1 << 15
#: Languages with models of their own, the most frequent ones; others share one.
MAX_LANGS = 64
#: Most labelled rows that the target model is fitted on.
MAX_LABELLED = 20_000
#: Texts are dealt to so many folds by their hash; a fold's target model knows nothing of that fold's texts, so no labelled text or copy of it weighs itself.
FOLDS = 4
#: Trigrams of a text overlap and repeat, so a longer text's count as so many independent ones: log weights then lie within some units of a Gumbel variate.
INDEPENDENT = 100


def buckets(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def _langs(column: pa.Array, known: dict[str, int]) -> np.ndarray:
    return np.asarray([known.get(x, len(known)) for x in column.to_pylist()], np.int64)


def _own(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang, fold): nothing else of docs is read, and no other name can clash."""
    own, text = id_and_text(id_col, text_col)
    fold = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")
    return docs.select(own.alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.alias("fold"))


def gram_counts(docs: DataFrame, known: dict[str, int]) -> np.ndarray:
    """(FOLDS, languages + 1, N_BUCKETS) counts of hashed trigrams over all of docs (text, lang, fold); one dense table a task, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * (len(known) + 1) * N_BUCKETS, np.int64)
        for batch in batches:
            langs, at = batch.column(2).to_numpy() * (len(known) + 1) + _langs(batch.column(1), known), 0
            for some in blocks(iter(strings(batch.column(0)))):
                grams, lengths = trigrams(some)
                total += np.bincount(np.repeat(langs[at : at + len(some)], lengths) * N_BUCKETS + buckets(grams), minlength=total.size)
                at += len(some)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["b", "n"])

    t = docs.select("text", "lang", "fold").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FOLDS * (len(known) + 1) * N_BUCKETS)
    out[t["b"].to_numpy()] = t["n"].to_numpy()
    return out.reshape(FOLDS, -1, N_BUCKETS)


@dataclass(frozen=True)
class Weights:
    """Log ratio of target and raw probability by fold, language and bucket, and the labelled share of target rows."""

    known: dict[str, int]
    ratio: np.ndarray
    share: float

    def of(self, texts: list[str], models: np.ndarray) -> np.ndarray:
        """models: fold * (languages + 1) + language of each text."""
        grams, lengths = trigrams(texts)
        whole = sums(self.ratio.ravel()[np.repeat(models, lengths) * N_BUCKETS + buckets(grams)], lengths)
        return whole * np.minimum(1.0, INDEPENDENT / np.maximum(lengths, 1))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", max_labelled: int = MAX_LABELLED, smooth: float = 2.0) -> Weights:
    """Raw model: all texts. Target models: the texts that at most max_labelled labels (least hash of id) call good, but for those of the fold that the model is for.

    Each language has its own models, so that a language's share among the labels counts for nothing. To a bucket's count in the target, and
    to what would be expected there by the raw model, smooth is added: where few are expected, the ratio stays near one.
    """
    own = _own(docs, id_col, text_col, lang_col)
    many = own.groupBy("lang").count().where("lang is not null").orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    known = {r.lang: i for i, r in enumerate(many.collect())}
    told = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    some = cut(told.select("id", (F.col("label") > 0).alias("good")).orderBy(F.xxhash64("id"), "id", "good").limit(max_labelled))
    good = some.where("good").select("id").distinct()
    raw = gram_counts(own, known).sum(axis=0)
    counts = gram_counts(own.join(F.broadcast(good), "id", "left_semi"), known)
    target = counts.sum(axis=0) - counts
    p_raw = (raw + 1e-9) / (raw + 1e-9).sum(axis=1, keepdims=True)
    p_target = p_raw * (target + smooth) / (target.sum(axis=2, keepdims=True) * p_raw + smooth)
    ratio = np.log(p_target / p_target.sum(axis=2, keepdims=True) / p_raw)
    n, n_good = some.agg(F.count("*"), F.count_if("good")).first()
    return Weights(known, ratio, n_good / n if n else 1.0)


def gumbel(id_col: str, seed: int) -> Column:
    """A Gumbel variate of the row's id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) + F.lit(0.5)) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k_threshold(keys: DataFrame, col: str, k: int, *, bins: int = 1024, few: int = 20_000) -> float:
    """The k-th largest value of col: counts by bins, finer and finer, until at most few values are left to sort."""
    if k <= 0:
        return float("inf")
    low, high, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return float("-inf")
    above = 0
    while n > few and high > low:
        step = (high - low) / bins
        here = keys.where((F.col(col) >= low) & (F.col(col) <= high))
        by = {r.b: r for r in here.groupBy(F.least(F.floor((F.col(col) - low) / step), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(by, reverse=True):
            if above + by[b].n >= k:
                low, high, n = by[b].lo, by[b].hi, by[b].n
                break
            above += by[b].n
    if high == low:
        return low
    values = sorted((r[0] for r in keys.where((F.col(col) >= low) & (F.col(col) <= high)).select(col).collect()), reverse=True)
    return values[k - above - 1]


def _scored(docs: DataFrame, weights: Weights, id_col: str, text_col: str, lang_col: str, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _batch_weights(shared.value, batch.column(3), batch.column(4), batch.column(6))
            key = w + batch.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(w), pa.array(key)], names=["k1", "k2", "doc_id", "log_weight", "key"])

    own = _own(docs, id_col, text_col, lang_col).select(*_key("id", "text", "lang"), "id", "lang", "text", gumbel("id", seed).alias("g"), "fold")
    return own.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, log_weight double, key double")


def _key(id_col: str, text_col: str, lang_col: str) -> tuple[Column, Column]:
    return row_key(*id_and_text(id_col, text_col), F.col(lang_col).cast("string"))


def _batch_weights(weights: Weights, lang: pa.Array, text: pa.Array, fold: pa.Array) -> np.ndarray:
    models, at, out = fold.to_numpy() * (len(weights.known) + 1) + _langs(lang, weights.known), 0, [np.zeros(0)]
    for some in blocks(iter(strings(text))):
        out.append(weights.of(some, models[at : at + len(some)]))
        at += len(some)
    return np.concatenate(out)


def sample_size(scored: DataFrame, weights: Weights) -> int:
    """Expected number of target rows: the share of target rows times a row's weight is the chance that it is one, at most 1."""
    chance = F.exp(F.least(F.col("log_weight") + float(np.log(max(weights.share, 1e-9))), F.lit(0.0)))
    return round(scored.agg(F.sum(chance)).first()[0] or 0)


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(doc_id, log_weight, key, selected): one row for each row of docs.

    log_weight: sum over the text's hashed n-grams of the log ratio of target and raw probability, of a text of more than INDEPENDENT
    n-grams that many times their mean; by models that no text of its fold has taught. key adds a Gumbel
    variate of the id; the k largest keys are a sample without replacement by weight. k: as many as are expected to be
    target text (sample_size). Rows with a tied last key are all selected. Null or empty text has log weight 0.
    Null languages share a model; without any label all log weights are 0 and all rows are selected. Repeated rows have
    the same key. An empty table gives no row. Other columns are not read.
    """
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, label_col=label_col)
    scored = cut(_scored(docs, weights, id_col, text_col, lang_col, seed))
    k = sample_size(scored, weights) if k is None else k
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= top_k_threshold(scored, "key", k)).alias("selected"))


def selected(docs: DataFrame, labels: DataFrame, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that resample() selects, with all columns."""
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = cut(_scored(docs, weights, id_col, text_col, lang_col, seed))
    least = top_k_threshold(scored, "key", sample_size(scored, weights))
    gone = cut(scored.where(F.col("key") < least).select("k1", "k2").distinct())
    return without(docs, _key(id_col, text_col, lang_col), gone)
