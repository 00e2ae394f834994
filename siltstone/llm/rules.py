"""Quality rules: counts of repetition and symbols, and perplexity bands of a modified Kneser-Ney model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, id_and_text, matched, row_key, without
from siltstone.llm.symbols import BITS, blocks, code_points, strings, sums, trigrams

WINDOW = 5
#: A language of fewer texts than this shares models and band with the others of that kind; a band of fewer good texts rejects none.
LEAST_ROWS = 50
#: Trigrams that are sent to all tasks. Models of no more are sent whole; of larger ones the most frequent grams are, and the rest is looked up by joins.
MAX_GRAMS = 1 << 24
#: Characters that any model reckons with.
ALPHABET = 1 << 16
SYMBOLS = "#*$%&|<>"
_LOW, _PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not keys.size:
        return np.full(wanted.size, other)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass(frozen=True)
class Model:
    """Trigram model of characters in sorted arrays: logs of what is kept, and of the mass that contexts leave to the rest."""

    grams: np.ndarray
    logp3: np.ndarray
    contexts: np.ndarray
    left3: np.ndarray
    pairs: np.ndarray
    logp2: np.ndarray
    firsts: np.ndarray
    left2: np.ndarray
    chars: np.ndarray
    logp1: np.ndarray
    other: float

    def pair_log_probability(self, pairs: np.ndarray) -> np.ndarray:
        out = _look_up(self.pairs, self.logp2, pairs, np.nan)
        rest = np.flatnonzero(np.isnan(out))
        some = pairs[rest]
        out[rest] = _look_up(self.firsts, self.left2, some >> BITS, 0.0) + _look_up(self.chars, self.logp1, some & _LOW, self.other)
        return out

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        out = _look_up(self.grams, self.logp3, grams, np.nan)
        rest = np.flatnonzero(np.isnan(out))
        some = grams[rest]
        out[rest] = _look_up(self.contexts, self.left3, some >> BITS, 0.0) + self.pair_log_probability(some & _PAIR)
        return out


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0..3+) from the counts of counts; 0.5, 1 and 1.5 at most where these don't tell."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def _level(context: np.ndarray, counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each kept gram in its context, and the share that each context leaves. totals: contexts and all their counts."""
    keys, total = totals
    at = np.searchsorted(keys, context)
    share = (counts - d[np.minimum(counts, 3)]) / total[at]
    return share, 1 - np.bincount(at, share, keys.size)


@dataclass(frozen=True)
class Counts:
    """What a model is made of, each sorted by key: kept grams with their counts, and contexts with the counts of all their grams."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    firsts: tuple[np.ndarray, np.ndarray]
    chars: tuple[np.ndarray, np.ndarray]
    n_pairs: int
    discounts: tuple[np.ndarray, np.ndarray, np.ndarray]


def kneser_ney(c: Counts) -> Model:
    """Interpolated modified Kneser-Ney: trigrams by their counts, pairs and characters by how many different ones stand before them."""
    d3, d2, d1 = c.discounts
    log = lambda x: np.log(np.maximum(x, 1e-12))
    chars, types = c.chars
    p1 = (types - d1[np.minimum(types, 3)]) / max(c.n_pairs, 1)
    other = (1 - p1.sum()) / ALPHABET
    p1 = p1 + other
    p2, left2 = _level(c.pairs[0] >> BITS, c.pairs[1], c.firsts, d2)
    p2 = p2 + left2[np.searchsorted(c.firsts[0], c.pairs[0] >> BITS)] * _look_up(chars, p1, c.pairs[0] & _LOW, other)
    low = Model(*[np.zeros(0, np.int64)] * 4, c.pairs[0], log(p2), c.firsts[0], log(left2), chars, log(p1), float(np.log(other)))
    p3, left3 = _level(c.grams[0] >> BITS, c.grams[1], c.contexts, d3)
    p3 = p3 + left3[np.searchsorted(c.contexts[0], c.grams[0] >> BITS)] * np.exp(low.pair_log_probability(c.grams[0] & _PAIR))
    return Model(c.grams[0], log(p3), c.contexts[0], log(left3), low.pairs, low.logp2, low.firsts, low.left2, low.chars, low.logp1, low.other)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point below 65,536: 1 upper-case letter, 2 lower-case letter, 3 symbol, 0 other."""
    kinds = np.array([chr(i).isupper() + 2 * chr(i).islower() for i in range(1 << 16)], np.int8)
    kinds[[ord(s) for s in SYMBOLS]] = 3
    return kinds


def teaches(text: str) -> bool:
    """Whether models learn from a text: at most 2 % symbols, and at most a quarter of its letters upper-case."""
    c = code_points(text)
    n = np.bincount(_kinds()[c[c < 1 << 16]], minlength=4)
    return bool(c.size) and 50 * n[3] <= c.size and 3 * n[1] <= n[2] + (n[1] + n[2] == 0)


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def named_languages(docs: DataFrame, lang_col: str) -> list[str]:
    """Languages of at least LEAST_ROWS texts."""
    lang = F.col(lang_col).cast("string").alias("lang")
    return sorted(r.lang for r in docs.groupBy(lang).agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_ROWS) & F.col("lang").isNotNull()).select("lang").collect())


def trigram_counts(docs: DataFrame, named: list[str], text_col: str, lang_col: str) -> DataFrame:
    """(lang, fold, gram, n) over all texts that teach: summed block by block, then in Spark. lang is empty for all that aren't named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = set(named), {}, {}

        def counted(key: tuple[str, int]) -> pa.RecordBatch:
            grams, n = np.unique(trigrams(held.pop(key))[0], return_counts=True)
            size[key] = 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * grams.size, pa.string()), pa.array(np.full(grams.size, key[1], np.int32)), pa.array(grams), pa.array(n)], names=["lang", "fold", "gram", "n"])

        for b in batches:
            for text, lang, fold in zip(strings(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if teaches(text):
                    key = (lang if lang in known else "", fold)
                    held.setdefault(key, []).append(text)
                    size[key] = size.get(key, 0) + len(text)
                    if size[key] >= 1 << 21:
                        yield counted(key)
        for key in list(held):
            yield counted(key)

    text = F.col(text_col).cast("string")
    own = docs.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), fold_of(text).alias("fold"))
    return own.mapInArrow(run, "lang string, fold int, gram bigint, n bigint").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def model_counts(grams: DataFrame, max_grams: int = MAX_GRAMS) -> dict[tuple[str, int], Counts]:
    """Counts by language and fold from trigram_counts().

    Counts, types and counts of counts are over all grams. Collected are those that make up a share of their language's characters,
    max_grams shared out among languages and folds: so there are at most max_grams of each kind, however large the corpus.
    """
    grams, by = cut(grams), ["lang", "fold"]
    few = lambda c: [F.count_if(F.col(c) == k).alias(f"n{k}") for k in range(1, 5)]
    stats = {(r.lang, r.fold): r for r in grams.groupBy(*by).agg(F.sum("n").alias("all"), *few("n")).collect()}
    if not stats:
        return {}
    least = grams.sparkSession.createDataFrame([(*k, r["all"] * len(stats)) for k, r in stats.items()], "lang string, fold int, least bigint")
    pairs = cut(grams.groupBy(*by, F.col("gram").bitwiseAND(F.lit(_PAIR)).alias("key")).agg(F.count("*").alias("types"), F.sum("n").alias("n")))
    chars = pairs.groupBy(*by, F.col("key").bitwiseAND(F.lit(_LOW)).alias("key")).agg(F.count("*").alias("types"), F.sum("n").alias("n"))
    of = lambda rows: {(r.lang, r.fold): r for r in rows.groupBy(*by).agg(F.sum("types").alias("all"), *few("types")).collect()}
    stats2, stats1 = of(pairs), of(chars)

    def collected(rows: DataFrame, value: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        kept = rows.join(F.broadcast(least), by).where(F.col("n") >= F.col("least") / max_grams)
        t = kept.select("lang", "fold", "key", F.col(value).alias("value")).toArrow()
        lang, fold, key, value = (t.column(i).to_numpy() for i in range(4))
        found = {}
        for k in stats:
            own = np.flatnonzero((lang == k[0]) & (fold == k[1]))
            own = own[np.argsort(key[own])]
            found[k] = key[own].astype(np.int64), value[own].astype(np.int64)
        return found

    kinds = [
        collected(grams.withColumnRenamed("gram", "key"), "n"),
        collected(grams.groupBy(*by, F.shiftright("gram", BITS).alias("key")).agg(F.sum("n").alias("n")), "n"),
        collected(pairs, "types"),
        collected(pairs.groupBy(*by, F.shiftright("key", BITS).alias("key")).agg(F.sum("types").alias("types"), F.sum("n").alias("n")), "types"),
        collected(chars, "types"),
    ]
    d = lambda r: _discounts(r.n1, r.n2, r.n3, r.n4)
    return {k: Counts(*(x[k] for x in kinds), stats1[k]["all"], (d(stats[k]), d(stats2[k]), d(stats1[k]))) for k in stats}


def _all_counts(grams: DataFrame) -> tuple[DataFrame, ...]:
    """Tables of all grams (lang, fold, gram, n), nothing left out: pairs, characters, and what discounts leave of contexts and firsts; and a row a model of its discounts."""
    by = ["lang", "fold"]
    pairs = cut(grams.groupBy(*by, F.col("gram").bitwiseAND(F.lit(_PAIR)).alias("pair")).agg(F.count("*").alias("types")))
    chars = cut(pairs.groupBy(*by, F.col("pair").bitwiseAND(F.lit(_LOW)).alias("char")).agg(F.count("*").alias("types")))
    of = lambda rows, c: {(r.lang, r.fold): r for r in rows.groupBy(*by).agg(F.sum(c).alias("all"), *(F.count_if(F.col(c) == k).alias(f"n{k}") for k in range(1, 5))).collect()}
    s3, s2, s1 = of(grams, "n"), of(pairs, "types"), of(chars, "types")
    d = lambda r: _discounts(r.n1, r.n2, r.n3, r.n4).tolist()
    facts = grams.sparkSession.createDataFrame([(*k, d(s3[k]), d(s2[k]), d(s1[k]), s1[k]["all"]) for k in s3], "lang string, fold int, d3 array<double>, d2 array<double>, d1 array<double>, n_pairs bigint")

    def left(rows: DataFrame, key: Column, name: str, value: str, discounts: str) -> DataFrame:
        own = rows.join(F.broadcast(facts), by).withColumn("taken", F.col(discounts)[F.least(F.col(value), F.lit(3)).cast("int")])
        sums = own.groupBy(*by, key.alias(name)).agg(F.sum("taken").alias("taken"), F.sum(value).alias(f"{name}_all"))
        return sums.select(*by, name, f"{name}_all", (F.col("taken") / F.col(f"{name}_all")).alias(f"{name}_left"))

    told = chars.join(F.broadcast(facts), by).select(*by, "char", ((F.col("types") - F.col("d1")[F.least("types", F.lit(3)).cast("int")]) / F.col("n_pairs")).alias("p1"))
    facts = facts.join(F.broadcast(told.groupBy(*by).agg(((1 - F.sum("p1")) / ALPHABET).alias("other"))), by)
    return pairs, told, left(grams, F.shiftright("gram", BITS), "context", "n", "d3"), left(pairs, F.shiftright("pair", BITS), "first", "types", "d2"), facts


def log_probabilities(grams: DataFrame, tables: tuple[DataFrame, ...], wanted: DataFrame) -> DataFrame:
    """(lang, fold, gram, logp) of distinct wanted (lang, fold, gram), seen or not, as kneser_ney() of all counts has them, by joins."""
    pairs, chars, contexts, firsts, facts = tables
    by, none, whole = ["lang", "fold"], F.lit(0.0), F.lit(1.0)
    low = lambda c, mask: F.col(c).bitwiseAND(F.lit(mask))
    keyed = wanted.select(*by, "gram", F.shiftright("gram", BITS).alias("context"), low("gram", _PAIR).alias("pair"), F.shiftright(low("gram", _PAIR), BITS).alias("first"), low("gram", _LOW).alias("char"))
    met = keyed.join(grams, [*by, "gram"], "left").join(contexts, [*by, "context"], "left").join(pairs, [*by, "pair"], "left").join(firsts, [*by, "first"], "left").join(chars, [*by, "char"], "left").join(F.broadcast(facts), by)
    share = lambda n, d, total: F.coalesce((F.col(n) - F.col(d)[F.least(F.col(n), F.lit(3)).cast("int")]) / F.col(total), none)
    p1 = F.coalesce("p1", none) + F.col("other")
    p2 = share("types", "d2", "first_all") + F.coalesce("first_left", whole) * p1
    p3 = share("n", "d3", "context_all") + F.coalesce("context_left", whole) * p2
    return met.select(*by, "gram", F.log(F.greatest(p3, F.lit(1e-12))).alias("logp"))


@dataclass(frozen=True)
class Head:
    """The most frequent grams of a model that is too large to be sent whole; nan for those that are looked up by joins."""

    grams: np.ndarray
    logp: np.ndarray

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        return _look_up(self.grams, self.logp, grams, np.nan)


@dataclass(frozen=True)
class Models:
    """Models by language and fold; a text is measured under the model of the fold that it isn't in."""

    named: list[str]
    of: dict[tuple[str, int], Model | Head]

    def language(self, lang: str | None) -> str:
        return lang if lang in self.named else ""

    def pick(self, lang: str, fold: int) -> Model | None:
        return self.of.get((lang, 1 - fold)) or self.of.get((lang, fold))


def _heads(grams: DataFrame, tables: tuple[DataFrame, ...], max_grams: int) -> dict[tuple[str, int], Head]:
    all_of = {(r.lang, r.fold): r["all"] for r in grams.groupBy("lang", "fold").agg(F.sum("n").alias("all")).collect()}
    least = grams.sparkSession.createDataFrame([(*k, n * len(all_of) / max_grams) for k, n in all_of.items()], "lang string, fold int, least double")
    often = grams.join(F.broadcast(least), ["lang", "fold"]).where("n >= least").select("lang", "fold", "gram")
    t = log_probabilities(grams, tables, often).toArrow()  # at most max_grams rows
    lang, fold, gram, logp = (t.column(i).to_numpy() for i in range(4))
    found = {}
    for k in all_of:
        own = np.flatnonzero((lang == k[0]) & (fold == k[1]))
        own = own[np.argsort(gram[own])]
        found[k] = Head(gram[own].astype(np.int64), logp[own].astype(np.float64))
    return found


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_grams: int = MAX_GRAMS) -> tuple[Models, DataFrame | None, tuple[DataFrame, ...]]:
    """Models, and the counts that the rest is looked up in where they are too many to be sent."""
    named = named_languages(docs, lang_col)
    grams = cut(trigram_counts(docs, named, text_col, lang_col))
    if grams.count() <= max_grams:
        return Models(named, {k: kneser_ney(c) for k, c in model_counts(grams, float("inf")).items()}), None, ()
    tables = tuple(cut(x) for x in _all_counts(grams))
    return Models(named, _heads(grams, tables, max_grams)), grams, tables


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    _, where, times = np.unique(mixed, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[where] > 1).tolist()
    if not maybe:
        return 0
    exact = [tuple(words[i : i + WINDOW]) for i in maybe]
    seen = Counter(exact)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(maybe, exact, strict=True):
        if seen[w] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return 0, 0, 0, 0, 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


#: Grams that a text's model in the tasks does not hold, and that model's fold.
REST = "rest array<bigint>, model int"
FACTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, log_perplexity double"


def _measure(texts: list[str], keys: list[tuple[str, int]], models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    facts = np.asarray([counts_of(t) for t in texts], np.int64).reshape(-1, 5)
    lengths, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    rest, folds = [np.zeros(0, np.int64)] * len(texts), np.zeros(len(texts), np.int32)
    for key in set(keys):
        own, model = [i for i, k in enumerate(keys) if k == key], models.pick(*key)
        grams, n = trigrams([texts[i] for i in own])
        lengths[own] = n
        if model:
            logp = model.log_probability(grams)
            if isinstance(model, Head):
                folds[own] = 1 - key[1] if (key[0], 1 - key[1]) in models.of else key[1]
                for i, some in zip(own, np.split(np.where(np.isnan(logp), grams, -1), np.cumsum(n)[:-1]), strict=True):
                    rest[i] = some[some >= 0]
                logp = np.nan_to_num(logp, nan=0.0)
            logs[own] = -sums(logp, n) / np.maximum(n, 1)
    return facts, lengths, logs, rest, folds


def measured(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(k1, k2, doc_id, lang), FACTS and REST: a row for each row of docs; lang is the models'. log_perplexity is by character, in nats; 0 for an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            langs = [models.language(x) for x in batch.column(3).to_pylist()]
            keys, at, parts = list(zip(langs, batch.column(4).to_pylist(), strict=True)), 0, []
            for some in blocks(iter(strings(batch.column(5)))):
                parts.append(_measure(some, keys[at : at + len(some)], models))
                at += len(some)
            if parts:
                facts, lengths, logs, folds = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
                rest = [x for p in parts for x in p[3]]
                columns = [*(batch.column(i) for i in range(3)), pa.array(langs, pa.string()), *(pa.array(facts[:, i]) for i in range(5)), pa.array(lengths), pa.array(logs), pa.array(rest, pa.list_(pa.int64())), pa.array(folds)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "lang", *(x.split()[0] for x in f"{FACTS}, {REST}".split(", "))])

    own, text = id_and_text(id_col, text_col)
    lang = F.col(lang_col).cast("string")
    rows = docs.select(*row_key(own, text, lang), own.alias("doc_id"), lang.alias("lang"), fold_of(text).alias("fold"), text.alias("text"))
    return rows.mapInArrow(run, f"k1 bigint, k2 bigint, doc_id bigint, lang string, {FACTS}, {REST}")


def with_rest(rows: DataFrame, grams: DataFrame, tables: tuple[DataFrame, ...]) -> DataFrame:
    """rows of measured(), a checkpoint with a number `row`, with what their other grams add to log_perplexity. Each distinct gram is looked up once."""
    each = rows.select("row", "lang", F.col("model").alias("fold"), F.explode("rest").alias("gram")).groupBy("row", "lang", "fold", "gram").agg(F.count("*").alias("times"))
    scored = cut(log_probabilities(grams, tables, each.select("lang", "fold", "gram").distinct()))
    added = matched(each, scored, ["lang", "fold", "gram"], "inner").groupBy("row").agg(F.sum(F.col("logp") * F.col("times")).alias("added"))
    less = F.coalesce(F.col("added") / F.greatest("n_grams", F.lit(1)), F.lit(0.0))
    return rows.join(added, "row", "left").withColumn("log_perplexity", F.col("log_perplexity") - less).drop("added")


def in_band(rows: DataFrame, *, wide: float, short: float) -> Column:
    """Whether a row of measured() lies within its language's band.

    The middle of a band is the median of all rows that pass the base rules; wide spreads between quartiles to either side are inside, and more for
    short texts (short over the root of the length). A language with fewer than LEAST_ROWS such rows has no band.
    """
    q = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 2000).alias("q")
    good = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    of = {r.lang: r.q for r in good.groupBy("lang").agg(q, F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).collect()}
    if not of:
        return F.lit(True)
    band = F.create_map(*(F.lit(x) for k, (low, mid, high) in of.items() for x in (k, [float(mid), float(max((high - low) / 1.349, 1e-3))])))[F.col("lang")]
    return F.coalesce(F.abs(F.col("log_perplexity") - band[0]) <= wide * band[1] + short / F.sqrt(F.greatest("n_grams", F.lit(1))), F.lit(True))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", wide: float = 12.0, short: float = 4.0, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Counts, perplexity and verdict of every text, one row for each row of docs.

    Three passes: trigram counts make models by language; all texts are measured; all measures make the bands. Texts fall in two folds by
    their hash and are measured under the other fold's model, so neither a text nor its copies teach its own measure; and
    texts of many symbols or capitals teach nothing (teaches). Characters, not words: a word model's size has no bound. Returns k1, k2, doc_id,
    lang (empty if null or rare), FACTS, base_failed, kept. Null text counts as empty and fails. Null and rare languages share models and band.
    Repeated rows each get a row and count each. An empty table gives no row. Other columns are not read.
    """
    models, grams, tables = fit(docs, text_col, lang_col, max_grams)
    rows = cut(measured(docs, models, id_col=id_col, text_col=text_col, lang_col=lang_col).withColumn("row", F.monotonically_increasing_id()))
    rows = (rows if grams is None else cut(with_rest(rows, grams, tables))).drop("row", "rest", "model")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.select("*", failed.alias("base_failed"), (~failed & in_band(rows, wide=wide, short=short)).alias("kept"))


def kept(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that judge() keeps, with all columns."""
    gone = cut(judge(docs, id_col=id_col, text_col=text_col, lang_col=lang_col).where("not kept").select("k1", "k2").distinct())
    return without(docs, row_key(*id_and_text(id_col, text_col), F.col(lang_col).cast("string")), gone)
