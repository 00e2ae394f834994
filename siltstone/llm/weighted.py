"""Document fingerprints: consistent weighted sampling over word counts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of one row of the inner table: short enough code for the JIT compiler.
CHUNK = 4
#: Bits of a sample that a fingerprint keeps.
SAMPLE_BITS = 16
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Bits of a hash that pick r, ln c and beta of a term and sample; what is left under them names the term.
R_BITS, C_BITS, BETA_BITS = 12, 14, 38


@lru_cache(maxsize=4)
def gamma_quantiles(bits: int) -> np.ndarray:
    """2^bits equally likely values of a Gamma(2, 1) variate: its quantiles in the middle of equal steps, by bisection."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _sample(h: Column, r: Column, ln_c: Column, beta: Column, ln_count: Column) -> Column:
    """One term's bid for one sample: (ln a, hash of term and t) in a long, so that the least bid is a min().

    With r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of the term: t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1).
    """
    t = F.floor(ln_count / r + beta)
    high = F.shiftleft(F.floor((ln_c - r * (t - beta + 1) + 100) * float(1 << 30)), 26)
    low = h.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, 13)).bitwiseAND(F.lit((1 << 26) - 1))
    return high.bitwiseOR(low)


def samples(counts: DataFrame, keys: list[str], term: str, weights: list[str], n_samples: int, note: Column | None = None) -> DataFrame:
    """counts has a row for each of keys and term; -> keys, note, and for each weight an array of n_samples samples.

    note: rows where it is not null are no terms, but hand it on to the result.

    Equal weighted terms give equal samples, and a sample of two rows is equal with the probability of their
    generalised Jaccard similarity, sum of min over sum of max. Rows without weight have samples -1. Both
    groupings are by keys and so need no shuffle where rows are dealt by some of them.
    """
    if n_samples % CHUNK:
        raise ValueError(f"n_samples must be a multiple of {CHUNK}")
    js = range(CHUNK)
    keys, all_keys = [*keys, "__note"], keys
    counts = counts.withColumn("__note", F.lit(None).cast("string") if note is None else note)
    chunks = F.when(F.col("__note").isNull(), F.sequence(F.lit(0), F.lit(n_samples // CHUNK - 1))).otherwise(F.array(F.lit(-1)))
    # the logarithm of no weight is null, and so are its bids
    each = counts.select(*keys, F.xxhash64(term).alias("t"), *(F.log(F.when(F.col(w) > 0, F.col(w).cast("double"))).alias(w) for w in weights), F.explode(chunks).alias("chunk"))
    each = each.select(*keys, "chunk", *weights, *(F.xxhash64("t", F.col("chunk") * CHUNK + j).alias(f"h{j}") for j in js))
    r_table, c_table = _table(gamma_quantiles(R_BITS)), _table(np.log(gamma_quantiles(C_BITS)))
    drawn = []
    for j in js:
        h = F.col(f"h{j}")
        drawn += [
            F.get(r_table, F.shiftrightunsigned(h, 64 - R_BITS).cast("int")).alias(f"r{j}"),
            F.get(c_table, F.shiftrightunsigned(h, BETA_BITS).bitwiseAND(F.lit((1 << C_BITS) - 1)).cast("int")).alias(f"c{j}"),
            ((h.bitwiseAND(F.lit((1 << BETA_BITS) - 1)) + F.lit(0.5)) / float(1 << BETA_BITS)).alias(f"b{j}"),
        ]
    each = each.select(*keys, "chunk", *weights, *(f"h{j}" for j in js), *drawn)
    bid = lambda j, w: _sample(F.col(f"h{j}"), F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"b{j}"), F.col(w))
    best = each.groupBy(*keys, "chunk").agg(*(F.min(bid(j, w)).alias(f"{w}_{j}") for w in weights for j in js))
    mask = F.lit((1 << SAMPLE_BITS) - 1)
    kept = lambda w: F.array(*(F.coalesce(F.col(f"{w}_{j}").bitwiseAND(mask), F.lit(-1).cast("bigint")) for j in js))
    rows = best.select(*keys, F.struct("chunk", *(kept(w).alias(w) for w in weights)).alias("__s"))
    grouped = rows.groupBy(*all_keys).agg(F.max("__note").alias("note"), F.array_sort(F.filter(F.collect_list("__s"), lambda s: s["chunk"] >= 0)).alias("__s"))
    return grouped.select(*all_keys, "note", *(F.flatten(F.col(f"__s.{w}")).alias(w) for w in weights))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def text_of(sample: Column) -> Column:
    """Fingerprint as hex digits, a fixed number for each sample; without any word: all dots."""
    digits = SAMPLE_BITS // 4
    return F.array_join(F.transform(sample, lambda x: F.when(x < 0, F.lit("." * digits)).otherwise(F.lpad(F.lower(F.hex(x)), digits, "0"))), "")


def in_order(docs: DataFrame, *, id_col: str, text_col: str, rows_per_bucket: int, max_buckets: int) -> DataFrame:
    """(bucket, pos, ghost, doc_id, text, next_text): rows dealt by ranges of id, in order within each.

    The first rows of each range also stand, as ghosts, at the end of the range before (the very first: of the last),
    so that each row's successor is in its own range and texts are shuffled once. The borders are at most
    max_buckets ids.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = own.select(order.alias("o"))
    n = max(1, min(max_buckets, -(-ids.count() // rows_per_bucket)))
    dealt = ids.repartitionByRange(n, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"))
    bounds = sorted(r.o for r in dealt.select("o").collect())
    if not bounds:
        bounds = [0]
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(at: Column, s: Column) -> Column:
        to = at + s
        return F.when((to < len(bounds)) & (F.get(known, to) <= F.col("o")), to).otherwise(at)

    steps = F.array(*(F.lit(1 << k) for k in range((len(bounds) - 1).bit_length(), -1, -1)))
    placed = own.withColumn("o", order).withColumn("b", F.aggregate(steps, F.lit(0), halve))
    here = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    there = F.pmod(F.col("b") - 1, F.lit(len(bounds)))
    homes = F.when(F.get(known, "b") == F.col("o"), F.array(here(F.col("b"), False), here(there, True))).otherwise(F.array(here(F.col("b"), False)))
    rows = placed.select("o", "doc_id", "text", F.explode(homes).alias("h")).select("h.*", "o", "doc_id", "text")
    w = Window.partitionBy("bucket").orderBy("ghost", "o", F.length("text"), F.xxhash64("text"))
    return rows.select("bucket", F.row_number().over(w).alias("pos"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def fingerprints(docs: DataFrame, *, n_samples: int = 64, edit_share: int = 4, rows_per_bucket: int = 250, max_buckets: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like these and the next text's are.

    The edited text has its last floor(n_chars / edit_share) code points replaced by the first as many (or all) of the
    next row's by ascending id (after the last: the first). Terms are words between ASCII white space, weighted by their
    count. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row
    for each row of docs. Null text counts as empty; texts without words have a fingerprint of dots, wholly alike among
    themselves and unlike all others. Null ids come first in the order; rows with equal ids are ordered by length and hash of
    text. One row alone is its own next. Empty table: no row. Other columns are not read.
    """
    rows = in_order(docs, id_col=id_col, text_col=text_col, rows_per_bucket=rows_per_bucket, max_buckets=max_buckets)
    n = F.length("text")
    cut = F.floor(n / edit_share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "pos", "ghost", "doc_id", n.alias("n"), "text", edited.alias("edited"))
    # facts of the row itself travel as one more "word" that neither text counts
    facts = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n").cast("string"), F.col("ghost").cast("string"), F.sha2("edited", 256))
    texts = rows.select("bucket", "pos", F.explode(F.array(*(F.struct(F.lit(i).alias("which"), c.alias("text")) for i, c in enumerate((F.col("text"), F.col("edited"), facts))))).alias("x"))
    each = texts.select("bucket", "pos", F.col("x.which").alias("which"), F.explode(F.split("x.text", WORD_GAP)).alias("term"))
    once = lambda i: F.count_if((F.col("which") == i) & (F.col("term") != ""))
    counts = each.groupBy("bucket", "pos", (F.col("which") == 2).alias("fact"), "term").agg(once(0).alias("a"), once(1).alias("b"))
    rows = samples(counts, ["bucket", "pos"], "term", ["a", "b"], n_samples, F.when(F.col("fact"), F.col("term")))
    rows = rows.select("bucket", "pos", F.split("note", ",").alias("f"), "a", "b")
    w = Window.partitionBy("bucket").orderBy("pos")
    after = rows.withColumn("next_a", F.lead("a").over(w)).where(F.col("f")[2] == "false")
    return after.select(
        F.expr("try_cast(f[0] AS bigint)").alias("doc_id"),
        F.col("f")[1].cast("bigint").alias("n_chars"),
        F.col("f")[3].alias("edited_sha256"),
        text_of(F.col("a")).alias("fingerprint"),
        text_of(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("next_a")).alias("near_next"),
    )
