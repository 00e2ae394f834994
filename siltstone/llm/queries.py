"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4).select("doc_id", "fingerprint", "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.weighted import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.rules import judge

    facts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"]
    return judge(table(spark, sf_dir, "documents")).select(facts)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.target import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, n_buckets=10_000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.bytepairs import decode, digest, encode

    return digest(decode(encode(table(spark, sf_dir, "documents"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.periodic import digest, periodic_runs, with_repeats

    return digest(periodic_runs(with_repeats(table(spark, sf_dir, "documents")), min_length=6, min_repeats=4))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_simhash_near_dedup,
    op2_license_scan,
    op3_secret_scan,
    op4_sentencepiece_sampling,
    op5_url_filter,
    op6_language_id,
    op7_quality_classifier,
    op8_document_fingerprints,
    op9_quality_rules,
    op10_best_fit_packing,
    op11_target_resampling,
    op12_byte_bpe,
    op13_periodic_runs,
    pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}
#: crc32 of a word's bytes, by the 256 remainders of its polynomial.
_BUCKETS = """rest AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    spelled AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
    bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM spelled, rest)"""

ORACLES: dict[str, str] = {
    "op11_target_resampling": f"""WITH texts AS (SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    listed AS (SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
    words AS (SELECT target, id, unnest(ws) AS w FROM listed),
    {_BUCKETS},
    counted AS (SELECT b, count_if(target = 0) AS s, count_if(target = 1) AS t FROM words JOIN bucket USING (w) GROUP BY b),
    gain AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
    weighed AS (SELECT id, sum(gain)::BIGINT AS weight FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE target = 0 GROUP BY id),
    scored AS (SELECT id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM listed LEFT JOIN weighed USING (id) WHERE target = 0),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
}
