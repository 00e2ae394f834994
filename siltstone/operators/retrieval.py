"""Inverted index, BM25 and vector ranking."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, tokenize

K1, B = 1.2, 0.75


#: Documents whose words are counted at once.
SLICE = 1024


def term_counts(docs: DataFrame, own: list[str], text: Column) -> DataFrame:
    """own, dl, terms and tfs of each row: functions.text.tokenize()'s words, counted where the text is. Null text has no words."""
    kept = docs.select(*own)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "dl bigint, terms array<string>, tfs array<bigint>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop = re.compile(r"[a-z0-9]{2,}"), set(STOPWORDS)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                *rest, texts = batch.slice(at, SLICE).columns
                each = [Counter(w for w in words.findall(t.as_py() or "") if w not in stop) for t in texts]
                told = [pa.array([sum(c.values()) for c in each], pa.int64()), pa.array([list(c) for c in each], pa.list_(pa.string())), pa.array([list(c.values()) for c in each], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rest, *told], names=[*own, "dl", "terms", "tfs"])

    return docs.select(*own, F.lower(text).alias("__low")).mapInArrow(count, schema)


def exploded_terms(counted: DataFrame, id_col: str) -> DataFrame:
    """(id, term, dl, tf) of term_counts()."""
    each = counted.select(id_col, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return each.select(id_col, F.col("x.terms").alias("term"), "dl", F.col("x.tfs").alias("tf"))


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, dl). Terms are counted in their texts before anything else meets them, so a frequent term is one row a document."""
    return exploded_terms(term_counts(docs, [id_col], text), id_col).groupBy(id_col, "term", "dl").agg(F.sum("tf").alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _ranked(tf: DataFrame, df: DataFrame, corpus: DataFrame, terms: DataFrame, id_col: str, k: int) -> DataFrame:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    known = terms.join(df, "term").crossJoin(F.broadcast(corpus))  # corpus is one row
    scored = tf.join(known, "term").groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best for each query; queries (query_id, term), a repeated term counts again.

    Only query terms' postings are kept; N and the mean length come from one pass over the lengths. Ties go to the
    smaller id. Scores are rounded to 6 digits before they are ordered. For many searches, write_text_index() once.
    """
    terms = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    words = docs.select(id_col, tokenize(text).alias("words"))
    own = words.select(id_col, F.size("words").cast("bigint").alias("dl"), "words")
    each = own.select(id_col, "dl", F.explode("words").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = each.groupBy(id_col, "term", "dl").agg(F.count("*").alias("tf"))
    return _ranked(tf, tf.groupBy("term").agg(F.count("*").alias("df")), _corpus(own), terms, id_col, k)


#: Version of the index folders; others are refused.
INDEX_VERSION = 1
#: Folders of an index by a hash of the term.
SHELVES = 64


def write_text_index(docs: DataFrame, folder: str, id_col: str, text: Column) -> None:
    """Postings, sorted by term within shelves of a hash of it, term statistics, corpus facts and version, in folder."""
    index = postings(docs, id_col, text).withColumn("shelf", F.pmod(F.xxhash64("term"), F.lit(SHELVES)).cast("int"))
    index.repartitionByRange("shelf", "term", id_col).sortWithinPartitions("shelf", "term", id_col).write.mode("overwrite").partitionBy("shelf").parquet(f"{folder}/postings")
    done = docs.sparkSession.read.parquet(f"{folder}/postings")
    done.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    facts = _corpus(docs.select(F.size(tokenize(text)).cast("bigint").alias("dl")))
    facts.select("*", F.lit(INDEX_VERSION).alias("version"), F.lit(id_col).alias("id_col")).write.mode("overwrite").parquet(f"{folder}/corpus")


def _checked(facts: DataFrame) -> DataFrame:
    wrong = F.concat(F.lit("index version "), F.col("version").cast("string"), F.lit(f" is not {INDEX_VERSION}"))
    return facts.where(F.when(F.col("version") == INDEX_VERSION, True).otherwise(F.raise_error(wrong).cast("boolean")))


def bm25_indexed(folder: str, queries: DataFrame, k: int) -> DataFrame:
    """bm25() from write_text_index(): reads only the shelves of the queries' terms and no text. The terms of the queries are bounded by the caller."""
    spark = queries.sparkSession
    facts = _checked(spark.read.parquet(f"{folder}/corpus"))
    id_col = facts.first().id_col
    terms = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = sorted({r.term for r in terms.select("term").distinct().collect()})
    shelves = [r.s for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(SHELVES)).cast("int").alias("s")).distinct().collect()]
    tf = spark.read.parquet(f"{folder}/postings").where(F.col("shelf").isin(shelves) & F.col("term").isin(wanted)).drop("shelf")
    df = spark.read.parquet(f"{folder}/terms").where(F.col("term").isin(wanted)).select("term", "df")
    return _ranked(tf, df, facts.select("n", "avgdl"), terms, id_col, k)


def chunk_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """chunks (chunk_id, ...) with vector from embeddings (chunk_id, vector, ordinal): the last of a chunk; chunks without one are left out."""
    last = embeddings.groupBy("chunk_id").agg(F.max_by("vector", "ordinal").alias("vector"))
    return chunks.join(last, "chunk_id")


def write_vector_index(chunks: DataFrame, embeddings: DataFrame, folder: str) -> None:
    chunk_vectors(chunks, embeddings).withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(f"{folder}/vectors")


def read_vector_index(spark, folder: str) -> DataFrame:
    """Chunks and vectors of write_vector_index(); raises for another version. token_count is made anew from the content."""
    from siltstone.functions.text import estimate_tokens

    rows = _checked(spark.read.parquet(f"{folder}/vectors")).drop("version")
    return rows.withColumn("token_count", estimate_tokens(F.col("content"))) if "content" in rows.columns else rows


def build_indexes(chunks: DataFrame, folder: str) -> None:
    """Text index and hashed bag-of-words vectors of chunks (chunk_id, heading, content), vectors over heading: content."""
    told = F.when(F.coalesce("heading", F.lit("")) != "", F.concat_ws(": ", "heading", "content")).otherwise(F.col("content"))
    write_text_index(chunks, folder, "chunk_id", F.col("content"))
    vectors = bow_vectors(chunks.select("chunk_id", told.alias("t")), "chunk_id", F.col("t"))
    full = chunks.join(vectors, "chunk_id", "left").select("chunk_id", F.coalesce("vector", F.array_repeat(F.lit(0.0), 256)).alias("vector"), F.lit(0).alias("ordinal"))
    write_vector_index(chunks, full, folder)


class _Buckets(dict):
    """Buckets of words (bytes), as functions.text.word_bucket() has them; short words are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        h = 0
        for c in word:
            h = (h * 31 + c) & 0xFFFFFFFF
        out = abs(h - (1 << 32) if h >> 31 else h) % self.buckets
        if len(word) <= 32 and len(self) < 1 << 20:
            self[word] = out
        return out


def _lists(groups: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values, ordered by their groups 0 to n - 1, as a list a group."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(n + 1)), pa.int32()), pa.array(values))


def _bow(docs: DataFrame, id_col: str, text: Column, buckets: int) -> DataFrame:
    """(id, b, n): the buckets of an id's words in order, and their counts. Words are counted where the texts are; only the counts are shuffled, and texts of one id summed."""
    names, kind = [id_col, "b", "n"], docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, b array<bigint>, n array<bigint>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = _Buckets(buckets), re.compile(rb"[a-z0-9_]+")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                each = [[known[w] for w in words.findall(t)] if t else [] for t in some.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
                key, n = np.unique(rows * buckets + np.fromiter((b for x in each for b in x), np.int64, rows.size), return_counts=True)
                full = np.unique(key // buckets)
                own = np.searchsorted(full, key // buckets)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(full)), _lists(own, key % buckets, full.size), _lists(own, n.astype(np.int64), full.size)], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows of one id, which follow each other; the last id's wait for the next batch."""

        def told(ids: pa.Array, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, _lists(key // buckets, key % buckets, len(ids)), _lists(key // buckets, n, len(ids))], names=names)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            ids = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            owner = np.asarray(ids.indices)  # first come, so in order
            b, n = (table.column(i).combine_chunks() for i in (1, 2))
            key = np.repeat(owner, np.asarray(b.value_lengths()).astype(np.int64)).astype(np.int64) * buckets + np.asarray(b.flatten())
            keys, where = np.unique(key, return_inverse=True)
            sums = np.zeros(keys.size, np.int64)
            np.add.at(sums, where, np.asarray(n.flatten()))
            out = told(ids.dictionary, keys, sums)
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    counted = docs.select(id_col, F.lower(text).cast("binary").alias("t")).mapInArrow(count, schema)
    return counted.repartition(id_col).sortWithinPartitions(id_col).mapInArrow(total, schema)


def _norm(n: Column) -> Column:
    return F.sqrt(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x * x))


def bow_counts(docs: DataFrame, id_col: str, text: Column, buckets: int = 256) -> DataFrame:
    """(id, bucket, n, weight): hashed bag of words, weight with unit length; texts without words have no row."""
    each = _bow(docs, id_col, text, buckets).withColumn("norm", _norm(F.col("n"))).select(id_col, "norm", F.explode(F.arrays_zip("b", "n")).alias("x"))
    return each.select(id_col, F.col("x.b").cast("int").alias("bucket"), F.col("x.n").alias("n"), (F.col("x.n") / F.col("norm")).alias("weight"))


def bow_vectors(docs: DataFrame, id_col: str, text: Column, buckets: int = 256) -> DataFrame:
    """(id, vector): the weights of bow_counts() as dense arrays."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, b, n = batch.slice(at, SLICE).columns
                v = np.zeros((len(ids), buckets))
                v[np.repeat(np.arange(len(ids)), np.asarray(b.value_lengths())), np.asarray(b.flatten())] = np.asarray(n.flatten())
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * buckets, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([ids, flat], names=[id_col, "vector"])

    return _bow(docs, id_col, text, buckets).mapInArrow(dense, f"`{id_col}` {kind}, vector array<double>")


#: Most queries that a task holds, rows that it meets them with, and similarities that it makes at once.
QUERIES, ROWS, SCORES = 1 << 14, 1 << 16, 1 << 22


class _Best:
    """The k best rows of each query so far, by score and smaller id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits = k, digits
        self.ids, self.least, self.sized = np.empty(0, np.int64), np.empty(0), {}
        self.top = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))  # query's place, score, id; ordered

    @staticmethod
    def _sized(ids: np.ndarray, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors by number of elements."""
        size = np.asarray(vectors.value_lengths()).astype(np.int64)
        flat, ends = np.asarray(vectors.flatten()), np.cumsum(size)
        for one in np.unique(size):
            at = np.flatnonzero(size == one)
            v = flat[(ends[at] - one)[:, None] + np.arange(one)]
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield at, np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def ask(self, ids: np.ndarray, vectors: pa.ListArray, least: np.ndarray) -> None:
        """Adds queries, of which scores below least don't count."""
        for at, v in self._sized(ids, vectors):
            places, known = self.sized.get(v.shape[1], (np.empty(0, np.int64), np.empty((0, v.shape[1]))))
            self.sized[v.shape[1]] = np.concatenate([places, self.ids.size + at]), np.concatenate([known, v])
        self.ids, self.least = np.concatenate([self.ids, ids]), np.concatenate([self.least, least])

    def _floors(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the k-th best of each query; what any row of least passes where there are fewer."""
        q, score, at = self.top
        last = np.flatnonzero(np.arange(q.size) - np.searchsorted(q, q) == self.k - 1)
        floor, least = self.least.copy(), np.full(self.ids.size, np.iinfo(np.int64).max)
        floor[q[last]], least[q[last]] = score[last], at[last]
        return floor, least

    def meet(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        for at, v in self._sized(ids, vectors):
            for size, (places, known) in self.sized.items():
                step = at.size if size != v.shape[1] else max(1, SCORES // places.size)
                for i in range(0, at.size, step):
                    self._meet(places, known, ids[at[i : i + step]], v[i : i + step])

    def _meet(self, places: np.ndarray, known: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if known.shape[1] != v.shape[1] or not v.shape[1]:  # all score 0
            some = np.sort(ids)[: self.k]
            q, at, score = np.repeat(places, some.size), np.tile(some, places.size), np.zeros(places.size * some.size)
        else:
            raw = known @ v.T
            floor = self._floors()[0][places]
            if ids.size > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, -np.partition(-raw, self.k - 1, axis=1)[:, self.k - 1])
            row, col = np.nonzero(raw >= (floor - 2 * 10.0**-self.digits)[:, None])  # what rounding may bring to the floor
            q, at, score = places[row], ids[col], np.round(raw[row, col], self.digits) + 0.0
        floor, least = self._floors()
        new = (score > floor[q]) | ((score == floor[q]) & (at < least[q])) | np.isneginf(floor[q])
        if new.any():
            q, score, at = (np.concatenate([a, b[new]]) for a, b in zip(self.top, (q, score, at), strict=True))
            order = np.lexsort((at, -score, q))
            q, score, at = q[order], score[order], at[order]
            kept = np.arange(q.size) - np.searchsorted(q, q) < self.k
            self.top = q[kept], score[kept], at[kept]


def best_of_cells(met: DataFrame, cells: int, k: int, digits: int) -> DataFrame:
    """(query_id, id, score): the k best rows at most of each query in its cell, of met (cell, kind, id, v, least): queries are of kind 0, rows of kind 1; scores below a query's least don't count.

    A task holds the queries of a cell, and the cell's rows stream by.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: _Best) -> pa.RecordBatch:
            q, score, at = found.top
            return pa.RecordBatch.from_arrays([pa.array(found.ids[q]), pa.array(at), pa.array(score)], names=["query_id", "id", "score"])

        now, found = None, _Best(k, digits)
        for batch in batches:
            cell, kind, ids, least = (np.asarray(batch.column(i)) for i in (0, 1, 2, 4))
            ends = [*(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1), batch.num_rows] if batch.num_rows else []
            for a, b in zip([0, *ends], ends, strict=False):
                if cell[a] != now:
                    yield told(found)
                    now, found = cell[a], _Best(k, digits)
                v = batch.column(3).slice(a, b - a)
                if kind[a] == 0:
                    found.ask(ids[a:b], v, least[a:b])
                else:
                    found.meet(ids[a:b], v)
        yield told(found)

    return met.select("cell", "kind", "id", "v", "least").repartition(cells, "cell").sortWithinPartitions("cell", "kind").mapInArrow(best, "query_id bigint, id bigint, score double")


def vector_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar rows to each row of queries; scores of any sign count; ties to the smaller id.

    Both are dealt to cells of a grid, where at most about QUERIES queries are held and ROWS rows stream by; each cell gives k rows a query at most. Vectors of other sizes,
    null or zero ones score 0; null elements count as 0, rows of null id are left out. Both tables are counted first, so they should be at rest.
    """
    groups, parts = max(1, -(-queries.count() // QUERIES)), max(1, -(-vectors.count() // ROWS))

    def dealt(rows: DataFrame, kind: int, own: int, others: int) -> DataFrame:
        vector = F.coalesce(F.col(vector_col).cast("array<double>"), F.array().cast("array<double>"))
        vector = F.when(F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0)))).otherwise(vector)
        mine, other = F.pmod(F.xxhash64("id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        some = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v")).select("id", "v", mine.alias("mine"), other.alias("other"))
        cell = F.col("other") * groups + F.col("mine") if kind == 0 else F.col("mine") * groups + F.col("other")
        return some.select(cell.cast("bigint").alias("cell"), F.lit(kind).alias("kind"), "id", "v", F.lit(float("-inf")).alias("least"))

    met = dealt(queries, 0, groups, parts).unionByName(dealt(vectors, 1, parts, groups))
    found = best_of_cells(met, groups * parts, k, digits).withColumnRenamed("id", id_col)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
