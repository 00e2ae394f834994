"""Exact vector search that skips rows: lists about centroids with radius bounds, read until the k nearest are certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import best_of_cells
from siltstone.operators.shared import at_rest

#: Most queries that a task holds of a list, and rows of a list that it meets them with, about.
QUERIES, ROWS = 1 << 14, 1 << 16

#: What errors of arithmetic may hide of a score, beside the rounding of its last digit.
_SLACK = 1e-6


def _units(vectors: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have that size and a finite length, and these at length one. Null elements count as 0."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False))
    v = pc.fill_null(vectors.filter(pa.array(fits)).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(int(fits.sum()), size)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return np.flatnonzero(fits)[good], v[good] / length[good, None]


def _arrays(places: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """n arrays: the rows of values at these places, empty ones elsewhere."""
    sizes = np.zeros(n, np.int64)
    sizes[places] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.ravel()))


def _raw(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _away(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors by their cosine."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def write_vector_lists(vectors: DataFrame, folder: str, id_col: str, vector_col: str, size: int, lists: int = 64) -> None:
    """Unit vectors of size elements in folder, each with the nearest of `lists` centroids (rows of least hash), and each list's radius.

    Rows of null vectors, of other sizes or without a finite length above 0 form a list of their own, -1, as empty arrays. Rows of null id are left out.
    """
    raw = _raw(vectors, id_col, vector_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, v = _units(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(known)), _arrays(np.arange(known.size), v, known.size)], names=["id", "v"])

    seeds = raw.mapInArrow(made, "id bigint, v array<double>").orderBy(F.xxhash64("id"), "id").limit(max(1, lists)).collect()  # at most `lists` rows
    centres = np.unique(np.array([r.v for r in seeds], float).reshape(len(seeds), size), axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, v = _units(batch.column(1), size)
            number, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            if known.size:
                cosine = v @ centres.T
                number[known], far[known] = cosine.argmax(axis=1), _away(cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(known, v, batch.num_rows), pa.array(far), pa.array(number)], names=["id", "v", "far", "list"])

    dealt = raw.mapInArrow(deal, "id bigint, v array<double>, far double, list int")
    dealt.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")  # a list of many copies is written by many tasks
    spark = vectors.sparkSession
    done = spark.read.schema("id bigint, v array<double>, far double, list int").parquet(f"{folder}/rows")
    known = spark.createDataFrame(list(enumerate(centres.tolist())), "list int, centre array<double>")
    facts = done.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(F.broadcast(known), "list", "left")
    facts.withColumn("size", F.lit(size)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")


def vector_topk_lists(folder: str, queries: DataFrame, id_col: str, vector_col: str, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank, n_lists): retrieval.vector_topk()'s result, with the number of lists that were read for a query.

    First the nearest lists that hold k rows are read; the k-th score there bounds what is left: by the triangle inequality a list whose
    centre lies further off than its radius and that bound has no nearer row, and of the lists left only rows that reach the bound are handed on.
    A list is dealt to cells of about ROWS rows, where at most about QUERIES of the queries that read it are held and its rows stream by: pairs never become rows.
    """
    spark = queries.sparkSession
    facts = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()  # at most `lists` + 1 rows
    size, m = facts[0]["size"] if facts else 0, len(facts)
    number, held = np.array([r.list for r in facts], np.int32), np.array([r.n for r in facts], np.int64)
    # rows of list -1 score 0, as if they lay about the origin
    centres = np.array([r.centre or [0.0] * size for r in facts], float).reshape(m, size)
    radius = np.array([r.radius for r in facts], float)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's lists by the least distance of a row, how many of them hold k rows; a query without length may find its rows in any."""
        for batch in batches:
            n = batch.num_rows
            known, q = _units(batch.column(1), size)
            away = np.zeros((n, m))
            away[known] = _away(q @ centres.T)
            gap = np.maximum(away - radius, 0)
            order = np.lexsort((away, gap), axis=-1)
            before = np.cumsum(held[order], axis=1) - held[order]
            every, early = np.arange(n), (before < k).sum(axis=1).astype(np.int32)
            arrays = [_arrays(known, q, n), _arrays(every, number[order], n), _arrays(every, np.take_along_axis(gap, order, axis=1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(early)], names=["query_id", "q", "lists", "gaps", "early"])

    q = _raw(queries, id_col, vector_col).mapInArrow(reach, "query_id bigint, q array<double>, lists array<int>, gaps array<double>, early int")
    rows = spark.read.schema("id bigint, v array<double>, far double, list int").parquet(f"{folder}/rows")
    groups, parts = max(1, -(-queries.count() // QUERIES)), np.maximum(1, -(-held // ROWS))
    cells = max(1, int(parts.sum()) * groups)
    places = spark.createDataFrame(list(zip(number.tolist(), parts.tolist(), (np.cumsum(parts) - parts).tolist(), strict=True)), "list int, parts bigint, begin bigint")

    def scored(asked: DataFrame) -> DataFrame:
        """The k best at most in each cell, of asked (query_id, q, list, least): nothing below least counts."""

        def dealt(some: DataFrame, kind: int, part: Column, group: Column, v: str, least: Column) -> DataFrame:
            some = some.join(F.broadcast(places), "list").withColumn("part", part).withColumn("group", group)
            cell = (F.col("begin") + F.col("part")) * groups + F.col("group")
            return some.select(cell.alias("cell"), F.lit(kind).alias("kind"), "id", F.col(v).alias("v"), least.alias("least"))

        all_of = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        asking = dealt(asked.withColumnRenamed("query_id", "id"), 0, all_of, F.pmod(F.xxhash64("id"), F.lit(groups)), "q", F.coalesce("least", F.lit(float("-inf"))))
        wanted = rows.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi")
        met = dealt(wanted, 1, F.pmod(F.xxhash64("id"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "v", F.lit(0.0))
        return best_of_cells(asking.unionByName(met), cells, k, digits)

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)

    nearest = q.select("query_id", "q", F.explode(F.slice("lists", F.lit(1), F.col("early"))).alias("list"), F.lit(None).cast("double").alias("least"))
    start = at_rest(ranked(scored(nearest)).drop("rank"), "nearest")
    bound = start.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    within = F.sqrt(F.greatest(F.lit(2.0) - 2 * (F.col("least") - (10.0**-digits + _SLACK)), F.lit(0.0)))
    open_ = F.filter(F.arrays_zip("lists", "gaps"), lambda x, i: (i >= F.col("early")) & (F.col("least").isNull() | (x["gaps"] <= within)))
    left = q.join(bound, "query_id", "left").select("query_id", "q", "early", "least", open_["lists"].alias("open"))
    later = scored(left.select("query_id", "q", "least", F.explode("open").alias("list")))
    counts = left.groupBy("query_id").agg(F.sum(F.col("early") + F.size("open")).alias("n_lists"))
    return ranked(start.unionByName(later)).join(counts, "query_id")
