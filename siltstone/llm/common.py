"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session on one machine may be without one, and gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: Column) -> tuple[Column, Column]:
    """k1, k2: two hashes that name a row by some of its columns, in whatever way the table is scanned. Never null."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *told).alias("k1"), F.xxhash64(F.lit(2), *told).alias("k2")


def id_and_text(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.col(id_col).cast("bigint"), F.col(text_col).cast("string")


#: Joins send their smaller side to all executors if it has at most this many narrow rows (some 32 MB); beyond, both are shuffled.
BROADCAST_ROWS = 1 << 18


def matched(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with few, which has narrow rows and is a checkpoint: it is counted first."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def without(docs: DataFrame, key: tuple[Column, Column], gone: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows whose key is one of gone (k1, k2), which is a checkpoint."""
    return matched(docs.select(F.struct("*").alias("row"), *key), gone, ["k1", "k2"], "left_anti").select("row.*")


def kept_once(docs: DataFrame, key: tuple[Column, Column], judged: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows whose key is in judged (k1, k2, first), a checkpoint, and not first there; of rows of one key that is, any one stays."""
    met = matched(docs.select(F.struct("*").alias("row"), *key), judged, ["k1", "k2"], "left")
    kept = met.where("first is null").select("row.*")
    if judged.where("first").isEmpty():
        return kept
    return kept.unionByName(met.where("first").dropDuplicates(["k1", "k2"]).select("row.*"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]
