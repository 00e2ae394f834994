"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine may be without one, and gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df materialised in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_rest(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is made once; for wide rows, which a checkpoint would make twice and keep unpacked."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A checkpoint of at most so many narrow rows is sent to all executors; beyond, both sides of its joins are shuffled.
BROADCAST_ROWS = 1 << 18


def counted(df: DataFrame) -> DataFrame:
    """cut(df), to be broadcast if it turns out to be small."""
    from pyspark.sql import functions as F

    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def placed(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Adds name: 1, 2, 3... in order within each group, however large it is: rows are sorted over ranges, numbered in each, and moved on by the counts of the ranges before. Rows of a null group are left out."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    dealt = cut(rows.orderBy(*group, *order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n")).select(*group, "__range", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a range, and one a group
    here = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    return dealt.withColumn("__here", here).join(counts, [*group, "__range"]).withColumn(name, F.col("__here") + F.col("__before")).drop("__range", "__here", "__before")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """A table that each round of a loop writes anew in the shared folder; the one before is deleted once the next is there.

    What is read back is a plain scan: a checkpoint keeps all that the optimizer knew of the rows, and over many rounds that grows without end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, ""

    def put(self, df: DataFrame) -> DataFrame:
        path, before = new_folder(self.spark, self.name), self.path
        df.write.parquet(path)
        self.path = path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store, sorted; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
