"""Incremental maintenance between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, status): added, deleted or modified, by a digest of each row."""
    a, b = before.select(key, digest.alias("h0")), after.select(key, digest.alias("h1"))
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").otherwise("modified")
    return a.join(b, key, "full_outer").where(~F.col("h0").eqNullSafe(F.col("h1"))).select(key, status.alias("status"))


def parse_name_status(lines: DataFrame, line: str) -> DataFrame:
    """(status, path, old_path) of tab-separated status lines: A, M, D, R and C; C counts as added; others are left out."""
    p = F.split(F.col(line), "\t")
    kind = F.substring(p[0], 1, 1)
    two = kind.isin("R", "C")
    status = F.when(kind == "R", "renamed").when(kind.isin("A", "C"), "added").when(kind == "M", "modified").when(kind == "D", "deleted")
    rows = lines.select(status.alias("status"), F.when(two, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(kind == "R", F.get(p, F.lit(1))).alias("old_path"))
    return rows.where("status is not null and path is not null")


def merge(previous: DataFrame, fresh: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Previous rows that are no targets, and the freshly made ones: a target without a fresh row is gone."""
    return previous.join(targets.select(key).distinct(), key, "left_anti").select(previous.columns).unionByName(fresh)


def rename_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with both ends rewritten by renames (old, new)."""
    a, b = renames.toDF("src", "src_new"), renames.toDF("dst", "dst_new")
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    return out.withColumns({"src": F.coalesce("src_new", "src"), "dst": F.coalesce("dst_new", "dst")}).select(edges.columns)


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both still exist: made anew after deletes, so nothing stale stays."""
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def without_deleted(rows: DataFrame, diffs: DataFrame, key: str) -> DataFrame:
    """rows but those whose key diffs (path, status) calls deleted."""
    return rows.join(diffs.where("status = 'deleted'").select(F.col("path").alias(key)).distinct(), key, "left_anti")


def ordered_union(first: DataFrame, second: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, place): keys of both without repeats, those of first before new ones of second, each in order."""
    both = first.select(key, F.lit(0).alias("turn"), ordinal).unionByName(second.select(key, F.lit(1).alias("turn"), ordinal))
    return both.groupBy(key).agg(F.min(F.struct("turn", ordinal)).alias("place"))


def retried(results: DataFrame, again: DataFrame, key: str, value: str) -> DataFrame:
    """results with empty values filled from a second attempt, and whether a row is still empty; of several answers for a key the least counts."""
    more = again.where(F.coalesce(value, F.lit("")) != "").groupBy(key).agg(F.min(value).alias("__v"))
    out = F.coalesce(F.nullif(value, F.lit("")), "__v")
    return results.join(more, key, "left").withColumn(value, out).withColumn("failed", F.col(value).isNull()).drop("__v")


def cached_summaries(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (path, content_hash, symbol) with summary from cache (key, summary, generated_at): of a symbol by content_hash:symbol, of a module by content_hash; the latest entry counts."""
    latest = cache.groupBy("key").agg(F.max_by("summary", "generated_at").alias("summary"))
    key = F.when(F.col("symbol").isNull(), F.col("content_hash")).otherwise(F.concat_ws(":", "content_hash", "symbol"))
    return wanted.withColumn("key", key).join(latest, "key", "left")


def merged_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each key (key, summary, generated_at): the latest, fresh ones before cached ones of the same time."""
    both = cache.withColumn("__f", F.lit(0)).unionByName(fresh.withColumn("__f", F.lit(1)))
    last = both.groupBy("key").agg(F.max(F.struct("generated_at", "__f", "summary")).alias("m"))
    return last.select("key", "m.summary", "m.generated_at")
