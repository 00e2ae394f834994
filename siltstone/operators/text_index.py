"""A text index that is kept up to date: segments that never change, tombstones, merged reads and compaction behind one pointer."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import INDEX_VERSION, SHELVES, _corpus, _ranked, exploded_terms, term_counts
from siltstone.operators.shared import children, remove


def _shelf(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHELVES)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """BM25 over the last text of every document (id_col) that was put into folder.

    A segment holds the postings of some documents, by shelves of a hash of the term and sorted by term, their lengths, and the ids whose rows in
    earlier segments no longer count. A pointer lists the segments in order; a new one is written last and only if no other writer has
    written that one, so a reader sees all of a change or nothing of it, and a job that dies leaves no more than files that nothing points to.
    """

    spark: SparkSession
    folder: str
    id_col: str

    def pointers(self) -> list[int]:
        names = children(self.spark, f"{self.folder}/pointers")
        return [int(n) for n in names if n.isdigit() and "_SUCCESS" in children(self.spark, f"{self.folder}/pointers/{n}")]

    def segments(self) -> list[str]:
        """Of the last pointer; raises for another version of the format."""
        at = self.pointers()
        if not at:
            return []
        told = self.spark.read.schema("version int, segments array<string>").json(f"{self.folder}/pointers/{at[-1]:010}").first()
        if told.version != INDEX_VERSION:
            raise ValueError(f"index version {told.version} is not {INDEX_VERSION}")
        return list(told.segments or [])

    def _point(self, segments: list[str], after: int) -> None:
        told = self.spark.createDataFrame([(INDEX_VERSION, segments)], "version int, segments array<string>")
        told.coalesce(1).write.mode("error").json(f"{self.folder}/pointers/{after + 1:010}")

    def _last(self) -> int:
        return max(self.pointers(), default=0)

    def _write(self, rows: DataFrame, lengths: DataFrame, gone: DataFrame) -> str:
        """A segment of postings (id, term, tf, dl), lengths (id, dl) and tombstones (id)."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/segments/{name}"
        shelved = rows.withColumn("shelf", _shelf("term"))
        shelved.repartitionByRange("shelf", "term", self.id_col).sortWithinPartitions("shelf", "term", self.id_col).write.partitionBy("shelf").parquet(f"{at}/postings")
        lengths.write.parquet(f"{at}/lengths")
        gone.distinct().write.parquet(f"{at}/gone")
        return name

    def put(self, changes: DataFrame, text: Column, status: str = "status", most: int = 8) -> None:
        """Documents of changes (id, status, ...): those deleted leave the index, all others come in with this text, in place of any earlier one.

        Null text has no words; rows of null id are left out; an id may come once. Without a row nothing is written. Beyond most segments all are made one.
        """
        after = self._last()
        new = F.coalesce(F.col(status), F.lit("")) != "deleted"
        own = changes.where(F.col(self.id_col).isNotNull()).select(self.id_col, new.alias("__new"), F.when(new, text).alias("__text"))
        pending = f"{self.folder}/pending/{uuid.uuid4().hex}"  # the changes are worked out and their texts read once
        try:
            counts = term_counts(own, [self.id_col, "__new"], F.col("__text"))
            counts.write.parquet(pending)
            counted = self.spark.read.schema(counts.schema).parquet(pending)
            if counted.isEmpty():
                return
            said = counted.where("__new")
            name = self._write(exploded_terms(said, self.id_col), said.select(self.id_col, "dl"), counted.select(self.id_col))
        finally:
            remove(self.spark, pending)
        self._point([*self.segments(), name], after)
        if len(self.segments()) > most:
            self.compact()

    def _read(self, part: str, segments: list[str]) -> DataFrame:
        """A part of all segments, with the segment's place."""
        out = None
        for i, s in enumerate(segments):
            at, read = f"{self.folder}/segments/{s}", self.spark.read
            if part == "postings":  # without a row there is no file to tell the columns
                kind = dict(self.spark.read.parquet(f"{at}/lengths").dtypes)[self.id_col]
                read = read.schema(f"{self.id_col} {kind}, term string, dl bigint, tf bigint, shelf int")
            rows = read.parquet(f"{at}/{part}").withColumn("place", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _live(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """rows of segments that no later segment has set aside."""
        last = gone.where("place > 0").groupBy(self.id_col).agg(F.max("place").alias("last"))
        return rows.join(last, self.id_col, "left").where("last is null or last <= place").drop("last", "place")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """bm25() of queries (query_id, term), whose terms the caller bounds: reads their shelves, all lengths and tombstones, and no text."""
        segments = self.segments()
        terms = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
        if not segments:
            nothing = queries.select("query_id", F.lit(None).cast("bigint").alias(self.id_col), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
            return nothing.limit(0)
        wanted = [r.term for r in terms.select("term").distinct().collect()]
        shelves = [r.s for r in self.spark.createDataFrame([(w,) for w in wanted], "term string").select(_shelf("term").alias("s")).distinct().collect()]
        gone = self._read("gone", segments)
        met = self._read("postings", segments).where(F.col("shelf").isin(shelves) & F.col("term").isin(wanted)).drop("shelf")
        tf = self._live(met, gone)
        facts = _corpus(self._live(self._read("lengths", segments), gone))
        return _ranked(tf, tf.groupBy("term").agg(F.count("*").alias("df")), facts, terms, self.id_col, k)

    def compact(self, keep: int = 1) -> None:
        """Makes one segment of all that count, without tombstones, and deletes pointers older than the keep before it, with the segments that only they name."""
        after, segments = self._last(), self.segments()
        if len(segments) < 2:
            return
        gone = self._read("gone", segments)
        name = self._write(self._live(self._read("postings", segments).drop("shelf"), gone), self._live(self._read("lengths", segments), gone), gone.select(self.id_col).limit(0))
        self._point([name], after)
        named = lambda p: set(self.spark.read.schema("version int, segments array<string>").json(f"{self.folder}/pointers/{p:010}").first().segments)
        at = self.pointers()
        old, held = at[: -1 - keep], set().union(*map(named, at[-1 - keep :]))
        for s in set().union(*map(named, old)) - held:
            remove(self.spark, f"{self.folder}/segments/{s}")
        for p in old:
            remove(self.spark, f"{self.folder}/pointers/{p:010}")
