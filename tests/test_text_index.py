import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.operators.shared import children
from siltstone.operators.text_index import TextIndex

WORDS = "apple pear plum fig stone iron lead tin".split()


def ranks(rows):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in rows.collect())


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "apple"), (1, "iron"), (1, "iron"), (2, "fig"), (3, "nowhere")], "query_id int, term string")


def test_equals_an_index_made_anew(spark, tmp_path, queries):
    rng = random.Random(5)
    index, now = TextIndex(spark, f"{tmp_path}/i", "id"), {}
    assert index.search(queries, 5).count() == 0
    for turn in range(5):
        rows = []
        for i in rng.sample(range(40), 15):
            kind = rng.choice(["added", "modified", "deleted"]) if turn else "added"
            text = rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))])
            rows.append((i, kind, text, "x"))
            now.pop(i, None)
            if kind != "deleted":
                now[i] = text
        rows.append((None, "added", "apple", "x"))
        index.put(spark.createDataFrame(rows, "id int, status string, text string, term string"), F.col("text"), most=3)
        docs = spark.createDataFrame([(i, t or "") for i, t in now.items()], "id int, text string")
        assert ranks(index.search(queries, 6)) == ranks(retrieval.bm25(docs, queries, "id", F.col("text"), 6))
        assert len(index.segments()) <= 3
    before = ranks(index.search(queries, 6))
    index.compact()
    assert len(index.segments()) == 1 and ranks(index.search(queries, 6)) == before
    held = set(children(spark, f"{tmp_path}/i/segments"))
    assert set(index.segments()) <= held and len(held) <= 5 and len(index.pointers()) <= 2


def test_empty_changes_and_all_deleted(spark, tmp_path, queries):
    index = TextIndex(spark, f"{tmp_path}/i", "id")
    rows = spark.createDataFrame([(1, "added", "apple fig"), (2, "added", "fig")], "id int, status string, text string")
    index.put(rows.limit(0), F.col("text"))
    assert index.pointers() == []
    index.put(rows, F.col("text"))
    index.put(rows.limit(0), F.col("text"))
    assert index.pointers() == [1] and index.search(queries, 5).count() == 3
    index.put(rows.withColumn("status", F.lit("deleted")), F.col("text"))
    assert index.search(queries, 5).count() == 0
    index.compact()
    assert index.search(queries, 5).count() == 0


def test_what_no_pointer_names_is_not_there(spark, tmp_path, queries):
    index = TextIndex(spark, f"{tmp_path}/i", "id")
    rows = spark.createDataFrame([(1, "added", "apple fig")], "id int, status string, text string")
    index.put(rows, F.col("text"))
    index._write(retrieval.postings(rows, "id", F.lit("apple")), rows.select("id", F.lit(1).cast("bigint").alias("dl")), rows.select("id"))  # a job that died before its pointer
    assert len(index.segments()) == 1 and len(children(spark, f"{tmp_path}/i/segments")) == 2
    with pytest.raises(Exception, match="already exists"):
        index._point(["x"], 0)  # another writer was first
    spark.createDataFrame([(9, ["x"])], "version int, segments array<string>").coalesce(1).write.json(f"{tmp_path}/i/pointers/{2:010}")
    with pytest.raises(ValueError, match="version 9"):
        index.search(queries, 5)


def test_changes_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, f"The Apple w{i} w{i} b" if i % 3 else None, "deleted" if i % 5 == 0 else "added") for i in range(50)], "id bigint, t string, status string")
    index = TextIndex(spark, str(tmp_path / "once"), "id")
    index.put(rows.mapInArrow(see, rows.schema), F.col("t"))
    assert seen.value == 50
    found = index.search(spark.createDataFrame([(1, "apple"), (2, "w7")], "query_id int, term string"), 100).collect()
    assert {r.id for r in found if r.query_id == 1} == {i for i in range(50) if i % 3 and i % 5} and {r.id for r in found if r.query_id == 2} == {7}
    facts = index._read("lengths", index.segments()).collect()
    assert {r.id: r.dl for r in facts} == {i: 3 if i % 3 else 0 for i in range(50) if i % 5}
