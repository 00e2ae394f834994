import corpus_pipeline as P

from siltstone.llm import importance, packing, rules, secrets, similar


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        before, out = docs, stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= before.count(), name
        if i == 2:
            assert similar.groups(before).where("first").count() == docs.count() == similar.deduplicated(docs).count()
        if i == 3:
            spans = secrets.scan(before).where("size(spans) > 0").count()
            assert docs.count() == before.count() and docs.where("text like '%[secret]%'").count() >= spans > 0
            assert secrets.scan(docs).where("size(base) > 0").count() == 0
    assert docs.agg({"length": "max"}).first()[0] <= 1024
    assert P.run(spark, sf_dir).count() == docs.count()
    assert [f.__module__ for f in (importance.selected, rules.kept, packing.pack)]


def test_every_query_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
