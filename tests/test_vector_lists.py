import random

from siltstone.operators import retrieval, vector_lists


def test_equals_the_full_search(spark, tmp_path):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(400)]
    rows += [(400, None), (401, [1.0]), (402, [0.0] * 6), (403, rows[0][1]), (404, [-x for x in rows[0][1]]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = df.where("id % 100 = 0 or id > 401")  # one of another size is like others of that size in the full search alone
    vector_lists.write_vector_lists(df, f"{tmp_path}/l", "id", "v", 6, lists=24)
    for k in (1, 7, 60, 500):
        got = vector_lists.vector_topk_lists(f"{tmp_path}/l", asked, "id", "v", k).collect()
        want = retrieval.vector_topk(df, asked, "id", "v", k).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.id, r.score + 0.0) for r in want)
        if k == 7:
            read = {r.query_id: r.n_lists for r in got}
            assert read[100] < 12 and read[402] > 20  # of 25; one without length has no nearest list


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id bigint, v array<double>")
    vector_lists.write_vector_lists(df, f"{tmp_path}/l", "id", "v", 6)
    assert vector_lists.vector_topk_lists(f"{tmp_path}/l", df, "id", "v", 3).count() == 0


def most_rows(node) -> int:
    """The most rows that any operator of an executed plan gave."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_rows(node.plan())
    own, below = node.metrics().get("numOutputRows"), node.children()
    return max([own.get().value() if own.isDefined() else 0, *(most_rows(below.apply(i)) for i in range(below.size()))])


def test_pairs_never_become_rows(spark, tmp_path):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)], "id bigint, v array<double>")
    asked = df.where("id % 10 = 0")
    vector_lists.write_vector_lists(df, f"{tmp_path}/l", "id", "v", 16, lists=24)
    found = vector_lists.vector_topk_lists(f"{tmp_path}/l", asked, "id", "v", 5)
    got = found.collect()
    assert sum(r.n_lists for r in got if r["rank"] == 1) > 300 * 20  # without order there is next to nothing to skip: 900,000 pairs
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 3000 + 300 * 25 * 5
    want = retrieval.vector_topk(df, asked, "id", "v", 5).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.id, r.score) for r in want)


def test_cells_odd_rows_and_few_digits(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 260)]  # one list has many copies
    rows += [(i, [None, 0.0, 0.0, 0.0] if i % 2 else None) for i in range(260, 300)]
    rows += [(300, [float("nan"), 1.0, 0.0, 0.0])]  # scores 0, and must not hide the list that it would be in
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = df.where("id % 20 = 0 or id = 261")
    monkeypatch.setattr(vector_lists, "ROWS", 16, raising=False)
    monkeypatch.setattr(vector_lists, "QUERIES", 5, raising=False)
    vector_lists.write_vector_lists(df, f"{tmp_path}/l", "id", "v", 4, lists=12)
    for k, digits in ((3, 6), (40, 6), (4, 1)):
        got = vector_lists.vector_topk_lists(f"{tmp_path}/l", asked, "id", "v", k, digits).collect()
        want = retrieval.vector_topk(df, asked, "id", "v", k, digits).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.id, r.score + 0.0) for r in want)
