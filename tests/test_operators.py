import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import folds, graph, maintain, resolve, rules, validate
from siltstone.sources import corpus
from siltstone.streaming import limits


def test_scan_of_a_tree(spark, tmp_path):
    files = {"src/a.ts": b"export const A = 1\n", "src/deep/b.py": b"def f():\n  '''Doc.'''\n", "src/Dockerfile": b"FROM x", "src/a.test.ts": b"x", ".git/c.ts": b"x", "src/big.ts": b"x" * 900, "src/bad.md": b"# T\xff", "src/none.zzz": b""}
    for p, b in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: r for r in corpus.scan(spark, str(tmp_path), ["src/**/*", "src/*"], ["**/*.test.{ts,js}"], 500).collect()}
    assert set(got) == {"src/a.ts", "src/deep/b.py", "src/Dockerfile", "src/bad.md"}
    assert got["src/a.ts"].language == "typescript" and got["src/a.ts"].line_count == 2 and got["src/Dockerfile"].language == "dockerfile" and got["src/bad.md"].text == "# T�"


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows = [(1, i, 10 * i) for i in range(20)] + [(2, 100, 5), (2, 101, 5)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, t bigint")
    want = {r.event_id: r.accepted for r in limits.rate_limited(df, "user_id", 60, 3).collect()}
    assert [want[i] for i in range(8)] == [True, True, True, False, False, False, True, True] and want[100] and want[101]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = limits.rate_limited(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user_id", 60, 3).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.sql("select * from limited").collect()} == want


def test_limiter_boundary():
    ok, recent = limits.accept(list(range(101)), [], 60, 100)
    assert all(ok) and len(recent) == 60
    ok, _ = limits.accept([0] * 101, [], 60, 100)
    assert ok == [True] * 100 + [False]


@pytest.mark.parametrize(("n", "chunks"), [(49, 0), (50, 1), (500, 1), (501, 1)])
def test_chunk_sizes(n, chunks):
    assert len(folds.chunk_page("p", "# H\n" + "abcd" * n)) == chunks


def test_chunks_overlap_and_front_matter():
    text = "intro\n---\nx: 1\n---\n" + "\n\n".join(f"{k}" + " word" * 160 for k in range(4))
    got = folds.chunk_page("p", text, overlap=3)
    assert [i for i, *_ in got] == [f"p:{k}" for k in range(len(got))] and got[0][2].startswith("intro") and "x: 1" not in got[0][2]
    assert got[1][2].startswith("word word word")


def test_chunks_are_handed_on_in_bounded_batches():
    import pyarrow as pa

    text = "# H\n" + "\n\n".join("word " * 200 for _ in range(40))
    pages = pa.RecordBatch.from_pydict({"p": [str(i) for i in range(60)] + ["none", None], "t": [text] * 60 + [None, text]})
    out = list(folds.chunk_batches(iter([pages]), folds.TARGET, 50))
    assert len(out) > 1 and all(sum(map(len, b.column(4).to_pylist())) < folds.HANDED + 10_000 for b in out)
    want = [(p, i, n, h, c, t) for p in [*(str(i) for i in range(60)), None] for n, (i, h, c, t) in enumerate(folds.chunk_page(p, text, overlap=50))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_greedy_and_diverse(spark):
    df = spark.createDataFrame([("g", "a", 0.9, 0, 60), ("g", "b", 0.8, 1, 70), ("g", "c", 0.7, 2, 30), ("g", "d", 0.6, 3, 20)], "g string, path string, score double, ordinal int, size int")
    assert [(r.path, r.used) for r in folds.greedy_context(df, "g", 100).orderBy("used").collect()] == [("a", 60), ("c", 90)]
    many = spark.createDataFrame(pd.DataFrame([("g", f"top/leaf/{i}", float(-i), i) for i in range(30)] + [("g", "other/x", -99.0, 99)], columns=["g", "path", "score", "ordinal"]))
    got = [r.path for r in folds.diverse_select(many, "g", 10).orderBy("place").collect()]
    assert got == ["top/leaf/0", "top/leaf/1", "top/leaf/2", "other/x", *(f"top/leaf/{i}" for i in range(3, 9))]


def test_relative_imports(spark):
    imports = spark.createDataFrame([("src/a/x.ts", 0, "./y.js"), ("src/a/x.ts", 1, "../z"), ("src/a/x.ts", 2, "@/a/y"), ("src/a/x.ts", 3, "react"), ("src/a/x.ts", 4, "./none")], "src string, import_ordinal int, source string")
    nodes = spark.createDataFrame([("src/a/y.ts", 0), ("src/z/index.ts", 1), ("src/z.ts", 2)], "path string, node_ordinal int")
    got = {r.import_ordinal: r.dst for r in resolve.resolve_candidates(resolve.relative_candidates(imports), nodes).collect()}
    assert got == {0: "src/a/y.ts", 1: "src/z/index.ts", 2: "src/a/y.ts"}


def test_graph_traps(spark):
    e = spark.createDataFrame([(1, 1, 0, False), (1, 2, 1, True), (1, 2, 2, False), (2, 3, 3, False), (3, 1, 4, False), (4, 1, 5, False)], "src int, dst int, ordinal int, type_only boolean")
    d = {r.node: r.degree for r in graph.degrees(e).collect()}
    assert d == {1: 6, 2: 3, 3: 2, 4: 1}
    assert {r.node for r in graph.cycle_members(e).collect()} == {1, 2, 3}
    assert {(r.node, r.depth) for r in graph.impact(e, spark.createDataFrame([(3,)], "node int")).collect()} == {(2, 1), (1, 2), (4, 3)}
    assert graph.impact(e, spark.createDataFrame([(4,)], "node int")).count() == 0


def test_name_status_and_merge(spark):
    lines = spark.createDataFrame([("A\ta",), ("M\tb",), ("D\tc",), ("R100\tx\ty",), ("C75\tp\tq",), ("T\tt",)], "l string")
    assert [(r.status, r.path, r.old_path) for r in maintain.parse_name_status(lines, "l").collect()] == [("added", "a", None), ("modified", "b", None), ("deleted", "c", None), ("renamed", "y", "x"), ("added", "q", None)]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    new = spark.createDataFrame([("c", 2)], "path string, v int")
    assert {tuple(r) for r in maintain.merge(old, new, spark.createDataFrame([("b",), ("c",)], "path string"), "path").collect()} == {("a", 1), ("c", 2)}


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.commit_type(F.lit("feat(x): y"))) == "feat" and get(T.commit_type(F.lit("feat!: y"))) == "other"
    assert get(T.line_count(F.lit(""))) == 1 and get(T.estimate_tokens(F.lit("a😀bc"))) == 2
    assert get(T.package_name(F.lit("@s/p/q"))) == "@s/p" and get(T.package_name(F.lit("lodash/x"))) == "lodash"
    assert get(T.logical_section(F.lit("a/providers/x.ts"))) == "Services" and get(T.logical_section(F.lit("x.ts"))) == "API Reference"
    h = 0
    for c in "internationalization":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert get(T.word_bucket(F.lit("internationalization"))) == abs(h - (1 << 32) if h >> 31 else h) % 256
    assert get(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert [get(T.naming_class(F.lit(x))) for x in ("fooBar", "FooBar", "foo_bar", "x-y")] == ["camelCase", "PascalCase", "snake_case", None]
    assert get(corpus.language(F.lit("a.b/file"))) is None and get(corpus.language(F.lit("a/X.PY"))) == "python"
    assert get(validate.batch_response(F.lit('```json\n{"a": "b"}\n```'))) == Row(module="", symbols={"a": "b"}) and get(validate.batch_response(F.lit("prose"))) == Row(module="prose", symbols={})


def test_rules(spark):
    s = spark.createDataFrame([("f", "function", "typescript", True, "any", "f()", [("a", "any"), ("b", "string")], None, None, 0), ("g", "function", "typescript", True, None, "g(): x", [], "doc", None, 1)], "name string, kind string, language string, exported boolean, returns string, signature string, parameters array<struct<name:string,type:string>>, doc_summary string, ai_summary string, ordinal int")
    assert [r.subject for r in rules.undocumented(s).collect()] == ["f"] and {r.subject for r in rules.missing_types(s).collect()} == {"f", "f(a)"}
    m = spark.createDataFrame([("a/b/c/d/e/f.ts", 501, 0, 0), ("config/x.ts", 900, 0, 1), ("y.ts", 500, 31, 2)], "path string, line_count int, n_symbols int, ordinal int")
    assert sorted(r.subject for r in rules.oversized(m).collect()) == ["a/b/c/d/e/f.ts", "y.ts"] and rules.deep_nesting(m).count() == 1


def test_cycle_members_are_not_between_cycles(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (5, 6), (6, 7), (8, 1), (20, 21), (21, 22), (22, 20), (20, 15), (15, 9), (9, 10), (10, 9)]
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src int, dst int, ordinal int")
    want = {1, 2, 4, 5, 6, 9, 10, 20, 21, 22}
    assert {r.node for r in graph.cycle_members(e).collect()} == want
    assert {r.subject for r in rules.circular(e).collect()} == want
    assert graph.cycle_members(e.where("src < 1")).count() == 0 == graph.cycle_members(e.where("src = 2 and dst = 3")).count()
