import pytest
from pyspark.sql import functions as F

from siltstone.operators import context, maintain, modules, parsers, resolve, retrieval
from siltstone.sources import corpus
from siltstone.streaming import limits


def test_parsers(spark):
    src = {
        "python": "'''Says M.'''\nimport os.path as p\nfrom ..a import b, c as d\n__all__ = ['f']\nLIMIT = 3\ndef f(a, *b, c=1):\n    \"\"\"Says f.\n    More.\"\"\"\ndef g(): pass\nclass K(Base): pass\n@x\ndef hidden(): pass\n",
        "typescript": "/** About it. */\nimport type { T } from './t'\nimport D, { a as b, c } from \"../m.js\"\nimport * as ns from 'pkg'\nimport './side'\n// Does f.\nexport async function f(x: number, ...y) {}\nexport default class K extends B {}\nconst g = (x: number) => x\nexport interface I {}\nexport type U = 1\nexport { q as r } from './q'\nexport * from './all'\n",
        "go": "// Package m does.\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\nfunc Run(a int, b string) {}\nfunc (s *S) stop() {}\ntype S struct {\n",
        "rust": "//! Crate doc\nuse std::io::{Read, Write};\npub use crate::x::Y;\npub fn f(a: u8) {}\nstruct S;\npub(crate) trait Q {}\n",
        "java": "import java.util.List;\nimport static a.B.c;\n/** Says A. */\npublic class A {\n  private int count(String s, int n) {\n}\n",
        "csharp": "using System.Text;\nnamespace N.M\n/// <summary>Says A.</summary>\npublic class A {\n  public int P { get; set; }\n",
        "php": "use A\\B\\{C, D};\nuse E\\F;\nclass A extends B {\n  private function h($x)\n",
        "sql": "-- About v\nCREATE OR REPLACE VIEW a.v AS\ncreate table if not exists \"t\" (\nCREATE UNIQUE INDEX i\nCREATE MATERIALIZED VIEW mv AS\ncreate sequence s1;\n",
        "markdown": "[![badge](x)](y)\n# A *b*\nshort\nThis line is the description.\n### [c](d)\n",
        "hcl": '# the main one\n  resource "aws_x" "main" {\nlocals {\nfoo "bar" {\nvariable "v" {\n',
        "shell": "#!/bin/bash\n# Sets up.\n# does a\nfunction a {\nb() {\nexport C=1\n",
        "yaml": "apiVersion: v1\nkind: Pod\n  no: y\n",
        "ruby": "require_relative 'z'\nrequire 'set'\nclass A < B\n def x(q)\n def y\n private :y\n",
    }
    rows = [(f"f.{k}", k, v) for k, v in src.items()] + [("bad.py", "python", "def ("), ("n.py", "python", None), ("x.zig", "zig", "\n// zig notes\nfn"), (None, None, "x")]
    found = parsers.parsed(spark.createDataFrame(rows, "path string, language string, text string")).collect()
    at = {r.language if r.path and r.path.startswith("f.") else r.path: r for r in found}
    brief = lambda k: [(s.name, s.kind, s.exported) for s in at[k].symbols]
    assert brief("python") == [("LIMIT", "constant", False), ("f", "function", True), ("g", "function", False), ("K", "class", False)]
    assert at["python"].doc == "Says M." and at["python"].symbols[1].doc == "Says f." and at["python"].symbols[1].parameters == ["a", "b", "c"] and at["python"].symbols[3].detail == "Base"
    assert [(i.source, i.names) for i in at["python"].imports] == [("os.path", ["p"]), ("..a", ["b", "c"])] and [e.name for e in at["python"].exports] == ["f"]
    assert brief("typescript") == [("f", "function", True), ("K", "class", True), ("g", "function", False), ("I", "interface", True), ("U", "type", True)]
    assert at["typescript"].doc == "About it." and at["typescript"].symbols[0].doc == "Does f." and at["typescript"].symbols[0].parameters == ["x", "y"] and at["typescript"].symbols[1].detail == "B"
    assert [tuple(i) for i in at["typescript"].imports] == [("./t", ["T"], True), ("../m.js", ["D", "a", "c"], False), ("pkg", ["ns"], False), ("./side", [], False)]
    assert [tuple(e) for e in at["typescript"].exports][-2:] == [("r", True, "./q"), ("*", True, "./all")]
    assert brief("go") == [("Run", "function", True), ("stop", "method", False), ("S", "class", True)] and at["go"].symbols[1].parent == "S" and at["go"].symbols[0].parameters == ["a", "b"]
    assert [(i.source, i.names) for i in at["go"].imports] == [("fmt", ["fmt"]), ("a/b", ["x"])] and at["go"].doc == "Package m does."
    assert brief("rust") == [("f", "function", True), ("S", "class", False), ("Q", "interface", True)] and at["rust"].imports[0].names == ["Read", "Write"] and at["rust"].exports[-1].source == "crate::x::Y"
    assert [(i.source, i.type_only) for i in at["java"].imports] == [("java.util.List", True), ("a.B.c", False)] and at["java"].symbols[1].parent == "A" and at["java"].symbols[1].parameters == ["s", "n"] and at["java"].symbols[0].doc == "Says A."
    assert brief("csharp") == [("N.M", "namespace", True), ("A", "class", True), ("P", "property", True)] and at["csharp"].symbols[1].doc == "Says A." and at["csharp"].imports[0].source == "System.Text"
    assert [(i.source, i.names) for i in at["php"].imports] == [("A\\B", ["C", "D"]), ("E\\F", ["F"])] and brief("php") == [("A", "class", True), ("h", "function", False)] and at["php"].symbols[1].parameters == ["x"]
    assert [(s.name, s.kind, s.detail) for s in at["sql"].symbols] == [("a.v", "interface", "VIEW"), ("t", "class", "TABLE"), ("mv", "interface", "MATERIALIZED VIEW"), ("s1", "variable", "SEQUENCE")]
    assert at["sql"].doc == "SQL schema (1 tables)" and at["sql"].symbols[0].doc == "About v" and at["sql"].symbols[1].doc is None
    assert [(s.name, s.detail) for s in at["markdown"].symbols] == [("A b", "h1"), ("c", "h3")] and at["markdown"].doc == "This line is the description."
    assert [(s.name, s.kind, s.doc) for s in at["hcl"].symbols] == [("resource.aws_x.main", "class", "the main one"), ("locals", "namespace", None), ("variable.v", "variable", None)] and at["hcl"].doc == "HCL configuration"
    assert [(s.name, s.doc) for s in at["shell"].symbols] == [("a", "does a"), ("b", None), ("C", None)] and at["shell"].doc == "Sets up."
    assert [s.name for s in at["yaml"].symbols] == ["apiVersion", "kind"] and at["yaml"].doc == "Kubernetes Pod"
    assert brief("ruby")[2] == ("y", "method", False) and [i.source for i in at["ruby"].imports] == ["./z", "set"] and at["ruby"].symbols[0].detail == "B"
    assert at["x.zig"].doc == "zig notes" and not at["bad.py"].symbols and not at["n.py"].symbols and len(found) == len(rows)


def test_from_files_to_a_graph(spark):
    files = {
        "src/a.ts": "import { b } from './b.js'\nimport r from 'react'\nimport { u } from '@org/u/deep'\n", "src/b.ts": "import '../lib'\n", "lib/index.js": "", "packages/u/src/deep/index.ts": "import '@org/u'\n", "packages/u/src/index.ts": "",
        "package.json": '{"name": "root", "description": "d", "workspaces": ["packages/*"]}', "packages/u/package.json": '{"name": "@org/u"}', "packages/u/node_modules/z/package.json": '{"name": "z"}', "packages/n/package.json": "no json",
    }
    df = spark.createDataFrame([(p, t) for p, t in files.items()], "path string, text string").withColumn("language", corpus.language(F.col("path")))
    packages = corpus.workspaces(df)
    assert [tuple(r) for r in packages.collect()] == [("@org/u", "packages/u", 1, "npm")]
    imports = parsers.imports_of(parsers.parsed(df.where("language is not null")))
    nodes = df.select("path").withColumn("node_ordinal", F.xxhash64("path"))
    edges = resolve.build_graph(imports, nodes, packages)
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "packages/u/src/deep/index.ts"), ("src/b.ts", "lib/index.js"), ("packages/u/src/deep/index.ts", "packages/u/src/index.ts")}
    assert [r.source for r in resolve.external_sources(imports, edges).collect()] == ["react"]
    assert tuple(corpus.package_facts(df).first()) == ("root", "d")
    pnpm = spark.createDataFrame([("package.json", "{}"), ("pnpm-workspace.yaml", "packages:\n  - 'libs/*'\n  - \"x\"\n"), ("libs/a/package.json", '{"name": "a"}')], "path string, text string")
    assert [tuple(r) for r in corpus.workspaces(pnpm).collect()] == [("a", "libs/a", 1, "pnpm")]
    lerna = spark.createDataFrame([("lerna.json", "{}"), ("packages/b/package.json", '{"name": "b"}')], "path string, text string")
    assert [r.type for r in corpus.workspaces(lerna).collect()] == ["lerna"] and corpus.workspaces(lerna.where("path = 'x'")).count() == 0


def test_candidates_of_imports(spark):
    rows = [("a/x.ts", i, s) for i, s in enumerate(["./x.cjs", "./x.mjs", "./x.jsx", "./y.mts"])]
    nodes = spark.createDataFrame([("a/x.ts", 0), ("a/y.mts", 1), ("a/x.mts", 2)], "path string, node_ordinal int")
    got = {r.import_ordinal: r.dst for r in resolve.resolve_candidates(resolve.relative_candidates(spark.createDataFrame(rows, "src string, import_ordinal int, source string")), nodes).collect()}
    assert got == {0: "a/x.ts", 1: "a/x.ts", 3: "a/y.mts"}


def test_best_window_and_packing(spark):
    lines = [f"line {i:03d} padding padding" for i in range(100)]
    lines[70:74] = [f"call target here {i}" for i in range(4)]
    text = "\n".join(lines)
    part = context.best_window(text, ["target"], 100)
    assert part.count("target") == 4 and context.tokens(part) <= 100 and part in text
    assert context.best_window("a\nb", ["a"], 50) == "a\nb" and context.best_window(text, [], 0) == ""
    small, mid, big = "s" * 80, "m" * 240, text
    texts = spark.createDataFrame([("t", text, ["target"]), ("s", small, []), ("m", mid, None), ("big", big, ["target"]), ("gone", None, [])], "path string, text string, names array<string>")
    scored = spark.createDataFrame([("g", "m", 0.9, 1), ("g", "big", 0.8, 2), ("g", "s", 0.7, 3), ("g", "gone", 1.0, 0), ("g", "t", 0.1, 9), ("h", "s", 0.5, 1)], "g string, path string, score double, ordinal int")
    got = context.build_context(scored, texts, 400, group="g", target="t").orderBy("g", "place").collect()
    one = [r for r in got if r.g == "g"]
    assert [r.path for r in one][:2] == ["t", "m"] and context.tokens(one[0].content) <= 160 and "target" in one[0].content
    assert one[2].path == "big" and one[2].content != big and one[-1].used <= 400 and [r.place for r in one] == list(range(len(one)))
    assert [r.path for r in got if r.g == "h"] == ["t", "s"]
    assert context.build_context(scored.limit(0), texts, 400, group="g").count() == 0


def test_indexes_round_trip(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    queries = spark.createDataFrame([(1, "thing"), (1, "hea"), (1, "hea"), (2, "und"), (3, "nosuchword")], "query_id int, term string")
    retrieval.write_text_index(docs, f"{tmp_path}/t", "doc_id", F.col("text"))
    want = retrieval.bm25(docs, queries, "doc_id", F.col("text"), 7)
    got = retrieval.bm25_indexed(f"{tmp_path}/t", queries, 7)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want) and got.count() > 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "PartitionFilters: [" in plan
    chunks = spark.createDataFrame([("a", "Head", "some words"), ("b", None, "other words here"), ("c", "", "")], "chunk_id string, heading string, content string")
    retrieval.build_indexes(chunks, f"{tmp_path}/both")
    back = {r.chunk_id: r for r in retrieval.read_vector_index(spark, f"{tmp_path}/both").collect()}
    assert set(back) == {"a", "b", "c"} and back["b"].token_count == 4 and sum(x > 0 for x in back["a"].vector) == 3 and not any(back["c"].vector)
    spark.read.parquet(f"{tmp_path}/t/corpus").withColumn("version", F.lit(2)).write.parquet(f"{tmp_path}/other/corpus")
    with pytest.raises(Exception, match="index version 2 is not 1"):
        retrieval.bm25_indexed(f"{tmp_path}/other", queries, 3).collect()
    twice = spark.createDataFrame([("a", [1.0], 0), ("a", [2.0], 1), ("z", [3.0], 0)], "chunk_id string, vector array<double>, ordinal int")
    assert [tuple(r) for r in retrieval.chunk_vectors(chunks.select("chunk_id"), twice).collect()] == [("a", [2.0])]


def test_snapshots(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert corpus.read_snapshot(spark, f"{tmp_path}/s") is None
    corpus.write_snapshot({"m": one}, f"{tmp_path}/s", "c1")
    corpus.write_snapshot({"m": two, "n": one}, f"{tmp_path}/s", "c2")
    got = corpus.read_snapshot(spark, f"{tmp_path}/s")
    assert set(got) == {"m", "n"} and got["m"].count() == 2


def test_names_in_prose_and_log_lines(spark):
    known = spark.createDataFrame([("UserService", 0), ("Parser", 1)], "known string, ordinal int")
    texts = spark.createDataFrame([(1, "See `UserServise` and `Parsr`, `Promise`, `Unrelated` and Parsr."), (2, "none"), (3, "`UserService`")], "id int, t string")
    got = {r.id: r.t for r in resolve.fixed_names(texts, known, "id", "t").collect()}
    assert got == {1: "See `UserService` and `Parser`, `Promise`, `Unrelated` and Parsr.", 2: "none", 3: "`UserService`"}
    cited = resolve.citations(spark.createDataFrame([(1, "a [my file: x.md:12] [b:99999999999999999999] [c]")], "id int, t string"), "id", "t")
    assert [(r.cited, r.line) for r in cited.collect()] == [("my file: x.md", 12), ("b", None)]
    lines = spark.createDataFrame([(0, "h1\tme\t2024-01-01\tfix: a\tb"), (1, "broken")], "ordinal int, value string")
    assert [tuple(r) for r in corpus.log_lines(lines).collect()] == [("h1", "me", "2024-01-01", "fix: a\tb", 0)]


def test_dispatch_limits(spark):
    events = [(0, "a", "f1"), (10, "a", "f2"), (20, "b", "f1"), (30, "c", None), (31, "d", None), (32, "e", None), (33, "f", None), (34, "g", None), (61, "a", None), (95, "h", "f1"), (86_500, "h", "f1")]
    rows = [(s, i, t, k, v) for s in (1, 2) for i, (t, k, v) in enumerate(events)]
    got = limits.dispatched(spark.createDataFrame(rows, "service int, event_id int, t int, key string, visitor string").repartition(5), "service").collect()
    for s in (1, 2):
        assert [r.accepted for r in sorted(got, key=lambda r: r.event_id) if r.service == s] == [True, False, False, True, True, True, True, False, True, False, True]


def test_odd_citations(spark):
    text = "see [a.ts:03] and [a.ts:3] and [a.ts:99999999999999999999] and [b.ts:1] [a.ts:0]"
    files = spark.createDataFrame([("a.ts", 5)], "cited string, line_count int")
    r = resolve.rewritten_citations(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string"), files, "id", "t").collect()
    got = {x.id: (x.t, x.n_valid, x.n_dropped) for x in r}
    assert got[1] == ("see [a.ts:03](api/a.md) and [a.ts:3](api/a.md) and `a.ts` and `b.ts` `a.ts`", 2, 3)
    assert got[2] == (None, 0, 0) and got[3] == ("none", 0, 0)


def test_trees_count_their_own_endings(spark):
    paths = ["a.mjs", "b.lua", "c.mdx", "d.pyi", "e.ts", "f.zsh", "Dockerfile", "x/dockerfile", "tests/g.ts", "h.KTS", "md"]
    r = corpus.tree_counts(spark.createDataFrame([(p, "blob") for p in paths] + [("src", "tree")], "path string, type string")).first()
    assert (r.total, r.source) == (11, 5)


def test_answers_that_come_twice(spark):
    first = spark.createDataFrame([("a", ""), ("b", "x"), ("c", None)], "k string, v string")
    again = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", ""), ("c", "")], "k string, v string")
    assert sorted(map(tuple, maintain.retried(first, again, "k", "v").collect())) == [("a", "1", False), ("b", "x", False), ("c", None, True)]


def test_vectors_of_other_sizes(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, None), (5, []), (6, [None, 3.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r.query_id, r.id): r.score for r in retrieval.vector_topk(df, df.where("id in (1, 4, 6)"), "id", "v", 10).collect()}
    assert len(got) == 21 and got[1, 1] == got[6, 2] == 1 and got[1, 7] == -1 and got[1, 3] == got[1, 4] == got[4, 4] == got[4, 5] == got[6, 1] == 0
    assert [r.id for r in retrieval.vector_topk(df, df.where("id = 4"), "id", "v", 2).orderBy("rank").collect()] == [1, 2]


def test_bags_of_words_shuffle_counts_only(spark):
    from collections import Counter

    from siltstone.functions.text import word_bucket

    rows = [(1, "One two, TWO"), (2, None), (3, "--"), (1, "two " * 3000 + "x" * 50), (None, "a_b"), (None, "a_b c"), *((i, f"w{i} w{i % 7}") for i in range(10, 400))]
    df = spark.createDataFrame(rows, "id bigint, t string")
    words = Counter((i, w) for i, t in rows for w in (t or "").lower().replace(",", "").replace("--", "").split())
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in {w for _, w in words}], "w string").select("w", word_bucket(F.col("w")).alias("b")).collect()}
    want = Counter()
    for (i, w), n in words.items():
        want[i, bucket[w]] += n
    counts = retrieval.bow_counts(df, "id", F.col("t"))
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # of an id's counts, not of words
    got = {(r.id, r.bucket): (r.n, r.weight) for r in counts.collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    norm = {i: sum(n * n for (j, _), n in want.items() if j == i) ** 0.5 for i, _ in want}
    assert all(abs(w - n / norm[i]) < 1e-12 for (i, _), (n, w) in got.items())
    vectors = {r.id: r.vector for r in retrieval.bow_vectors(df, "id", F.col("t")).collect()}
    assert vectors.keys() == norm.keys() and all(abs(vectors[i][b] - w) < 1e-12 for (i, b), (_, w) in got.items())


def test_vector_search_over_a_grid(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieval, "QUERIES", 16)
    monkeypatch.setattr(retrieval, "ROWS", 40)
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    found = retrieval.vector_topk(df, df.where("id % 7 = 0"), "id", "v", 10)
    assert "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan

    def score(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) + 0.0 if len(a) == len(b) and size else 0.0

    want = {(q, i, r) for q, a in rows if q % 7 == 0 for r, (_, i) in enumerate(sorted((-score(a, b), i) for i, b in rows)[:10], 1)}
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want


def test_related_files_by_endings_within_names_and_by_whole_paths(spark):
    paths = ["a/xfoo.ts", "b/foo.js", "b/foo.ts", "src/services/p.ts", "zsrc/services/p.js", "README", "q/README", "b/index.ts"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ordinal bigint")
    rows = [("m", "./foo"), ("m", "./foo"), ("n", "@/services/p"), ("n", "./README"), ("n", "foo"), ("n", "./none"), ("o", "./index"), ("o", "./b/index")]
    got = {tuple(r) for r in modules.related_files(spark.createDataFrame(rows, "path string, source string"), files).collect()}
    assert got == {("m", "./foo", "a/xfoo.ts"), ("n", "@/services/p", "src/services/p.ts"), ("n", "./README", "README"), ("o", "./index", "b/index.ts"), ("o", "./b/index", "b/index.ts")}


def test_related_files_cut_no_path_at_each_character(spark):
    long = spark.range(300).selectExpr("concat(repeat('folder/', 6000), 'f', id, '.ts') AS path", "id AS ordinal")
    imports = spark.createDataFrame([("m", "./f7")], "path string, source string")
    found = modules.related_files(imports, long)
    n = [r for r in str(found._jdf.queryExecution().optimizedPlan().toString()).split("\n") if "sequence" in r.lower()]
    assert not n and found.first().related.endswith("/f7.ts") and found.count() == 1


def test_graph_seeks_each_import_once(spark):
    imports = spark.createDataFrame([("a/x.ts", 1, "./y.js", True), ("a/x.ts", 2, "@org/p/z", False), ("a/x.ts", 3, "lib", False), ("a/x.ts", 4, "./none", False)], "src string, import_ordinal bigint, source string, type_only boolean")
    nodes = spark.createDataFrame([("a/y.ts", 1), ("a/y.js", 0), ("pk/src/z.ts", 2)], "path string, node_ordinal bigint")
    packages = spark.createDataFrame([("@org/p", "pk", 0)], "name string, dir string, package_ordinal int")
    edges = resolve.build_graph(imports, nodes, packages)
    assert sorted(map(tuple, edges.collect())) == [("a/x.ts", "a/y.js", True, 1), ("a/x.ts", "pk/src/z.ts", False, 2)]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert sorted(map(tuple, resolve.external_counts(imports, nodes, packages).collect())) == [("./none", 1), ("lib", 1)]


def test_places_are_counted_over_ranges(spark):
    from siltstone.operators import batching

    rows = [(f"p{i * 7919 % 4000}", f"T{i % 50}", "abc"[i % 3 if i % 10 else 0], i % 5) for i in range(4000)]
    out = batching.navigation(spark.createDataFrame(rows, "path string, title string, nav_group string, nav_order int").repartition(3))
    assert "__range" in out._jdf.queryExecution().analyzed().toString()
    got = {r.path: (r.nav_group, r.place) for r in out.collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[3], r[1].lower(), r[1], r[0]))
        assert [got[r[0]] for r in own] == [(g, n) for n in range(1, len(own) + 1)]
