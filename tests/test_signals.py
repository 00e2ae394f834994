from pyspark.sql import functions as F

from siltstone.functions.text import kebab_case
from siltstone.operators import batching, signals

SCHEMA = "file_path string, sym_ordinal int, id string, parent_id string, name string, kind string, exported boolean, extends string, decorators array<string>, parameters array<string>, summary string, type_annotation string, module_doc string"


def row(path, n, name, kind, exported=True, extends=None, decorators=None, parameters=None, summary=None, parent=None, type_=None, doc=None):
    return (path, n, f"{path}#{name}", parent, name, kind, exported, extends, decorators, parameters, summary, type_, doc)


def test_signals(spark):
    rows = [
        row("src/cli/commands/a.ts", 1, "registerSyncAPICommand", "function", parameters=["opts", "dir"], doc="Tool CLI — sync\nRuns it.\n All of it."),
        row("src/cli/commands/a.ts", 2, "helper", "function"),
        row("src/cli/flows/index.ts", 1, "runCmd", "function"),
        row("src/cli/index.ts", 1, "runCmd", "function", parameters=["args"], summary="Says."),
        row("routes/u.ts", 1, "getUserById", "function"),
        row("routes/u.ts", 2, "List", "function", decorators=["@app.Delete('/x')"]),
        row("routes/u.ts", 3, "other", "function"),
        row("config.ts", 1, "Opts", "interface"),
        row("config.ts", 2, "depth", "property", parent="config.ts#Opts", type_="number"),
        row("config.ts", 3, "bare", "property", parent="config.ts#Opts"),
        row("x.py", 1, "Lost", "class", extends="IOError"),
        row("x.py", 2, "BadException", "class", exported=False),
        row("v.tsx", 1, "Card", "function", parameters=["a", "b"]),
        row("v.tsx", 2, "card", "function"),
        row(None, None, None, None, None),
    ]
    got = signals.all_signals(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r)[:1] + tuple(r)[1:2] + tuple(r)[3:] for r in got} == {
        ("command", "src/cli/commands/a.ts", "sync-api", "dir", "Runs it. All of it."),
        ("command", "src/cli/index.ts", "run", None, "Says."),
        ("route", "routes/u.ts", "/user/by/id", "GET", None),
        ("route", "routes/u.ts", "/list", "DELETE", None),
        ("option", "config.ts", "Opts.depth", "number", None),
        ("error", "x.py", "Lost", "IOError", None),
        ("error", "x.py", "BadException", None, None),
        ("component", "v.tsx", "Card", "a,b", None),
    }
    assert signals.all_signals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signals_are_counted_in_one_pass(spark):
    rows = [row(f"{p}{i}.ts", i, n, k, extends=e) for i, (p, n, k, e) in enumerate([("bin/", "aCmd", "function", None), ("x/cmd/", "Command", "variable", None), ("api/routes/", "getX", "function", None), ("a/", "LostError", "class", None), ("views/", "V", "class", "MyError"), (None, "get", None, None)])]
    rows += [row("config.ts", 1, "Opts", "type"), row("config.ts", 2, "depth", "property", parent="config.ts#Opts", type_="number")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = signals.counts(df)
    scans = got._jdf.queryExecution().executedPlan().toString().count("ExistingRDD")
    assert {tuple(r) for r in got.collect()} == {("command", 2), ("route", 1), ("error", 2), ("component", 1), ("option", 1)}
    assert {tuple(r) for r in signals.all_signals(df).groupBy("signal").count().collect()} == {tuple(r) for r in got.collect()}
    assert scans == 3 and signals.counts(df.limit(0)).count() == 0
    paths = ["src/cli/index.ts", "CLI/a/Main.js", "cli/index.tsx", "cli/flows/index.ts", "xindex.ts", "cli/xindex.ts", "a\ncli/index.js", "cli/index.ts\n"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(signals.is_cli(F.col("p"))).collect()] == [True, True, False, False, False, False, True, False]


def test_kebab_case(spark):
    names = ["listAPIKeys", "ciSetup", "v2Api", "a_b"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(kebab_case(F.col("n"))).collect()] == ["list-api-keys", "ci-setup", "v2api", "a_b"]


def test_wave_plan(spark):
    rows = spark.createDataFrame([("g", i) for i in range(9)] + [("h", 0)], "g string, i int")
    got = sorted((r.g, r.i, r.wave, r.slot) for r in batching.wave_plan(rows, "g", "i", [2, 0, 1]).collect())
    assert [x[2:] for x in got] == [(0, 0), (0, 0), (0, 2), (1, 0), (1, 0), (1, 2), (2, 0), (2, 0), (2, 2), (0, 0)]
