"""A made-up code base from the driver's tables: modules, commits and tags from orders, symbols and imports from lineitem.

Each column is one expression that Spark and DuckDB both read, so that the queries and the SQL that checks them start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.registry import read

FOLDER = "CASE {k} % 8 WHEN 0 THEN 'src/cli' WHEN 1 THEN 'src/services' WHEN 2 THEN 'packages/core/src' WHEN 3 THEN 'docs/guide' WHEN 4 THEN 'src/components/ui/deep/er' WHEN 5 THEN 'lib' WHEN 6 THEN 'tests/unit' ELSE 'packages/web/src/routes' END"
BASE = "CASE {k} % 11 WHEN 0 THEN 'index' WHEN 1 THEN 'config' WHEN 2 THEN 'userService' WHEN 3 THEN 'types' WHEN 4 THEN 'README' WHEN 5 THEN 'main' ELSE 'mod' END"
ENDING = "CASE {k} % 13 WHEN 0 THEN '.tsx' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.json' WHEN 4 THEN '.py' WHEN 5 THEN '.yml' ELSE '.ts' END"
STEM = f"CASE WHEN {{k}} % 11 IN (0, 4, 5) THEN concat({FOLDER}, '/p', {{k}}, '/', {BASE}) ELSE concat({FOLDER}, '/d', {{k}} % 17, '/', {BASE}, {{k}}) END"
PATH = f"concat({STEM}, {ENDING})"
LANGUAGE = "CASE {k} % 13 WHEN 1 THEN 'javascript' WHEN 2 THEN 'markdown' WHEN 3 THEN 'json' WHEN 4 THEN 'python' WHEN 5 THEN 'yaml' ELSE 'typescript' END"
#: Order and line alone name no row of lineitem.
ORDINAL = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"
KIND = "CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'type' WHEN 4 THEN 'constant' WHEN 5 THEN 'variable' ELSE 'enum' END"


def at(expression: str, k: str) -> str:
    return expression.replace("{k}", k)


TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "modules": ("orders", {
        "path": at(PATH, "o_orderkey"), "ordinal": "o_orderkey", "language": at(LANGUAGE, "o_orderkey"), "line_count": "(o_orderkey * 7919) % 700 + 1",
        "n_exports": "o_orderkey % 4", "n_reexports": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE 0 END",
    }),
    "symbols": ("lineitem", {
        "path": at(PATH, "l_orderkey"), "language": at(LANGUAGE, "l_orderkey"), "ordinal": ORDINAL, "kind": KIND, "exported": "l_returnflag <> 'N'",
        "name": "concat(CASE l_linenumber % 5 WHEN 0 THEN 'getUser' WHEN 1 THEN 'User' WHEN 2 THEN 'parse_it' WHEN 3 THEN 'MAX_' ELSE 'postItemCommand' END, l_suppkey, CASE WHEN l_quantity < 4 THEN 'Error' ELSE '' END)",
        "summary": "CASE WHEN l_quantity < 10 THEN '' WHEN l_quantity < 20 THEN NULL ELSE concat('Runs the command of ', l_suppkey) END",
        "returns": "CASE WHEN l_quantity < 15 THEN 'any' WHEN l_quantity < 30 THEN NULL ELSE 'string' END", "signature": "CASE WHEN l_discount < 0.05 THEN 'f()' ELSE 'f(): x' END",
        "extends": "CASE WHEN l_tax < 0.02 THEN concat('User', l_suppkey % 7) ELSE NULL END", "visibility": "CASE WHEN l_linestatus = 'O' THEN 'public' ELSE 'private' END",
        "id": "concat(l_orderkey, ':', l_linenumber)", "parent_id": "CASE WHEN l_linenumber > 3 THEN concat(l_orderkey, ':', l_linenumber - 3) ELSE NULL END",
        "type_annotation": "CASE WHEN l_quantity > 40 THEN 'number' ELSE NULL END", "param": "CASE WHEN l_suppkey % 3 = 0 THEN 'options' ELSE concat('p', l_suppkey) END", "param_type": "CASE WHEN l_extendedprice < 30000 THEN 'any' ELSE 'string' END",
    }),
    "imports": ("lineitem", {
        "src": at(PATH, "l_orderkey"), "import_ordinal": ORDINAL, "type_only": "l_returnflag = 'A'",
        "source": "CASE l_linenumber % 6 "
        + f"WHEN 0 THEN concat('./', {at(BASE, '(l_orderkey + 136)')}, l_orderkey + 136, CASE WHEN l_suppkey % 2 = 0 THEN '.js' ELSE '' END) "
        + f"WHEN 1 THEN concat('../d', (l_orderkey + 8) % 17, '/', {at(BASE, '(l_orderkey + 8)')}, l_orderkey + 8) "
        + "WHEN 2 THEN concat('@/', CASE l_suppkey % 3 WHEN 0 THEN 'services/p' WHEN 1 THEN 'cli/p' ELSE 'components/p' END, l_suppkey) "
        + f"WHEN 3 THEN CASE WHEN l_suppkey % 5 = 0 THEN '@org/core' ELSE concat('@org/core/d', (l_suppkey * 8 + 2) % 17, '/', {at(BASE, '(l_suppkey * 8 + 2)')}, l_suppkey * 8 + 2) END "
        + "WHEN 4 THEN concat('lib', l_suppkey % 9, '/sub') ELSE concat('@scope/pkg', l_suppkey % 5, '/x') END",
    }),
    "packages": ("region", {"name": "CASE r_regionkey WHEN 0 THEN '@org/core' WHEN 1 THEN '@org/web' ELSE concat('@org/none', r_regionkey) END", "dir": "CASE r_regionkey WHEN 0 THEN 'packages/core' WHEN 1 THEN 'packages/web' ELSE 'packages/none' END", "package_ordinal": "r_regionkey"}),
    "commits": ("orders", {
        "repo": "concat('r', o_custkey % 40)", "hash": "concat('h', o_orderkey)", "ordinal": "o_orderkey",
        "message": "concat(CASE o_orderkey % 9 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(core): ' WHEN 2 THEN 'docs: ' WHEN 3 THEN 'feat!: ' WHEN 4 THEN 'chore: ' WHEN 5 THEN 'ci:' WHEN 6 THEN 'perf(x y):  ' ELSE 'other words: ' END, o_orderstatus, o_orderkey)",
    }),
    "tags": ("orders", {"repo": "concat('r', o_custkey % 40)", "ordinal": "o_orderkey", "tag": "CASE WHEN o_orderkey % 50 = 7 THEN concat('v', o_orderkey % 7, '.', o_orderkey) WHEN o_orderkey % 50 = 9 THEN concat('nightly', o_orderkey) ELSE NULL END"}),
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return read(spark, d, source).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """WITH clause parts of these tables in SQL."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names)
