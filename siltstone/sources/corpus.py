"""Scans of source trees: paths, sizes, languages, texts."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import content_hash, line_count

#: File extensions by language.
LANGUAGES = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi", "go": "go", "rust": "rs", "java": "java", "csharp": "cs", "ruby": "rb", "php": "php",
    "swift": "swift", "kotlin": "kt kts", "scala": "scala sc", "elixir": "ex exs", "dart": "dart", "lua": "lua", "zig": "zig", "haskell": "hs lhs", "c": "c h",
    "cpp": "cpp cxx cc hpp hxx", "yaml": "yaml yml", "shell": "sh bash zsh", "hcl": "tf hcl", "sql": "sql", "markdown": "md mdx", "dockerfile": "dockerfile", "toml": "toml", "json": "json", "xml": "xml",
}
MAX_FILE_SIZE = 500_000
#: How languages are shown; others as they are.
DISPLAY = {
    "typescript": "TypeScript", "javascript": "JavaScript", "python": "Python", "go": "Go", "rust": "Rust", "java": "Java", "csharp": "C#", "ruby": "Ruby", "php": "PHP",
    "swift": "Swift", "kotlin": "Kotlin", "scala": "Scala", "elixir": "Elixir", "dart": "Dart", "lua": "Lua", "zig": "Zig", "haskell": "Haskell", "c": "C",
    "cpp": "C++", "yaml": "YAML", "shell": "Shell", "hcl": "HCL", "sql": "SQL", "markdown": "Markdown", "dockerfile": "Dockerfile", "toml": "TOML", "json": "JSON", "xml": "XML",
}
#: What is scanned and what isn't unless told otherwise.
INCLUDE = [f"**/*.{e}" for e in "ts tsx js jsx py pyi go rs java cs rb php sh bash yaml yml tf hcl md json toml xml sql dockerfile c h cpp hpp cc cxx swift kt kts scala".split()] + ["**/Dockerfile"]
EXCLUDE = [
    "node_modules/**", "dist/**", "build/**", "out/**", ".git/**", ".next/**", ".nuxt/**", ".output/**", "vendor/**", "__pycache__/**", "venv/**", ".venv/**", "env/**", "target/**",
    "**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/test/**", "**/tests/**", "coverage/**", "site/**", "**/*.d.ts", "**/*.min.js", "**/migrations/**",
]
#: Folders that a count of source files leaves out, and the languages that have no place in it.
SKIPPED_FOLDERS = ["node_modules", "dist", "build", "out", ".git", ".next", "vendor", "__pycache__", "venv", ".venv", "target", "coverage", "site", "test", "tests", "__tests__"]


def language(path: Column) -> Column:
    """By Dockerfile's name, else by what follows the last dot of the path, lower-cased; null if unknown."""
    name, dot = F.element_at(F.split(path, "/"), -1), F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    kv = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile").otherwise(F.create_map(*kv)[dot])


def glob_regex(glob: str) -> str:
    """A path pattern (** over folders, * and ? within one, {a,b}) as a regular expression."""
    out, depth = "", 0
    for t in re.findall(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+", glob):
        if t == "{":
            out, depth = out + "(?:", depth + 1
        elif t == "}":
            out, depth = out + ")", depth - 1
        else:
            out += {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or ("|" if t == "," and depth else re.escape(t))
    return f"^{out}$"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """(path, length, language, text, line_count, content_hash) of files under root: size and path are tested before contents are read; no dot files."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    own = files.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base), ""))
    own = own.where(wanted(F.col("path"), include, exclude))
    text = F.expr("make_valid_utf8(cast(content AS STRING))")
    rows = own.withColumn("language", language(F.col("path"))).where("language is not null").withColumn("text", text)
    return rows.select("path", "length", "language", "text", line_count(F.col("text")).alias("line_count"), content_hash(F.col("text")).alias("content_hash"))


def supported_extensions() -> list[str]:
    return [f".{e}" for x in LANGUAGES.values() for e in x.split()]


def display_name(language: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in DISPLAY.items() for x in kv))[language], language)


def wanted(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a scan with these patterns (default: INCLUDE and EXCLUDE) takes a path; dot files never."""
    include, exclude = INCLUDE if include is None else include, EXCLUDE if exclude is None else exclude
    some = lambda globs: path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
    return some(include) & ~some(exclude) & ~path.rlike(r"(^|/)\.")


def validate_paths(paths: DataFrame, scanned: DataFrame) -> DataFrame:
    """Those of paths (path) that a scan also gives."""
    return paths.join(scanned.select("path").distinct(), "path", "left_semi")


def extension_histogram(files: DataFrame, most: int = 10) -> DataFrame:
    """(extension, n): the commonest endings of file names, lower-cased, with their dot; empty without one or for a leading dot."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)).alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(most)


#: Endings that count as source in a tree; what follows the last dot, or a whole path without one.
TREE_ENDINGS = [
    "ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "rb", "php",
    "cs", "c", "h", "cpp", "hpp", "cc", "cxx", "swift", "kt", "kts", "scala",
    "sh", "bash", "yaml", "yml", "tf", "hcl", "md", "json", "toml", "xml",
    "sql", "dockerfile",
]


def tree_counts(entries: DataFrame) -> DataFrame:
    """One row (total, source) of entries (path, type): files, and files of TREE_ENDINGS outside of SKIPPED_FOLDERS."""
    parts = F.split("path", "/")
    known = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(TREE_ENDINGS) | (F.lower(F.element_at(parts, -1)) == "dockerfile")
    source = known & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return entries.where("type = 'blob'").agg(F.count("*").alias("total"), F.count_if(source).alias("source"))


def package_facts(files: DataFrame, manifest: str = "package.json") -> DataFrame:
    """(name, description) of the manifest at the root of files (path, text); nulls where it isn't JSON; no row without one."""
    told = F.from_json("text", "name string, description string")
    return files.where(F.col("path") == manifest).select(told.alias("t")).select("t.name", "t.description")


def workspaces(files: DataFrame) -> DataFrame:
    """(name, dir, package_ordinal, type): packages of a work space in files (path, text).

    Patterns come from the root's package.json (workspaces, or its packages), else pnpm-workspace.yaml, else lerna.json (packages, or
    packages/*): the first of these for which any package.json is found that matches and has a name. Patterns are few and read to the driver;
    package files are matched where they are. Of packages of one name the last counts, in the first one's place.
    """
    names = ("package.json", "pnpm-workspace.yaml", "lerna.json")
    root = {r.path: r.text or "" for r in files.where(F.col("path").isin(*names)).select("path", "text").collect()}
    manifests = files.where(((F.element_at(F.split("path", "/"), -1)) == "package.json") & ~F.col("path").rlike(r"(^|/)node_modules/"))
    own = manifests.select("path", F.get_json_object("text", "$.name").alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).where("name <> ''")

    def json_of(name: str) -> dict:
        try:
            found = json.loads(root.get(name, ""))
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    told = json_of(names[0]).get("workspaces") or []
    yaml = re.search(r"packages:\s*\n((?:\s+-\s+.+\n?)*)", root.get(names[1], ""))
    listed = [re.sub(r"""['"]?\s*$""", "", re.sub(r"""^\s*-\s*['"]?""", "", x)) for x in (yaml[1].split("\n") if yaml else [])]
    ways = [("npm", told.get("packages") or [] if isinstance(told, dict) else told), ("pnpm", [x for x in listed if x]), ("lerna", json_of(names[2]).get("packages") or ["packages/*"] if names[2] in root else [])]
    for kind, globs in ways:
        globs = [g for g in globs if isinstance(g, str)]
        if not globs:
            continue
        rows = own.where(F.col("path").rlike("|".join(glob_regex(f"{g.rstrip('/').removeprefix('./')}/package.json") for g in globs)))
        found = rows.groupBy("name").agg(F.max("dir").alias("dir"), F.min("dir").alias("o"))
        if not found.isEmpty():
            return found.select("name", "dir", F.row_number().over(Window.orderBy("o")).alias("package_ordinal"), F.lit(kind).alias("type"))
    return files.sparkSession.createDataFrame([], "name string, dir string, package_ordinal int, type string")


def log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(hash, author, date, message, ordinal) of exported log lines "hash<tab>author<tab>date<tab>message", newest first; lines has ordinal. Others are left out."""
    p = F.split(F.col(line), "\t", 4)
    return lines.where(F.size(p) == 4).select(p[0].alias("hash"), p[1].alias("author"), p[2].alias("date"), p[3].alias("message"), "ordinal")


def write_snapshot(tables: dict[str, DataFrame], root: str, commit: str) -> None:
    """Tables of an analysis under root/snapshots/commit, then the state row that points to it: readers see a whole snapshot or the one before."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/snapshots/{commit}/{name}")
    state = spark.createDataFrame([(commit, ",".join(sorted(tables)))], "commit string, tables string").withColumn("at", F.current_timestamp())
    state.coalesce(1).write.mode("append").parquet(f"{root}/state")


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """Tables of the latest whole snapshot; None if there is none, or a table cannot be read."""
    try:
        last = spark.read.parquet(f"{root}/state").orderBy(F.desc("at")).first()
        return {t: spark.read.parquet(f"{root}/snapshots/{last.commit}/{t}") for t in last.tables.split(",")} if last else None
    except AnalysisException:
        return None
