"""Facts and predicates of modules (path, ordinal, language, line_count), their symbols (path, name, kind, exported, summary, ordinal), imports (path, source, type_only) and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.shared import cut

#: Files without a page of their own, by name and by ending.
NO_PAGE_NAMES = (
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "tsconfig.node.json", "tsconfig.preload.json",
    "postcss.config.js", "tailwind.config.ts", "tailwind.config.js", "vite.config.ts", "vite.config.js", "eslint.config.js", ".eslintrc.js",
    "jest.config.ts", "vitest.config.ts", "electron-builder-update.yml", "manifest.json", "pyproject.toml",
)
NO_PAGE_ENDINGS = (".json", ".yaml", ".yml", ".toml", ".lock", ".sh", ".bash", ".zsh")
#: Package managers in order of precedence: id, name, files that tell, endings that tell, whether these only count without JavaScript.
MANAGERS = (
    ("go", "Go", ("go.mod",), (".go",), True),
    ("cargo", "Cargo", ("Cargo.toml",), (".rs",), True),
    ("poetry", "Poetry", ("pyproject.toml",), (), True),
    ("pip", "pip", ("requirements.txt",), (".py",), True),
    ("bundler", "Bundler", ("Gemfile",), (".rb",), True),
    ("npm", "npm", ("package.json",), (".js", ".ts", ".jsx", ".tsx"), False),
    ("make", "Make", ("Makefile",), (), False),
    ("terraform", "terraform", (), (".tf", ".hcl"), False),
)
#: Commands by package manager.
INSTALL = {
    "npm": "npm install", "yarn": "yarn install", "pnpm": "pnpm install", "go": "go mod download", "pip": "pip install -r requirements.txt", "poetry": "poetry install",
    "cargo": "cargo build", "bundler": "bundle install", "make": "make", "terraform": "terraform init", "generic": "# See project README for setup instructions",
}
RUN = {"yarn": "yarn", "pnpm": "pnpm", "go": "go run .", "pip": "python", "cargo": "cargo run"}
#: Points of a module by what its file name has, all that fit summed.
NAME_POINTS = (
    (r"^(index|main|app|server)\.[^/]+$", 12), (r"model|entity|schema|types", 10), ("config", 8), (r"service|controller|manager|handler", 6), (r"store|state|context", 8),
    (r"hook|composable", 6), (r"component|widget|view|page", 5), (r"util|helper|lib", 4), (r"middleware|interceptor|guard", 5), (r"factory|builder|provider", 6), (r"route|endpoint|api", 3),
)
#: And by what its path has.
PATH_POINTS = (
    (r"\.(test|spec|mock|fixture)\.[^/]+$", -30), (r"__(tests|mocks|fixtures|snapshots)__", -30), (r"\.d\.ts$", -15), (r"generated|dist/|\.min\.", -20), (r"migration|seed", -10),
    (r"\.lock|\.config\.[^/]+$", -10), (r"\b(docs_src|examples?|samples?|tutorials?|snippets?|demos?)\b", -25), (r"\b(vendor|third[_-]?party|external|node_modules)\b", -20),
)
#: Kinds of symbols that count in a score: the most that count, and points for each.
KIND_POINTS = ((("class",), 3, 15), (("interface",), 4, 12), (("function",), 5, 4), (("type", "enum"), 5, 3))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def has_page(path: Column, line_count: Column, n_symbols: Column, n_exported: Column, n_exports: Column, n_reexports: Column) -> Column:
    """Whether a module gets a page: no settings, lock or shell file, no shallow markdown, no small file without exported symbols, no mere re-export."""
    base = F.lower(base_name(path))
    ending = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    shallow = (ending == ".md") & ((depth(path) <= 2) | path.contains("docs/plans/"))
    barrel = (line_count <= 10) & (n_exported == 0)
    passed_on = (n_exports > 0) & (n_reexports == n_exports) & (n_symbols == 0)
    return ~(base.isin(*NO_PAGE_NAMES) | ending.isin(*NO_PAGE_ENDINGS) | shallow | barrel | passed_on)


def is_config_file(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(r"config|settings|schema|\.rc\.[^.]+$")


def is_entry_point(path: Column) -> Column:
    return path.rlike(r"index\.|main\.|app\.")


def is_version_tag(tag: Column, pattern: str = r"^v?\d+\.\d+") -> Column:
    return tag.rlike(pattern)


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(path, n_symbols, n_exported) and what showcase_score() needs, in one pass over the symbols."""
    of = lambda kinds: F.count_if(F.col("exported") & F.col("kind").isin(*kinds)).alias(f"n_{kinds[0]}")
    told = F.col("exported") & (F.coalesce("summary", F.lit("")) != "")
    return symbols.groupBy("path").agg(
        F.count("*").alias("n_symbols"), F.count_if("exported").alias("n_exported"), *(of(k) for k, _, _ in KIND_POINTS),
        F.count_distinct(F.when(F.col("exported"), F.col("kind"))).alias("n_kinds"), F.count_if(told).alias("n_documented"),
    )


def with_counts(modules: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """modules with symbol_counts() and n_imports; nulls are zero."""
    counts = symbol_counts(symbols).join(imports.groupBy("path").agg(F.count("*").alias("n_imports")), "path", "full_outer")
    out = modules.join(counts, "path", "left")
    return out.fillna(0, [c for c in counts.columns if c != "path"])


def showcase_score(rows: DataFrame) -> Column:
    """How well a module of with_counts() shows off a code base: its exported kinds, its name, size, depth and imports."""
    path, base, lines = F.lower("path"), F.lower(base_name(F.col("path"))), rows["line_count"]
    points = [F.least(F.col(f"n_{k[0]}"), F.lit(most)) * each for k, most, each in KIND_POINTS]
    points += [(F.col("n_kinds") - 1) * 8, F.least(F.col("n_documented"), F.lit(8)) * 3, F.least(F.col("n_imports"), F.lit(8))]
    points += [F.when(base.rlike(p), n).otherwise(0) for p, n in NAME_POINTS] + [F.when(path.rlike(p), n).otherwise(0) for p, n in PATH_POINTS]
    points += [F.when(lines.between(80, 400), 5).when(lines.between(50, 600), 3).otherwise(0), F.when(lines < 15, -10).otherwise(0)]
    folders = depth(F.col("path")) - 1
    points.append(F.when(folders <= 2, 6).when(folders >= 4, -3).otherwise(0))
    return reduce(Column.__add__, points).cast("bigint")


def package_manager(modules: DataFrame) -> DataFrame:
    """One row (id, name): the first manager that the paths tell of; generic if none does."""
    path = F.col("path")
    named = lambda names: reduce(Column.__or__, [(path == n) | path.endswith("/" + n) for n in names], F.lit(False))
    ends = lambda names: reduce(Column.__or__, [path.endswith(n) for n in names], F.lit(False))
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    facts = modules.agg(*(c for i, _, files, endings, _ in MANAGERS for c in (some(named(files), f"{i}_f"), some(ends(endings), f"{i}_e"))))
    out = None
    for i, name, _, _, alone in MANAGERS:
        hit = F.col(f"{i}_f") | (F.col(f"{i}_e") & (~F.col("npm_e") if alone else F.lit(True)))
        told = F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"))
        out = out.when(hit, told) if out is not None else F.when(hit, told)
    return facts.select(out.otherwise(F.struct(F.lit("generic").alias("id"), F.lit("generic").alias("name"))).alias("m")).select("m.*")


def commands(managers: DataFrame) -> DataFrame:
    """Adds install and run to (id, ...)."""
    pick = lambda table, other: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("id")], F.lit(other))
    return managers.withColumns({"install": pick(INSTALL, "npm install"), "run": pick(RUN, "npm run")})


def project_type(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row (project_type, export_ratio): application by its folders, library if over half of its symbols are exported."""
    path = F.col("path")
    has = lambda *parts: F.coalesce(F.bool_or(reduce(Column.__or__, [path.contains(p) for p in parts])), F.lit(False))
    facts = modules.agg(has("pages/", "app/", "electron", "main.ts", "main.js").alias("app"), has("bin/", "cli/").alias("bin"))
    share = symbols.agg((F.count_if("exported") / F.nullif(F.count("*"), F.lit(0))).alias("r"))
    kind = F.when(F.col("app"), "application").when(F.col("r") > 0.5, "library").when(F.col("bin"), "application").otherwise("unknown")
    return facts.crossJoin(F.broadcast(share)).select(kind.alias("project_type"), F.round(F.coalesce("r", F.lit(0.0)), 6).alias("export_ratio"))


def readme(modules: DataFrame, last: bool = True) -> DataFrame:
    """One row (path): the last module whose path has readme, or the first one named readme.md; no row if there is none."""
    rows = modules.where(F.lower("path").contains("readme") if last else F.lower(base_name(F.col("path"))) == "readme.md")
    pick = F.max_by("path", "ordinal") if last else F.min_by("path", "ordinal")
    return rows.agg(pick.alias("path")).where("path is not null")


def language_stats(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, files, symbols, lines, percent)."""
    counts = symbols.groupBy("path").agg(F.count("*").alias("n"))
    by = modules.join(counts, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("symbols"), F.sum("line_count").cast("bigint").alias("lines"))
    return share(by, "files")


def share(counts: DataFrame, n: str) -> DataFrame:
    """Adds percent: of the sum of n, rounded half up."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("all_")))).withColumn("percent", F.floor(F.col(n) * 100.0 / F.col("all_") + 0.5)).drop("all_")


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def external_imports(imports: DataFrame) -> DataFrame:
    """(package, n_modules, type_only, category): packages of sources that are no paths; dev if only types are imported."""
    from siltstone.functions.text import package_name

    far = imports.where(~F.col("source").startswith(".") & ~F.col("source").startswith("/"))
    rows = package_usage(far.select(package_name(F.col("source")).alias("package"), "path", "type_only"))
    return rows.withColumn("category", F.when(F.col("type_only"), "dev").otherwise("runtime"))


def package_usage(imports: DataFrame) -> DataFrame:
    """(package, n_modules, type_only) of imports (package, path, type_only): how many modules use a package, and whether all do for types alone."""
    return imports.groupBy("package").agg(F.count_distinct("path").alias("n_modules"), F.every("type_only").alias("type_only"))


def directory_counts(paths: DataFrame, path: Column, depth: int = 3) -> DataFrame:
    """(dir, n): rows by each beginning of their path, of depth segments at most."""
    each = paths.select(F.split(path, "/").alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(depth)))).alias("k"))
    return each.groupBy(F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("dir")).agg(F.count("*").alias("n"))


def text_totals(texts: DataFrame, by: list[str], size: str, text: str) -> DataFrame:
    """(by..., files, chars, lines) of texts."""
    from siltstone.functions.text import line_count

    return texts.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("chars"), F.sum(line_count(F.col(text))).alias("lines"))


def repeated_texts(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(content_hash, n, first_id) of texts that occur more than once; counted before the shuffle, so a frequent one is a row a task."""
    from siltstone.functions.text import content_hash

    return texts.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def cluster_sizes(modules: DataFrame, symbols: DataFrame, shown: int = 3) -> DataFrame:
    """(cluster, files, symbols, key_exports): folders of modules, with the names of their first exported symbols."""
    from siltstone.functions.text import directory_cluster

    own = modules.select("path", F.col("ordinal").alias("at"), directory_cluster(F.col("path")).alias("cluster"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("at", "ordinal"))
    first = symbols.where("exported").select("path", "name", "ordinal").join(own, "path").withColumn("place", place).where(F.col("place") <= shown)
    names = first.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("key_exports"))
    rows = own.join(symbols.groupBy("path").agg(F.count("*").alias("n")), "path", "left")
    counts = rows.groupBy("cluster").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("symbols"))
    return counts.join(names, "cluster", "left").withColumn("key_exports", F.coalesce("key_exports", F.lit("")))


def with_degrees(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """modules with n_in, n_out and degree of edges (src, dst, ordinal) between paths; nulls are zero."""
    from siltstone.operators.graph import degrees

    return modules.join(degrees(edges).withColumnRenamed("node", "path").drop("first_seen"), "path", "left").fillna(0, ["n_in", "n_out", "degree"])


def related_files(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, source, related): for local sources the first module whose path ends with the source and .ts or .js, or is the source.

    What a path must end with is told once for each distinct source. A module is only cut to the lengths that are asked for by its own file name, and
    its file name to the lengths of sources without a folder, which may end within it; an ending has one answer, the first module's, before any source meets it.
    """
    source = F.regexp_replace(F.regexp_replace("source", r"^\./", ""), "^@/", "src/")
    local = imports.where(F.col("source").startswith(".") | F.col("source").startswith("@/")).select("path", "source", source.alias("s"))
    local = cut(local)
    sources = local.select("s").distinct()
    wanted = sources.select("s", F.explode(F.array(F.concat("s", F.lit(".ts")), F.concat("s", F.lit(".js")))).alias("key")).withColumn("base", F.substring_index("key", "/", -1))
    files = modules.select(F.struct("ordinal", "path").alias("file"), F.substring_index("path", "/", -1).alias("base"))
    lengths = F.collect_set(F.length("key")).alias("lengths")  # no longer than the longest path
    asked = files.join(wanted.groupBy("base").agg(lengths), "base").select("file", F.explode("lengths").alias("length"))
    ends = asked.where(F.col("length") <= F.length("file.path")).select(F.expr("right(file.path, length)").alias("key"), "file")
    bare = wanted.where("key = base").agg(lengths)
    names = files.groupBy("base").agg(F.min("file").alias("file")).crossJoin(F.broadcast(bare)).select("base", "file", F.explode("lengths").alias("length"))  # bare is one row
    within = names.where(F.col("length") < F.length("base")).select(F.expr("right(base, length)").alias("key"), "file")
    first = ends.union(within).groupBy("key").agg(F.min("file").alias("file"))
    whole = sources.join(files, F.col("s") == F.col("file.path")).select("s", "file")
    found = wanted.join(first, "key").select("s", "file").union(whole).groupBy("s").agg(F.min("file").alias("file"))
    return local.join(found, "s").groupBy("path", "source").agg(F.min("file.path").alias("related"))
