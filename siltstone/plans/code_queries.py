"""Queries over the made-up code base, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import batching, context, graph, maintain, modules, resolve, rules, signals, validate
from siltstone.operators.shared import cut, placed
from siltstone.plans.code_tables import cte, table
from siltstone.registry import query, read
from siltstone.sources import corpus


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_LOW = "lower(regexp_extract(path, '[^/]*$'))"
_END = f"regexp_extract({_LOW}, '\\.[^.]*$')"
_COUNTS = """s AS (SELECT path, count(*) AS n_symbols, count(*) FILTER (exported) AS n_exported, count(*) FILTER (exported AND kind = 'class') AS n_class, count(*) FILTER (exported AND kind = 'interface') AS n_interface,
    count(*) FILTER (exported AND kind = 'function') AS n_function, count(*) FILTER (exported AND kind IN ('type', 'enum')) AS n_type, count(DISTINCT kind) FILTER (exported) AS n_kinds,
    count(*) FILTER (exported AND coalesce(summary, '') <> '') AS n_documented FROM symbols GROUP BY path),
    i AS (SELECT src AS path, count(*) AS n_imports FROM imports GROUP BY src),
    f AS (SELECT m.*, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_exported, 0) AS n_exported, coalesce(n_class, 0) AS n_class, coalesce(n_interface, 0) AS n_interface, coalesce(n_function, 0) AS n_function,
    coalesce(n_type, 0) AS n_type, coalesce(n_kinds, 0) AS n_kinds, coalesce(n_documented, 0) AS n_documented, coalesce(n_imports, 0) AS n_imports FROM modules m LEFT JOIN s USING (path) LEFT JOIN i USING (path))"""


def _counted(spark, d):
    return modules.with_counts(table(spark, d, "modules"), table(spark, d, "symbols"), table(spark, d, "imports").withColumnRenamed("src", "path"))


@query(f"""WITH {cte("modules", "symbols", "imports")}, {_COUNTS} SELECT path,
    NOT ({_LOW} IN ({_strings(modules.NO_PAGE_NAMES)}) OR {_END} IN ({_strings(modules.NO_PAGE_ENDINGS)}) OR ({_END} = '.md' AND (len(string_split(path, '/')) <= 2 OR contains(path, 'docs/plans/')))
    OR (line_count <= 10 AND n_exported = 0) OR (n_exports > 0 AND n_reexports = n_exports AND n_symbols = 0)) AS has_page,
    regexp_matches({_LOW}, 'config|settings|schema|\\.(config|rc)\\.[^.]+$') AS config_file, contains(path, 'index.') OR contains(path, 'main.') OR contains(path, 'app.') AS entry_point FROM f""")
def module_predicates(spark, d):
    c, p = F.col, F.col("path")
    return _counted(spark, d).select("path", modules.has_page(p, c("line_count"), c("n_symbols"), c("n_exported"), c("n_exports"), c("n_reexports")).alias("has_page"), modules.is_config_file(p).alias("config_file"), modules.is_entry_point(p).alias("entry_point"))


_NAMED = " + ".join(f"CASE WHEN regexp_matches({_LOW}, '{p}') THEN {n} ELSE 0 END" for p, n in modules.NAME_POINTS)
_PATHED = " + ".join(f"CASE WHEN regexp_matches(lower(path), '{p}') THEN {n} ELSE 0 END" for p, n in modules.PATH_POINTS)


@query(f"""WITH {cte("modules", "symbols", "imports")}, {_COUNTS} SELECT path, (least(n_class, 3) * 15 + least(n_interface, 4) * 12 + least(n_function, 5) * 4 + least(n_type, 5) * 3 + (n_kinds - 1) * 8 + least(n_documented, 8) * 3
    + least(n_imports, 8) + {_NAMED} + {_PATHED} + CASE WHEN line_count BETWEEN 80 AND 400 THEN 5 WHEN line_count BETWEEN 50 AND 600 THEN 3 ELSE 0 END - CASE WHEN line_count < 15 THEN 10 ELSE 0 END
    + CASE WHEN len(string_split(path, '/')) <= 3 THEN 6 WHEN len(string_split(path, '/')) >= 5 THEN -3 ELSE 0 END)::BIGINT AS score FROM f""")
def showcase_scores(spark, d):
    rows = _counted(spark, d)
    return rows.select("path", modules.showcase_score(rows).alias("score"))


@query(f"""WITH {cte("modules")}, f AS (SELECT bool_or(path LIKE '%.go') AS go, bool_or(path LIKE '%.rs') AS rs, bool_or(path LIKE '%.py') AS py, bool_or(path LIKE '%.rb') AS rb, bool_or(regexp_matches(path, '\\.(js|ts|jsx|tsx)$')) AS js FROM modules)
    SELECT CASE WHEN go AND NOT js THEN 'go' WHEN rs AND NOT js THEN 'cargo' WHEN py AND NOT js THEN 'pip' WHEN rb AND NOT js THEN 'bundler' WHEN js THEN 'npm' ELSE 'generic' END AS id, 'npm' AS name, 'npm install' AS install, 'npm run' AS run FROM f""")
def package_manager(spark, d):
    return modules.commands(modules.package_manager(table(spark, d, "modules")))


@query(f"""WITH {cte("modules", "symbols")}, a AS (SELECT bool_or(regexp_matches(path, 'pages/|app/|electron|main\\.ts|main\\.js')) AS app, bool_or(regexp_matches(path, 'bin/|cli/')) AS bin FROM modules),
    r AS (SELECT count(*) FILTER (exported) / count(*) AS r FROM symbols) SELECT CASE WHEN app THEN 'application' WHEN r > 0.5 THEN 'library' WHEN bin THEN 'application' ELSE 'unknown' END AS project_type, round(r, 6) AS export_ratio FROM a, r""")
def project_type(spark, d):
    return modules.project_type(table(spark, d, "modules"), table(spark, d, "symbols"))


@query(f"WITH {cte('modules')} SELECT 'last' AS which, arg_max(path, ordinal) AS path FROM modules WHERE contains(lower(path), 'readme') UNION ALL SELECT 'first', arg_min(path, ordinal) FROM modules WHERE {_LOW} = 'readme.md' HAVING count(*) > 0")
def readme_picks(spark, d):
    m = table(spark, d, "modules")
    return modules.readme(m).select(F.lit("last").alias("which"), "path").unionByName(modules.readme(m, last=False).select(F.lit("first").alias("which"), "path"))


@query(f"""WITH {cte("modules", "symbols")}, n AS (SELECT path, count(*) AS n FROM symbols GROUP BY path), g AS (SELECT language, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS symbols, sum(line_count)::BIGINT AS lines FROM modules LEFT JOIN n USING (path) GROUP BY language)
    SELECT *, floor(files * 100.0 / (SELECT sum(files) FROM g) + 0.5)::BIGINT AS percent FROM g""")
def language_stats(spark, d):
    return modules.language_stats(table(spark, d, "modules"), table(spark, d, "symbols"))


@query(f"WITH {cte('symbols')} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def kind_counts(spark, d):
    return modules.kind_counts(table(spark, d, "symbols"))


_PACKAGE = "CASE WHEN source LIKE '@%' AND contains(source, '/') THEN concat(split_part(source, '/', 1), '/', split_part(source, '/', 2)) ELSE split_part(source, '/', 1) END"


@query(f"""WITH {cte("imports")} SELECT {_PACKAGE} AS package, count(DISTINCT src) AS n_modules, bool_and(type_only) AS type_only, CASE WHEN bool_and(type_only) THEN 'dev' ELSE 'runtime' END AS category
    FROM imports WHERE NOT starts_with(source, '.') AND NOT starts_with(source, '/') GROUP BY 1""")
def external_packages(spark, d):
    return modules.external_imports(table(spark, d, "imports").withColumnRenamed("src", "path"))


_CLUSTER = "CASE WHEN len(string_split(path, '/')) > 2 THEN concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) ELSE split_part(path, '/', 1) END"


@query(f"""WITH {cte("modules", "symbols")}, m AS (SELECT path, ordinal AS pos, {_CLUSTER} AS cluster FROM modules), n AS (SELECT path, count(*) AS n FROM symbols GROUP BY path),
    k AS (SELECT cluster, string_agg(name, ', ' ORDER BY place) AS key_exports FROM (SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY pos, ordinal) AS place FROM symbols JOIN m USING (path) WHERE exported) WHERE place <= 3 GROUP BY cluster)
    SELECT cluster, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS symbols, coalesce(any_value(key_exports), '') AS key_exports FROM m LEFT JOIN n USING (path) LEFT JOIN k USING (cluster) GROUP BY cluster""")
def cluster_sizes(spark, d):
    return modules.cluster_sizes(table(spark, d, "modules"), table(spark, d, "symbols"))


_SUFFIXES = "['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']"
_RESOLVED = f"""{cte("modules", "imports", "packages")},
    j AS (SELECT *, CASE WHEN starts_with(source, '@/') THEN concat('src/', substr(source, 3)) WHEN starts_with(source, './') THEN concat(regexp_replace(src, '/[^/]*$', ''), substr(source, 2)) ELSE concat(regexp_replace(src, '/[^/]*/[^/]*$', ''), substr(source, 3)) END AS p FROM imports WHERE starts_with(source, '.') OR starts_with(source, '@/')),
    c AS (SELECT src, import_ordinal, b || unnest({_SUFFIXES}) AS path, 0 AS package_ordinal FROM (SELECT src, import_ordinal, unnest([p, regexp_replace(p, '\\.[mc]?js$', '')]) AS b FROM j)),
    w AS (SELECT src, import_ordinal, source, dir, name, package_ordinal FROM imports JOIN packages ON source = name OR starts_with(source, name || '/') WHERE NOT starts_with(source, '.') AND NOT starts_with(source, '@/')),
    wx AS (SELECT src, import_ordinal, CASE WHEN source = name THEN dir || e ELSE dir || '/src/' || substr(source, length(name) + 2) || e END AS path, package_ordinal FROM (SELECT *, unnest(CASE WHEN source = name
      THEN ['/src/index.ts', '/src/index.tsx', '/src/index.js', '/src/index.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/lib/index.ts', '/lib/index.js'] ELSE {_SUFFIXES}[2:] END) AS e FROM w)),
    g AS (SELECT src, import_ordinal, arg_min(path, package_ordinal * 1000000000000 + ordinal) AS dst FROM (SELECT * FROM c UNION ALL SELECT * FROM wx) JOIN modules USING (path) GROUP BY ALL)"""


def _graph_once(spark, d):
    """The graph as a checkpoint, for queries that read it more than once."""
    return cut(_graph(spark, d))


def _nodes(spark, d):
    return table(spark, d, "modules").select("path", F.col("ordinal").alias("node_ordinal"))


def _graph(spark, d):
    return resolve.build_graph(table(spark, d, "imports"), _nodes(spark, d), table(spark, d, "packages"))


@query(f"WITH {_RESOLVED} SELECT src, dst, type_only, import_ordinal AS ordinal FROM g JOIN imports USING (src, import_ordinal)")
def dependency_graph(spark, d):
    return _graph(spark, d)


@query(f"WITH {_RESOLVED} SELECT source, count(*) AS n FROM imports WHERE (src, import_ordinal) NOT IN (SELECT (src, import_ordinal) FROM g) GROUP BY source")
def external_sources(spark, d):
    return resolve.external_counts(table(spark, d, "imports"), _nodes(spark, d), table(spark, d, "packages"))


@query(f"""WITH {_RESOLVED}, e AS (SELECT src, dst FROM g), x AS (SELECT src AS path, 0 AS i FROM e UNION ALL SELECT dst, 1 FROM e), t AS (SELECT path, sum(i)::BIGINT AS n_in, sum(1 - i)::BIGINT AS n_out, count(*) AS degree FROM x GROUP BY path)
    SELECT path, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(degree, 0) AS degree FROM modules LEFT JOIN t USING (path)""")
def module_degrees(spark, d):
    return modules.with_degrees(table(spark, d, "modules").select("path"), _graph(spark, d))


@query(f"""WITH {_RESOLVED}, e AS (SELECT src, dst, import_ordinal AS o FROM g), x AS (SELECT dst AS node, src AS other, true AS up, o FROM e UNION ALL SELECT src, dst, false, o FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY node, up ORDER BY o, other) AS a, row_number() OVER (PARTITION BY node, up ORDER BY other, o) AS b FROM x)
    SELECT node, count(*) FILTER (up) AS n_in, count(*) FILTER (NOT up) AS n_out, coalesce(string_agg(other, ',' ORDER BY a) FILTER (up AND a <= 8), '') AS upstream, coalesce(string_agg(other, ',' ORDER BY a) FILTER (NOT up AND a <= 8), '') AS downstream,
    coalesce(string_agg(other, ',' ORDER BY b) FILTER (up AND b <= 8), '') AS referenced_by FROM r GROUP BY node""")
def neighbourhood(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return graph.neighbourhood(_graph_once(spark, d)).select("node", "n_in", "n_out", joined("upstream"), joined("downstream"), joined("referenced_by"))


@query(f"""WITH {cte("modules", "imports")}, l AS (SELECT DISTINCT src AS path, source, regexp_replace(regexp_replace(source, '^\\./', ''), '^@/', 'src/') AS s FROM imports WHERE starts_with(source, '.') OR starts_with(source, '@/')),
    b AS (SELECT *, unnest([regexp_extract(s, '[^/]*$') || '.ts', regexp_extract(s, '[^/]*$') || '.js', regexp_extract(s, '[^/]*$')]) AS base FROM l), m AS (SELECT path AS p, ordinal, regexp_extract(path, '[^/]*$') AS base FROM modules)
    SELECT path, source, arg_min(p, ordinal) AS related FROM b JOIN m USING (base) WHERE ends_with(p, s || '.ts') OR ends_with(p, s || '.js') OR p = s GROUP BY ALL""")
def related_files(spark, d):
    return modules.related_files(table(spark, d, "imports").withColumnRenamed("src", "path"), table(spark, d, "modules"))


@query(f"""WITH {cte("symbols")}, p AS (SELECT *, 'api/' || regexp_replace(path, '\\.[^.]+$', '') || '.md' AS page FROM symbols),
    t AS (SELECT name, arg_max(page, ordinal) AS type_page FROM p WHERE exported AND kind IN ('interface', 'type', 'class', 'enum') GROUP BY name)
    SELECT name, arg_min(page, CASE WHEN exported THEN ordinal ELSE ordinal + 4000000000000000000 END) AS page, any_value(type_page) AS type_page FROM p LEFT JOIN t USING (name) GROUP BY name""")
def symbol_pages(spark, d):
    s = table(spark, d, "symbols")
    return resolve.symbol_pages(s).join(resolve.type_pages(s).withColumnRenamed("page", "type_page"), "name", "left")


_TARGET = "(SELECT arg_min(dst, import_ordinal) FROM g)"
_SECTION = "CASE " + " ".join(f"WHEN list_has_any(string_split(lower({{p}}), '/'), [{_strings(v)}]) THEN '{k}'" for k, v in T.SECTIONS.items()) + " ELSE '' END"
_DIR = "regexp_replace({p}, '/[^/]*$', '')"


@query(f"""WITH {_RESOLVED}, t AS (SELECT {_TARGET} AS t), e AS (SELECT DISTINCT src, dst FROM g), a AS (SELECT dst AS n FROM e, t WHERE src = t), b AS (SELECT src AS n FROM e, t WHERE dst = t),
    two AS (SELECT dst AS n FROM e WHERE src IN (SELECT n FROM a) UNION SELECT src FROM e WHERE dst IN (SELECT n FROM b)), one AS (SELECT n FROM a UNION SELECT n FROM b),
    s AS (SELECT path, CASE WHEN path IN (SELECT n FROM one) THEN 1.0 WHEN path IN (SELECT n FROM two) THEN 0.6 WHEN {_DIR.replace("{p}", "path")} = {_DIR.replace("{p}", "t")} THEN 0.4
      WHEN {_SECTION.replace("{p}", "t")} <> '' AND {_SECTION.replace("{p}", "path")} = {_SECTION.replace("{p}", "t")} THEN 0.3 WHEN contains(lower(path), 'readme') OR contains(lower(path), 'doc') THEN 0.2 ELSE 0 END AS score FROM modules, t WHERE path <> t)
    SELECT path, score::DOUBLE AS score FROM s WHERE score > 0""")
def target_context(spark, d):
    e = _graph_once(spark, d)
    target = e.agg(F.min_by("dst", "ordinal")).first()[0]
    return context.target_scores(table(spark, d, "modules"), e, target).select("path", "score")


@query(f"""WITH {cte("modules", "symbols")}, n AS (SELECT DISTINCT path FROM symbols WHERE contains(lower(name), 'user1') OR contains(lower(name), 'services'))
    SELECT path, greatest(CASE WHEN contains(lower(path), 'user1') OR contains(lower(path), 'services') THEN 0.8 ELSE 0 END, CASE WHEN path IN (SELECT path FROM n) THEN 0.7 ELSE 0 END, CASE WHEN contains(lower(path), 'readme') THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM modules
    WHERE contains(lower(path), 'user1') OR contains(lower(path), 'services') OR path IN (SELECT path FROM n) OR contains(lower(path), 'readme')""")
def topic_context(spark, d):
    return context.topic_scores(table(spark, d, "modules"), table(spark, d, "symbols"), "User1 Services").select("path", "score")


@query(f"WITH {_RESOLVED}, x AS (SELECT src AS path FROM g UNION ALL SELECT dst FROM g) SELECT path, least(count(*) / 10, 1.0)::DOUBLE AS score FROM x GROUP BY path")
def connected_context(spark, d):
    return context.connection_scores(table(spark, d, "modules"), _graph(spark, d)).select("path", "score")


@query(f"""WITH {cte("symbols")} SELECT 'undocumented' AS rule, name AS subject, ordinal, CASE WHEN count(*) OVER () > 20 THEN 'warning' ELSE 'info' END AS severity FROM symbols WHERE exported AND coalesce(summary, '') = ''""")
def undocumented_exports(spark, d):
    return rules.undocumented(table(spark, d, "symbols").withColumnsRenamed({"summary": "doc_summary"}).withColumn("ai_summary", F.lit(None).cast("string")))


@query(f"""WITH {cte("modules", "symbols", "imports")}, {_COUNTS} SELECT 'oversized' AS rule, path AS subject, ordinal, CASE WHEN count(*) OVER () > 5 THEN 'warning' ELSE 'info' END AS severity FROM f
    WHERE (line_count > 500 OR n_symbols > 30) AND NOT regexp_matches(lower(path), 'config|schema|\\.(json|yaml|yml|toml|lock)$')""")
def oversized_modules(spark, d):
    return rules.oversized(_counted(spark, d))


@query(f"""WITH {_RESOLVED}, o AS (SELECT path, ordinal FROM modules WHERE path NOT IN (SELECT src FROM g UNION SELECT dst FROM g) AND NOT regexp_matches(lower(path), 'index\\.|main\\.|app\\.|utils|helpers|lib/|config|schema|\\.(json|yaml|yml|toml)$'))
    SELECT 'orphan' AS rule, path AS subject, ordinal, CASE WHEN count(*) OVER () > 5 THEN 'warning' ELSE 'info' END AS severity FROM o""")
def orphan_modules(spark, d):
    return rules.orphaned(table(spark, d, "modules").select(F.col("path").alias("node"), "ordinal"), _graph_once(spark, d))


@query(f"""WITH {cte("symbols")}, f AS (SELECT * FROM symbols WHERE language = 'typescript' AND exported AND kind = 'function'),
    u AS (SELECT name, ordinal FROM f WHERE returns = 'any' OR (returns IS NULL AND NOT contains(signature, ':')) UNION ALL SELECT name || '(' || param || ')', ordinal FROM f WHERE param_type = 'any')
    SELECT 'missing-types' AS rule, name AS subject, ordinal, CASE WHEN count(*) OVER () > 10 THEN 'warning' ELSE 'info' END AS severity FROM u""")
def missing_types(spark, d):
    return rules.missing_types(table(spark, d, "symbols").withColumn("parameters", F.array(F.struct(F.col("param").alias("name"), F.col("param_type").alias("type")))))


_STYLE = "CASE WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z][a-z0-9_]*$') THEN 'snake_case' END"


@query(f"""WITH {cte("symbols")}, n AS (SELECT {_STYLE} AS style, min(ordinal) AS ordinal, count(*) AS n FROM symbols WHERE exported AND ordinal % 4 < 3 GROUP BY 1), f AS (SELECT sum(n) AS exports, sum(n) FILTER (style IS NOT NULL) AS a, max(n) FILTER (style IS NOT NULL) AS top FROM n)
    SELECT 'inconsistent-naming' AS rule, 'info' AS severity, style AS subject, ordinal FROM n, f WHERE style IS NOT NULL AND exports >= 5 AND n < top AND n > 2 AND top / a > 0.3 AND top / a < 0.95""")
def naming_styles(spark, d):
    return rules.inconsistent_naming(table(spark, d, "symbols").where("ordinal % 4 < 3"), dominant=0.3)


#: Names of which three quarters are of one style.
_RENAMED = "CASE WHEN ordinal % 4 = 0 THEN name ELSE replace(replace(name, 'parse_it', 'parseIt'), 'User', 'user') END"


@query(f"""WITH {cte("symbols")}, n AS (SELECT {_STYLE.replace("name", "s.renamed")} AS style, min(ordinal) AS ordinal, count(*) AS n FROM (SELECT *, {_RENAMED} AS renamed FROM symbols) s WHERE exported GROUP BY 1), f AS (SELECT sum(n) AS exports, sum(n) FILTER (style IS NOT NULL) AS a, max(n) FILTER (style IS NOT NULL) AS top FROM n)
    SELECT 'inconsistent-naming' AS rule, 'info' AS severity, style AS subject, ordinal FROM n, f WHERE style IS NOT NULL AND exports >= 5 AND n < top AND n > 2 AND top / a > 0.6 AND top / a < 0.95""")
def dominant_naming(spark, d):
    return rules.inconsistent_naming(table(spark, d, "symbols").withColumn("name", F.expr(_RENAMED)))


@query(f"WITH {cte('modules')} SELECT 'deep-nesting' AS rule, path AS subject, ordinal, CASE WHEN count(*) OVER () > 10 THEN 'warning' ELSE 'info' END AS severity FROM modules WHERE len(string_split(path, '/')) > 5")
def deep_modules(spark, d):
    return rules.deep_nesting(table(spark, d, "modules"))


def _all_rules(spark, d):
    s = table(spark, d, "symbols").withColumnsRenamed({"summary": "doc_summary"}).withColumn("ai_summary", F.lit(None).cast("string")).withColumn("parameters", F.array(F.struct(F.col("param").alias("name"), F.col("param_type").alias("type"))))
    m = _counted(spark, d)
    return rules.all_rules(m, s, m.select(F.col("path").alias("node"), "ordinal"), _graph_once(spark, d))


@query()
def rule_counts(spark, d):
    return rules.severity_counts(_all_rules(spark, d))


@query(f"""WITH {cte("modules")}, f AS (SELECT path, ordinal, CASE WHEN ordinal % 9 = 0 THEN 'critical' WHEN ordinal % 4 = 0 THEN 'warning' ELSE 'info' END AS severity FROM modules)
    SELECT path, severity FROM f ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, ordinal LIMIT 20""")
def gravest_findings(spark, d):
    severity = F.when(F.col("ordinal") % 9 == 0, "critical").when(F.col("ordinal") % 4 == 0, "warning").otherwise("info")
    return batching.top_by_severity(table(spark, d, "modules").select("path", "ordinal", severity.alias("severity"))).select("path", "severity")


_TYPE = "coalesce(nullif(regexp_extract(message, '^(feat|fix|docs|refactor|test|chore|perf|ci|style|build)(\\([^)]*\\))?:', 1), ''), 'other')"
_TITLE = "regexp_replace(message, '^(feat|fix|docs|refactor|test|chore|perf|ci|style|build)(\\([^)]*\\))?:\\s*', '')"
_ORDER = "CASE " + " ".join(f"WHEN t = '{k}' THEN {i}" for i, k in enumerate(batching.TYPE_LABELS)) + " END"
_LABELS = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in batching.TYPE_LABELS.items()) + " END"
_COMMITS = f"c AS (SELECT repo, hash, ordinal, {_TYPE} AS t, {_TITLE} AS title FROM commits)"


@query(f"""WITH {cte("commits")}, {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, t ORDER BY ordinal, hash) AS place FROM c)
    SELECT repo, NULL::VARCHAR AS tag, {_ORDER} AS type_order, {_LABELS} AS label, place, hash, title FROM r WHERE place <= 20""")
def changelog_by_type(spark, d):
    return batching.changelog(table(spark, d, "commits")).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {cte("commits", "tags")}, {_COMMITS}, v AS (SELECT * FROM tags WHERE regexp_matches(tag, '^v?\\d+\\.\\d+')),
    b AS (SELECT c.repo, hash, c.ordinal, t, title, (SELECT arg_max(tag, v.ordinal) FROM v WHERE v.repo = c.repo AND v.ordinal <= c.ordinal) AS tag FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, tag ORDER BY ordinal, hash) AS place FROM b)
    SELECT repo, tag, {_ORDER} AS type_order, {_LABELS} AS label, place, hash, title FROM r WHERE place <= 50""")
def changelog_by_tag(spark, d):
    tags = table(spark, d, "tags").where(modules.is_version_tag(F.col("tag")))
    return batching.changelog(table(spark, d, "commits"), tags).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {cte('tags')}, v AS (SELECT tag, row_number() OVER (ORDER BY ordinal DESC) AS place FROM tags WHERE regexp_matches(tag, '^v?\\d+\\.\\d+')) SELECT tag, place FROM v WHERE place <= 10")
def newest_versions(spark, d):
    return batching.newest_versions(table(spark, d, "tags"), 10).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {cte("modules")}, p AS (SELECT path, upper(regexp_extract(path, '[^/]*$')) AS title, language AS nav_group, ordinal % 5 AS nav_order FROM modules), g AS (SELECT nav_group, row_number() OVER (ORDER BY min(nav_order), nav_group) AS group_order FROM p GROUP BY nav_group)
    SELECT path, nav_group, group_order, row_number() OVER (PARTITION BY nav_group ORDER BY nav_order, lower(title), title, path) AS place FROM p JOIN g USING (nav_group)""")
def navigation(spark, d):
    pages = table(spark, d, "modules").select("path", F.upper(modules.base_name(F.col("path"))).alias("title"), F.col("language").alias("nav_group"), (F.col("ordinal") % 5).alias("nav_order"))
    return batching.navigation(pages).select("path", "nav_group", F.col("group_order").cast("bigint").alias("group_order"), F.col("place").cast("bigint").alias("place"))


@query(f"WITH {cte('modules')} SELECT {_CLUSTER} AS cluster, count(DISTINCT path) AS n, string_agg(DISTINCT path, chr(10) ORDER BY path) AS listing FROM modules GROUP BY 1")
def path_lists(spark, d):
    return batching.path_lists(table(spark, d, "modules").select("path", T.directory_cluster(F.col("path")).alias("cluster")), "cluster")


@query(f"WITH {cte('modules')} SELECT {_SECTION.replace('{p}', 'path')} AS section, count(*) AS n, min(ordinal) AS first FROM modules GROUP BY 1")
def section_groups(spark, d):
    return table(spark, d, "modules").groupBy(T.logical_section(F.col("path"), fallback=False).alias("section")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


@query(f"""WITH {cte("symbols")}, p AS (SELECT DISTINCT id AS parent_id, path FROM symbols), r AS (SELECT parent_id AS id, name AS member, kind, visibility, row_number() OVER (PARTITION BY path, parent_id ORDER BY ordinal, name, kind, visibility) AS place FROM symbols SEMI JOIN p USING (parent_id, path))
    SELECT * FROM r WHERE place <= 10""")
def class_members(spark, d):
    return graph.class_members(table(spark, d, "symbols")).withColumn("place", F.col("place").cast("bigint"))


_HIERARCHY = f"""WITH {cte("symbols")}, k AS (SELECT *, extends IS NOT NULL OR id IN (SELECT parent_id FROM symbols) AS own FROM symbols WHERE exported AND kind IN ('class', 'interface')),
    f AS (SELECT * FROM k WHERE own), b AS (SELECT * FROM k WHERE NOT own AND name IN (SELECT extends FROM f) AND name NOT IN (SELECT name FROM f)),
    c AS (SELECT *, row_number() OVER (ORDER BY turn, ordinal) AS place FROM (SELECT *, 0 AS turn FROM f UNION ALL SELECT *, 1 FROM b) ORDER BY turn, ordinal LIMIT 3000)"""


def _hierarchy(spark, d):
    return graph.class_hierarchy(table(spark, d, "symbols").withColumn("implements", F.lit(None).cast("array<string>")), 3000)


@query(f"{_HIERARCHY} SELECT place, id, name, kind FROM c")
def class_nodes(spark, d):
    return _hierarchy(spark, d)[0].withColumn("place", F.col("place").cast("bigint"))


@query(f"{_HIERARCHY} SELECT DISTINCT extends AS base, name, 'extends' AS relation FROM c WHERE extends IN (SELECT name FROM c)")
def class_edges(spark, d):
    return _hierarchy(spark, d)[1]


def _signal_rows(spark, d):
    s = table(spark, d, "symbols").withColumnsRenamed({"path": "file_path", "ordinal": "sym_ordinal"})
    return s.withColumn("decorators", F.array().cast("array<string>")).withColumn("parameters", F.array("param")).withColumn("module_doc", F.lit(None).cast("string"))


_SIGNAL = "SELECT '{0}' AS signal, path AS file_path, ordinal AS sym_ordinal, {1} AS name, {2} AS detail, {3} AS description FROM {4}"
_RAW = "regexp_replace(regexp_replace(name, '(command|cmd)$', '', 'i'), '^register', '', 'i')"
_KEBAB = f"lower(regexp_replace(regexp_replace({_RAW}, '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'))"
_IS_CLI = "(contains(path, 'commands/') OR contains(path, 'bin/') OR contains(path, 'cmd/') OR (contains(path, 'cli/') AND NOT contains(path, 'flows/') AND NOT contains(path, 'utils/') AND regexp_matches(path, '(^|/)(index|main)\\.(ts|js)$')))"


@query(f"WITH {cte('symbols')} " + _SIGNAL.format("command", _KEBAB, f"CASE WHEN lower(param) IN ({_strings(signals.GENERIC)}) THEN NULL ELSE param END", "nullif(summary, '')", f"(SELECT * REPLACE (lower(path) AS path), path AS p0 FROM symbols) WHERE {_IS_CLI} AND exported AND kind IN ('function', 'variable', 'constant') AND (contains(lower(name), 'command') OR contains(lower(name), 'cmd') OR coalesce(contains(lower(summary), 'command'), false))").replace("path AS file_path", "p0 AS file_path", 1))
def command_signals(spark, d):
    return signals.cli_commands(_signal_rows(spark, d))


@query(f"WITH {cte('symbols')}, s AS (SELECT * FROM symbols WHERE regexp_matches(lower(path), 'config|schema|settings')), p AS (SELECT path, id AS parent_id, name AS parent FROM s WHERE exported AND kind IN ('interface', 'type', 'constant')) " + _SIGNAL.format("option", "parent || '.' || name", "type_annotation", "summary", "s JOIN p USING (path, parent_id) WHERE coalesce(type_annotation, '') <> '' OR coalesce(summary, '') <> ''"))
def setting_signals(spark, d):
    return signals.config_options(_signal_rows(spark, d))


@query(f"WITH {cte('symbols')} " + _SIGNAL.format("error", "name", "extends", "summary", "symbols WHERE kind = 'class' AND (coalesce(ends_with(extends, 'Error'), false) OR ends_with(name, 'Error') OR ends_with(name, 'Exception'))"))
def error_signals(spark, d):
    return signals.error_types(_signal_rows(spark, d))


@query(f"WITH {cte('symbols')} " + _SIGNAL.format("component", "name", "param", "summary", "symbols WHERE (regexp_matches(lower(path), 'components/|views/|widgets/') OR regexp_matches(path, '\\.(tsx|jsx|vue|svelte)$')) AND exported AND kind IN ('component', 'function', 'class') AND regexp_matches(name, '^[A-Z]')"))
def component_signals(spark, d):
    return signals.components(_signal_rows(spark, d))


@query()
def signal_counts(spark, d):
    return signals.counts(_signal_rows(spark, d))


@query("SELECT page_id, sha256(url || html) AS h, regexp_replace(regexp_replace(lower(substr(html, 1, 0) || url), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g') AS anchor FROM pages")
def composite_facts(spark, d):
    return read(spark, d, "pages").select("page_id", T.composite_hash(F.col("url"), F.col("html")).alias("h"), T.anchor(F.col("url")).alias("anchor"))


@query(f"WITH {cte('symbols', 'commits')} SELECT name, any_value({_STYLE}) AS style, any_value(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'))) AS kebab FROM symbols GROUP BY name")
def name_forms(spark, d):
    return table(spark, d, "symbols").select("name").distinct().select("name", T.naming_class(F.col("name")).alias("style"), T.kebab_case(F.col("name")).alias("kebab"))


@query(f"WITH {cte('modules')}, s AS (SELECT path FROM modules WHERE ordinal % 3 = 0 UNION SELECT concat('none/', ordinal) FROM modules WHERE ordinal % 7 = 0) SELECT s.path FROM s WHERE path IN (SELECT path FROM modules)")
def validated_paths(spark, d):
    m = table(spark, d, "modules")
    asked = m.where("ordinal % 3 = 0").select("path").union(m.where("ordinal % 7 = 0").select(F.concat(F.lit("none/"), "ordinal")))
    return corpus.validate_paths(asked, m)


@query(f"WITH {cte('modules')}, e AS (SELECT lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS extension FROM modules) SELECT extension, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, extension LIMIT 10")
def extension_histogram(spark, d):
    return corpus.extension_histogram(table(spark, d, "modules"))


#: Endings by which a made-up tree's files differ: some of source, some of the language table alone.
_TREE_PATH = "concat(path, CASE ordinal % 9 WHEN 0 THEN '.lua' WHEN 1 THEN '.mjs' WHEN 2 THEN '.pyi' WHEN 3 THEN '.Kts' WHEN 4 THEN '/Dockerfile' ELSE '' END)"


@query(f"""WITH {cte("modules")}, e AS (SELECT {_TREE_PATH} AS path, CASE WHEN ordinal % 10 = 0 THEN 'tree' ELSE 'blob' END AS type FROM modules),
    f AS (SELECT path, regexp_matches(path, '\\.(ts|tsx|js|jsx|py|go|rs|java|rb|php|cs|c|h|cpp|hpp|cc|cxx|swift|kt|kts|scala|sh|bash|yaml|yml|tf|hcl|md|json|toml|xml|sql|dockerfile)$', 'i') OR regexp_matches(path, '(^|/)dockerfile$', 'i') AS known,
      regexp_matches(path, '(^|/)(node_modules|dist|build|out|\\.git|\\.next|vendor|__pycache__|venv|\\.venv|target|coverage|site|test|tests|__tests__)(/|$)') AS skipped FROM e WHERE type = 'blob')
    SELECT count(*) AS total, count(*) FILTER (known AND NOT skipped) AS source FROM f""")
def tree_counts(spark, d):
    return corpus.tree_counts(table(spark, d, "modules").selectExpr(f"{_TREE_PATH} AS path", "CASE WHEN ordinal % 10 = 0 THEN 'tree' ELSE 'blob' END AS type"))


@query(f"WITH {cte('modules')} SELECT path, NOT regexp_matches(path, '(^|/)(test|tests|__tests__|migrations)/|\\.(test|spec)\\.|^(lib0|site|dist|build|out|env|vendor|target|coverage)/') AS wanted, CASE language WHEN 'typescript' THEN 'TypeScript' WHEN 'javascript' THEN 'JavaScript' WHEN 'json' THEN 'JSON' WHEN 'yaml' THEN 'YAML' WHEN 'python' THEN 'Python' ELSE 'Markdown' END AS shown FROM modules")
def scan_filter(spark, d):
    return table(spark, d, "modules").select("path", corpus.wanted(F.col("path")).alias("wanted"), corpus.display_name(F.col("language")).alias("shown"))


@query(f"""WITH {cte("modules")}, a AS (SELECT path, row_number() OVER (ORDER BY ordinal) AS o, 0 AS turn FROM modules WHERE ordinal % 3 = 0), b AS (SELECT path, row_number() OVER (ORDER BY ordinal DESC) AS o, 1 AS turn FROM modules WHERE ordinal % 2 = 0),
    u AS (SELECT path, min(turn * 1000000000 + o) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY path) SELECT path, row_number() OVER (ORDER BY place) AS n FROM u""")
def ordered_union(spark, d):
    m = table(spark, d, "modules")
    out = maintain.ordered_union(m.where("ordinal % 3 = 0"), m.where("ordinal % 2 = 0").withColumn("ordinal", -F.col("ordinal")), "path", "ordinal")
    return placed(out, [], ["place"], "n").select("path", F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {cte("modules")}, r AS (SELECT path, CASE WHEN ordinal % 3 = 0 THEN '' WHEN ordinal % 5 = 0 THEN NULL ELSE path END AS v, CASE WHEN ordinal % 2 = 0 THEN concat('again ', ordinal) ELSE '' END AS w FROM modules)
    SELECT path, coalesce(nullif(v, ''), nullif(w, '')) AS v, coalesce(nullif(v, ''), nullif(w, '')) IS NULL AS failed FROM r""")
def retried_results(spark, d):
    m = table(spark, d, "modules")
    first = m.select("path", F.when(F.col("ordinal") % 3 == 0, "").when(F.col("ordinal") % 5 == 0, None).otherwise(F.col("path")).alias("v"))
    again = m.select("path", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("again "), "ordinal")).otherwise("").alias("v"))
    return maintain.retried(first, again, "path", "v")


_CACHE = "c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('h', o_custkey) ELSE concat('h', o_custkey, ':s', o_orderkey % 3) END AS key, concat('s', o_orderkey) AS summary, o_orderkey AS generated_at FROM orders)"


@query(f"""WITH {_CACHE}, l AS (SELECT key, arg_max(summary, generated_at) AS summary FROM c GROUP BY key), w AS (SELECT c_name AS path, concat('h', c_custkey) AS content_hash, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('s', c_custkey % 3) END AS symbol FROM customer)
    SELECT path, symbol, summary FROM (SELECT *, CASE WHEN symbol IS NULL THEN content_hash ELSE content_hash || ':' || symbol END AS key FROM w) LEFT JOIN l USING (key)""")
def cached_summaries(spark, d):
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("h"), "o_custkey")).otherwise(F.concat(F.lit("h"), "o_custkey", F.lit(":s"), F.col("o_orderkey") % 3))
    cache = read(spark, d, "orders").select(key.alias("key"), F.concat(F.lit("s"), "o_orderkey").alias("summary"), F.col("o_orderkey").alias("generated_at"))
    wanted = read(spark, d, "customer").select(F.col("c_name").alias("path"), F.concat(F.lit("h"), "c_custkey").alias("content_hash"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("s"), F.col("c_custkey") % 3)).alias("symbol"))
    return maintain.cached_summaries(wanted, maintain.merged_cache(cache.where("generated_at % 2 = 0"), cache)).select("path", "symbol", "summary")


@query(f"WITH {cte('modules')} SELECT path FROM modules WHERE ordinal % 4 <> 1")
def without_deleted(spark, d):
    m = table(spark, d, "modules")
    return maintain.without_deleted(m.select("path"), m.select("path", F.when(m.ordinal % 4 == 1, "deleted").otherwise("modified").alias("status")), "path")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '<details>' || text ELSE '<details>' || chr(10) || '<summary>Sources for "' || lang || '" in demo</summary>' || chr(10) || chr(10) || '- `' || source || '`' || chr(10) || '- `a/b.ts`' || chr(10) || chr(10) || '</details>' || chr(10) || text END AS t FROM documents""")
def provenance(spark, d):
    docs = read(spark, d, "documents")
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<details>"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", validate.with_provenance(t, F.array("source", F.lit("a/b.ts")), F.col("lang"), "demo").alias("t"))


@query("""WITH c AS (SELECT doc_id, source AS cited, doc_id * 37 % 60000 AS line, CASE WHEN doc_id % 4 = 0 THEN '0' ELSE '' END || (doc_id * 37 % 60000) AS told, text FROM documents), f AS (SELECT source AS cited, max(n_chars) AS line_count FROM documents GROUP BY source)
    SELECT doc_id, sha256(text || ' See ' || CASE WHEN line BETWEEN 1 AND line_count THEN '[' || cited || ':' || told || '](https://x.example/r/blob/main/' || cited || '#L' || line || ')' ELSE '`' || cited || '`' END || ', `no file` and `' || cited || '`.') AS t,
    CASE WHEN line BETWEEN 1 AND line_count THEN 1 ELSE 0 END::BIGINT AS n_valid, CASE WHEN line BETWEEN 1 AND line_count THEN 2 ELSE 3 END::BIGINT AS n_dropped FROM c JOIN f USING (cited)""")
def citation_rewrite(spark, d):
    docs = read(spark, d, "documents")
    line = F.concat(F.when(F.col("doc_id") % 4 == 0, "0").otherwise(""), (F.col("doc_id") * 37 % 60000).cast("string"))
    t = F.concat("text", F.lit(" See ["), "source", F.lit(":"), line, F.lit("], [no file:3] and ["), "source", F.lit(":99999999999999999999999]."))
    files = docs.groupBy(F.col("source").alias("cited")).agg(F.max("n_chars").alias("line_count"))
    out = resolve.rewritten_citations(docs.select("doc_id", t.alias("t")), files, "doc_id", "t", repository="https://x.example/r/")
    return out.withColumn("t", F.sha2("t", 256))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS module, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS f FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id, 'no json ' || lang, NULL FROM documents WHERE doc_id % 5 = 0""")
def batch_responses(spark, d):
    docs = read(spark, d, "documents")
    js = F.concat(F.lit('```json\n{"module":"'), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.lit('","f":"'), "source", F.lit('","g":""}\n```'))
    out = docs.select("doc_id", validate.batch_response(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no json "), "lang")).otherwise(js), ["f", "g"]).alias("r"))
    return out.select("doc_id", "r.module", F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 5 != 0), "").otherwise(F.col("r.symbols")["f"]).alias("f"))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END::INTEGER AS n_errors,
    CASE k WHEN 0 THEN 'flowchart TD' || chr(10) || '  a["x (y)"] --> b[ok]' WHEN 1 THEN 'flowchart TD' || chr(10) || '  a["x (y)"] --> b' WHEN 2 THEN 'graph TD' || chr(10) || 'subgraph s' || chr(10) || 'a --> b' || chr(10) || '    end' ELSE 'drawing of ' || p_partkey END AS fixed,
    'flowchart' AS kind FROM b""")
def diagram_checks(spark, d):
    code = (
        F.when(F.col("p_partkey") % 4 == 0, '```mermaid\nflowchart TD\n  a["x (y)"] --> b[ok]\n```').when(F.col("p_partkey") % 4 == 1, "```mermaid\nflowchart LR\n  a[x (y)] --> b\n```")
        .when(F.col("p_partkey") % 4 == 2, "```\ngraph TD\nsubgraph s\na --> b\n```").otherwise(F.concat(F.lit("```\ndrawing of "), "p_partkey", F.lit("\n```")))
    )
    rows = read(spark, d, "part").select("p_partkey", F.explode(validate.diagram_blocks(F.concat(F.lit("Some text\n"), code, F.lit("\nmore")))).alias("c"))
    return rows.select("p_partkey", validate.diagram_check(F.col("c")).alias("x")).select("p_partkey", "x.n_errors", "x.fixed", "x.kind")


@query("""SELECT c_custkey, 0 AS place, 'p' || c_custkey AS page, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'medium' END AS importance, 'a.ts,b/' || c_nationkey || '.ts' AS files FROM customer
    UNION ALL SELECT c_custkey, 1, 'q', 'Second', 'low', '' FROM customer""")
def structure_pages(spark, d):
    page = F.concat(F.lit('x<wiki_structure>\n<page id="p'), "c_custkey", F.lit('">'), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("<title> "), "c_name", F.lit("\n</title>"))).otherwise(""), F.lit("<importance>"), F.when(F.col("c_custkey") % 3 == 0, "high").otherwise("huge"),
                    F.lit("</importance><file_path>a.ts</file_path><file_path> b/"), "c_nationkey", F.lit('.ts</file_path></page>\n<page  id="q"><title>Second</title><importance>low</importance></page></wiki_structure>'))
    return validate.structure_pages(read(spark, d, "customer").select("c_custkey", page.alias("t")), "c_custkey", "t").select("c_custkey", "place", "page", "title", "importance", F.array_join("files", ",").alias("files"))


@query(f"""WITH {cte("modules")} SELECT (ordinal // 4)::BIGINT AS batch, string_agg('## ' || path || ' (' || language || ', ' || line_count || ' lines)' || chr(10) || '```' || chr(10) || 'l1' || chr(10) || 'l2' || chr(10) || '```', chr(10) || chr(10) ORDER BY ordinal) AS prompt FROM modules GROUP BY 1""")
def file_prompts(spark, d):
    m = table(spark, d, "modules").withColumn("text", F.lit("l1\nl2\nl3\nl4")).withColumn("batch", F.floor(F.col("ordinal") / 4))
    return validate.file_sections(m, "batch", "ordinal", 2)


@query("""WITH a AS (SELECT conv_id, turn, lower(text) AS answer FROM conversations), t AS (SELECT DISTINCT substr(url, 1, 0) || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE page_id < 40)
    SELECT conv_id, turn, count(*) AS n FROM a, t WHERE len(list_filter(string_split_regex(lower(title), '\\s+'), lambda w: length(w) > 3 AND contains(answer, w))) > 0 GROUP BY ALL""")
def answer_sources(spark, d):
    titles = read(spark, d, "pages").where("page_id < 40").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).distinct()
    met = read(spark, d, "conversations").crossJoin(F.broadcast(titles))  # forty titles, the pages an answer was given
    return met.where(validate.answer_citations(F.col("text"), F.col("title"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
