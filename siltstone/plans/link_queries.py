"""Queries that link names, in whole documents and in types of the made-up code base, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import links
from siltstone.plans.code_tables import PATH, at, cte, table
from siltstone.registry import query, read

#: Names planted in whole texts: plain ones, ones of no page, ones right after [ and ones of another case.
_PLANTED = """replace(replace(replace(replace(concat('`User', doc_id % 40, 'Error` first. `User', doc_id % 7, '` ', text), ' the ', concat(' `User', doc_id % 40, '` ')), ' of ', concat(' `user', doc_id % 40, '` ')),
    ' and ', concat(' [`User', (doc_id + 1) % 40, '`](u) ')), ' in ', concat(' `User', (doc_id + 1) % 40, '` and `None', doc_id, '` '))"""
_PAGE = "'api/' || regexp_replace(path, '\\.[^.]+$', '') || '.md'"
_TYPES = f"p AS (SELECT name, arg_max({_PAGE}, ordinal) AS page, min(ordinal) AS place FROM symbols WHERE exported AND kind IN ('interface', 'type', 'class', 'enum') GROUP BY name)"
#: The way from own's folder to page.
_WAY = """repeat('../', (len(string_split(own, '/')) - 1 - common)::BIGINT) || array_to_string(string_split(page, '/')[common + 1:], '/')"""
_COMMON = "list_max(list_filter(range(len(string_split(own, '/'))), lambda k: string_split(own, '/')[:k] = string_split(page, '/')[:k]))"


@query(f"""WITH {cte("symbols")}, {_TYPES}, w AS (SELECT doc_id, concat('User', doc_id % 40) AS sought, {_PLANTED} AS t, {at(PATH, "doc_id")} AS path FROM documents),
    d AS (SELECT doc_id, t, CASE WHEN doc_id % 5 = 0 THEN coalesce(page, 'index.md') ELSE {_PAGE} END AS own FROM w LEFT JOIN p ON name = sought),
    n AS (SELECT DISTINCT doc_id, t, own, unnest(regexp_extract_all(t, '`([A-Z][a-zA-Z0-9_]+)`', 1)) AS name FROM d),
    o AS (SELECT doc_id, t, own, name, page, strpos(t, '`' || name || '`') AS pos FROM n JOIN p USING (name) WHERE page <> own),
    f AS (SELECT *, {_COMMON} AS common FROM o WHERE pos = 1 OR substr(t, pos - 1, 1) <> '['),
    s AS (SELECT doc_id, pos, substr(t, (lag(pos + length(name) + 2, 1, 1) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT, (pos - lag(pos + length(name) + 2, 1, 1) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT)
      || '[`' || name || '`](' || {_WAY} || '#' || lower(name) || ')' AS piece, pos + length(name) + 2 AS after FROM f),
    g AS (SELECT doc_id, count(*) AS n_links, string_agg(piece, '' ORDER BY pos) AS head, max(after) AS after FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_links, 0) AS n_links, sha256(coalesce(head || substr(t, after), t)) AS linked FROM d LEFT JOIN g USING (doc_id)""")
def prose_links(spark, d):
    pages = links.linkable_pages(table(spark, d, "symbols"))
    docs = read(spark, d, "documents").selectExpr("doc_id", f"{_PLANTED} AS text", f"{at(PATH, 'doc_id')} AS path", "concat('User', doc_id % 40) AS name")
    own = F.when(F.col("doc_id") % 5 == 0, F.coalesce("page", F.lit("index.md"))).otherwise(links.documented_at("path"))
    texts = docs.join(pages, "name", "left").select("doc_id", "text", own.alias("page"))
    return links.linked_names(texts, pages).select("doc_id", "n_links", F.sha2("text", 256).alias("linked"))


_NAMED_TYPE = "concat('Map<', CASE WHEN l_suppkey % 4 = 0 THEN 'string' ELSE concat('User', l_suppkey % 9) END, ', ', CASE WHEN l_suppkey % 3 = 0 THEN concat('xUser', l_suppkey) ELSE concat('User', l_partkey % 90, CASE WHEN l_suppkey % 2 = 0 THEN 'Error' ELSE '' END) END, '[]>')"


@query(f"""WITH {cte("symbols")}, {_TYPES}, r AS (SELECT DISTINCT {_NAMED_TYPE} AS type, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'api/' || regexp_replace({at(PATH, "(l_partkey % 50)")}, '\\.[^.]+$', '') || '.md' END AS own FROM lineitem),
    w AS (SELECT DISTINCT type, own, unnest(regexp_extract_all(type, '[A-Za-z0-9_]+')) AS name FROM r),
    b AS (SELECT type, own, arg_min(name, place) AS name, arg_min(page, place) AS page FROM w JOIN p USING (name) GROUP BY ALL), c AS (SELECT *, coalesce({_COMMON}, 0) AS common FROM b)
    SELECT r.type, r.own AS page, CASE WHEN c.name IS NULL THEN '`' || r.type || '`' ELSE regexp_replace(r.type, '\\b' || c.name || '\\b', '[' || c.name || '](' || CASE WHEN c.own IS NULL THEN '../' || c.page ELSE (SELECT {_WAY.replace("own", "c.own").replace("page", "c.page").replace("common", "c.common")}) END || '#' || lower(c.name) || ')') END AS linked
    FROM r LEFT JOIN c ON r.type = c.type AND r.own IS NOT DISTINCT FROM c.own""")
def type_links(spark, d):
    own = F.when(F.col("l_partkey") % 6 != 0, links.documented_at("path"))
    rows = read(spark, d, "lineitem").selectExpr(f"{_NAMED_TYPE} AS type", f"{at(PATH, '(l_partkey % 50)')} AS path", "l_partkey").select("type", own.alias("page")).distinct()
    return links.linked_types(rows, links.linkable_pages(table(spark, d, "symbols")))
