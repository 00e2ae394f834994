"""Named queries over the driver's tables, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import batching, folds, graph, maintain, modules, resolve, retrieval, rules, signals, validate, vector_lists
from siltstone.operators.shared import at_rest, new_folder
from siltstone.operators.text_index import TextIndex
from siltstone.plans import code_queries, limit_queries, link_queries
from siltstone.registry import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES", "code_queries", "limit_queries", "link_queries"]


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
#: Query terms of the ranking queries; the repeated one counts twice.
TERMS = {1: ["thing", "ention", "hea", "hea"], 2: ["que", "ción"], 3: ["und", "keit", "zu"]}
_TERM_ROWS = ", ".join(f"({q}, '{t}')" for q, ts in TERMS.items() for t in ts)


def _bm25_sql(where: str, k: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), l AS (SELECT doc_id, len(ws) AS dl, ws FROM d),
    c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    q AS (SELECT query_id, term, count(*) AS times FROM (VALUES {_TERM_ROWS}) v(query_id, term) WHERE {where} GROUP BY ALL),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ws) AS term FROM l) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM tf JOIN q USING (term) JOIN df USING (term), c GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def _terms(spark: SparkSession, ids: set[int]) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, ts in TERMS.items() if q in ids for t in ts], "query_id int, term string")


@query(_bm25_sql("query_id = 1", 20))
def bm25_topk(spark, d):
    return retrieval.bm25(read(spark, d, "documents"), _terms(spark, {1}), "doc_id", F.col("text"), 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(_bm25_sql("true", 10))
def bm25_multi_query(spark, d):
    return retrieval.bm25(read(spark, d, "documents"), _terms(spark, set(TERMS)), "doc_id", F.col("text"), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_stats(spark, d):
    return retrieval.term_stats(retrieval.postings(read(spark, d, "documents"), "doc_id", F.col("text")))


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_count, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents""")
def document_facts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), T.line_count(t).alias("line_count"), T.estimate_tokens(t).alias("tokens"))


_BOW = """
    WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
    h AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) AS h FROM (SELECT DISTINCT w FROM w)),
    b AS (SELECT doc_id, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 256)::INTEGER AS bucket, sum(n)::BIGINT AS n FROM w JOIN h USING (w) GROUP BY ALL)"""


@query(_BOW + " SELECT doc_id, bucket, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b")
def bow_embedding(spark, d):
    return retrieval.bow_counts(read(spark, d, "documents"), "doc_id", F.col("text")).withColumn("weight", F.round("weight", 6))


@query(_BOW + """, v AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM b), q AS (SELECT bucket, x AS y FROM v WHERE doc_id = (SELECT min(doc_id) FROM v))
    SELECT doc_id, round(sum(x * y), 5) AS score FROM v JOIN q USING (bucket) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bow_similarity(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    first = docs.where(F.lower("text").rlike("[a-z0-9_]")).agg(F.min("doc_id").alias("f"))
    q = retrieval.bow_counts(docs.join(F.broadcast(first), F.col("doc_id") == F.col("f")), "doc_id", F.col("text")).select("bucket", F.col("weight").alias("y"))
    v = retrieval.bow_counts(docs, "doc_id", F.col("text")).select("doc_id", "bucket", F.col("weight").alias("x"))
    return v.join(F.broadcast(q), "bucket").groupBy("doc_id").agg(F.round(F.sum(F.col("x") * F.col("y")), 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, d):
    e = read(spark, d, "embeddings")
    return retrieval.vector_topk(e, e.where("vec_id = 0"), "vec_id", "embedding", 10).select("vec_id", "score")


_RANKED = "SELECT query_id, {0}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {0}) AS rank FROM s) WHERE rank <= 10"


@query("WITH s AS (SELECT q.vec_id AS query_id, t.vec_id, round(list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0) " + _RANKED.format("vec_id"))
def vector_topk_multi(spark, d):
    e = read(spark, d, "embeddings")
    return retrieval.vector_topk(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query("WITH s AS (SELECT q.vec_id AS query_id, t.vec_id, round(list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0) " + _RANKED.format("vec_id"))
def vector_lists_topk(spark, d):
    """The same search over lists about centroids, of which only those are read that may hold one of the ten."""
    e, folder = read(spark, d, "embeddings"), new_folder(spark, "lists")
    vector_lists.write_vector_lists(e, folder, "vec_id", "embedding", 64)
    found = vector_lists.vector_topk_lists(folder, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(_BOW + """, v AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM b),
    s AS (SELECT q.doc_id AS query_id, v.doc_id, round(sum(v.x * q.x), 5) AS score FROM v JOIN v q USING (bucket) WHERE q.doc_id % 100 = 0 GROUP BY ALL) """ + _RANKED.format("doc_id"))
def bow_similarity_multi(spark, d):
    v = at_rest(retrieval.bow_vectors(read(spark, d, "documents"), "doc_id", F.col("text")), "bow")
    return retrieval.vector_topk(v, v.where("doc_id % 100 = 0"), "doc_id", "vector", 10, digits=5).where("score > 0")


@query("""SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY lang, source""")
def lang_stats(spark, d):
    return modules.text_totals(read(spark, d, "documents"), ["lang", "source"], "n_chars", "text")


@query("""SELECT lang, count(*) AS n, floor(count(*) * 100.0 / (SELECT count(*) FROM documents) + 0.5)::BIGINT AS percent FROM documents GROUP BY lang""")
def lang_share(spark, d):
    return modules.share(read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "n")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_by_hash(spark, d):
    return modules.repeated_texts(read(spark, d, "documents"), "doc_id", "text")


_EDGES = """
    e0 AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS dst, l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag = 'A' AS type_only FROM lineitem WHERE l_quantity = 1),
    e AS (SELECT src, dst, type_only, l_suppkey * 1000000000 + l_orderkey * 10 + l_linenumber AS ordinal FROM e0 WHERE dst IS NOT NULL)"""


def part_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, type_only, ordinal): parts shipped one after the other by a supplier."""
    rows = read(spark, d, "lineitem").where("l_quantity = 1").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    e = rows.withColumn("dst", F.lead("l_partkey").over(w)).where("dst is not null")
    ordinal = F.col("l_suppkey") * 1_000_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return e.select(F.col("l_partkey").alias("src"), "dst", (F.col("l_returnflag") == "A").alias("type_only"), ordinal.alias("ordinal"))


_DEGREE = f"WITH {_EDGES}, x AS (SELECT src AS node, 0 AS i, ordinal FROM e UNION ALL SELECT dst, 1, ordinal FROM e), g AS (SELECT node, sum(i)::BIGINT AS n_in, sum(1 - i)::BIGINT AS n_out, count(*) AS degree, min(2 * ordinal + i)::BIGINT AS first_seen FROM x GROUP BY node)"


@query(_DEGREE + " SELECT * FROM g")
def degree(spark, d):
    return graph.degrees(part_graph(spark, d))


@query(_DEGREE + " SELECT 'god-module' AS rule, CASE WHEN (SELECT count(*) FROM g WHERE degree > 6) > 3 THEN 'warning' ELSE 'info' END AS severity, node AS subject, first_seen AS ordinal FROM g WHERE degree > 6")
def god_nodes(spark, d):
    return rules.god_modules(part_graph(spark, d), 6)


@query(_DEGREE + " SELECT node, degree FROM g ORDER BY degree DESC, first_seen LIMIT 30")
def top_connected(spark, d):
    return graph.top_connected(part_graph(spark, d), 30).select("node", "degree")


@query(f"WITH {_EDGES} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def orphan_nodes(spark, d):
    return graph.orphans(read(spark, d, "part").select(F.col("p_partkey").alias("node")), part_graph(spark, d))


_SEED = "s AS (SELECT min(dst) AS node FROM e)"


@query(f"WITH RECURSIVE {_EDGES}, {_SEED}, r(node) AS (SELECT node FROM s UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r WHERE node NOT IN (SELECT node FROM s)")
def impact_reach(spark, d):
    e = part_graph(spark, d)
    return graph.impact(e, e.agg(F.min("dst").alias("node"))).select("node")


@query(f"WITH RECURSIVE {_EDGES}, r(start, node) AS (SELECT src, dst FROM e UNION SELECT start, dst FROM r JOIN e ON src = node) SELECT DISTINCT start AS node FROM r WHERE start = node")
def cycle_members(spark, d):
    return graph.cycle_members(part_graph(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, g AS (SELECT DISTINCT src, dst FROM e), r(start, node) AS (SELECT src, dst FROM g UNION SELECT start, dst FROM r JOIN g ON src = node),
    c AS (SELECT a.start AS node, min(a.node) AS root FROM r a JOIN r b ON a.node = b.start AND b.node = a.start GROUP BY 1), t AS (SELECT DISTINCT root FROM c ORDER BY root LIMIT 10),
    b(root, node, depth) AS (SELECT root, root, 0 FROM t UNION SELECT b.root, g.dst, depth + 1 FROM b JOIN g ON g.src = b.node JOIN c ON c.node = g.dst AND c.root = b.root WHERE depth < 300),
    f AS (SELECT root, node, min(depth) AS depth FROM b GROUP BY ALL), l AS (SELECT root, min(depth) AS length FROM b WHERE node = root AND depth > 0 GROUP BY root),
    p AS (SELECT f.root, f.node, min(h.node) AS parent FROM f JOIN g ON g.dst = f.node JOIN f h ON h.root = f.root AND h.node = g.src AND h.depth = f.depth - 1 GROUP BY ALL),
    w(root, node, place) AS (SELECT l.root, min(f.node), any_value(length) - 1 FROM l JOIN f ON f.root = l.root AND f.depth = l.length - 1 JOIN g ON g.src = f.node AND g.dst = l.root GROUP BY l.root
      UNION ALL SELECT w.root, p.parent, place - 1 FROM w JOIN p ON p.root = w.root AND p.node = w.node)
    SELECT root AS cycle, place::BIGINT AS place, node FROM w""")
def cycle_paths(spark, d):
    return graph.shortest_cycles(part_graph(spark, d))


@query(f"""WITH {_EDGES}, {_SEED}, a AS (SELECT dst AS n FROM e JOIN s ON src = node), b AS (SELECT src AS n FROM e JOIN s ON dst = node),
    x AS (SELECT n, 1.0::DOUBLE AS score FROM a UNION ALL SELECT n, 1.0 FROM b UNION ALL SELECT dst, 0.6 FROM e WHERE src IN (SELECT n FROM a) UNION ALL SELECT src, 0.6 FROM e WHERE dst IN (SELECT n FROM b))
    SELECT n AS node, max(score) AS score FROM x WHERE n NOT IN (SELECT node FROM s) GROUP BY n""")
def neighbour_scores(spark, d):
    e = part_graph(spark, d)
    return graph.neighbour_scores(e, e.agg(F.min("dst").alias("node")))


@query(_DEGREE + ", t AS (SELECT node FROM g ORDER BY degree DESC, first_seen LIMIT 30) SELECT src, dst FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t) ORDER BY ordinal, src, dst LIMIT 100")
def induced_subgraph(spark, d):
    e = part_graph(spark, d)
    return graph.induced(e, graph.top_connected(e, 30)).select("src", "dst")


@query(f"""WITH {_EDGES} SELECT a.p_brand AS src_cluster, b.p_brand AS dst_cluster, count(*) AS n, arg_min(type_only, ordinal) AS style FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY ALL""")
def cluster_edges(spark, d):
    return graph.cluster_edges(part_graph(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster")))


@query(f"WITH {_EDGES}, n AS (SELECT count(*) AS n_nodes FROM (SELECT src FROM e UNION SELECT dst FROM e)) SELECT count(*) AS n_edges, count(*) FILTER (type_only) AS n_type_only, any_value(n_nodes) AS n_nodes, round(count(*) / any_value(n_nodes), 1) AS avg_edges FROM e, n")
def graph_stats(spark, d):
    return graph.graph_stats(part_graph(spark, d))


@query("SELECT l_partkey AS package, count(DISTINCT l_suppkey) AS n_modules, bool_and(l_returnflag = 'A') AS type_only FROM lineitem GROUP BY l_partkey")
def external_usage(spark, d):
    return modules.package_usage(read(spark, d, "lineitem").select(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("path"), (F.col("l_returnflag") == "A").alias("type_only")))


@query("""SELECT substr(o_orderpriority, 1, 1) AS type, o_orderkey AS hash, year(o_orderdate)::INTEGER AS tag, place FROM (SELECT *, row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1) ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 20""")
def changelog_groups(spark, d):
    o = read(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("type"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("at"), F.year("o_orderdate").alias("tag"))
    return batching.first_n(o, "type", [F.desc("at"), "hash"], 20).select("type", "hash", "tag", F.col("place").cast("bigint").alias("place"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[^:]*://', ''), '/') AS s FROM pages), x AS (SELECT page_id, s, unnest(range(1, least(len(s), 3) + 1)) AS k FROM p)
    SELECT array_to_string(s[1:k], '/') AS dir, count(*) AS n FROM x GROUP BY 1""")
def dir_tree_rollup(spark, d):
    return modules.directory_counts(read(spark, d, "pages"), F.regexp_replace("url", "^[^:]*://", ""))


_SNAP = "a AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


@query(f"WITH {_SNAP} SELECT doc_id, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b USING (doc_id) WHERE a.text IS DISTINCT FROM b.text")
def snapshot_diff(spark, d):
    a, b = _snapshots(spark, d)
    return maintain.snapshot_diff(a, b, "doc_id", F.sha2("text", 256))


@query(_bm25_sql("true", 10).replace("WITH d AS", f"WITH {_SNAP}, d AS").replace("FROM documents)", "FROM b)", 1).replace("FROM documents,", "FROM b,"))
def index_upkeep(spark, d):
    """One snapshot indexed, the changes to the next one put in, and searched as it is then."""
    a, b = _snapshots(spark, d)
    index = TextIndex(spark, new_folder(spark, "index"), "doc_id")
    index.put(a.withColumn("status", F.lit("added")), F.col("text"))
    index.put(maintain.snapshot_diff(a, b, "doc_id", F.sha2("text", 256)).join(b, "doc_id", "left"), F.col("text"))
    return index.search(_terms(spark, set(TERMS)), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_SNAP} SELECT doc_id, sha256(text) AS h FROM a WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, sha256(text) FROM b WHERE doc_id % 7 = 0")
def merge_snapshots(spark, d):
    a, b = _snapshots(spark, d)
    out = maintain.merge(a, b.where("doc_id % 7 = 0"), a.select("doc_id").union(b.select("doc_id")).where("doc_id % 7 = 0"), "doc_id")
    return out.select("doc_id", F.sha2("text", 256).alias("h"))


@query(f"WITH {_EDGES} SELECT CASE WHEN src % 13 = 0 THEN src + 1000000 ELSE src END AS src, CASE WHEN dst % 13 = 0 THEN dst + 1000000 ELSE dst END AS dst FROM e")
def rename_rewrite(spark, d):
    renames = read(spark, d, "part").where("p_partkey % 13 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1_000_000).alias("new"))
    return maintain.rename_edges(part_graph(spark, d).select("src", "dst"), renames)


@query("""WITH n AS (SELECT regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path, min(page_id) AS node_ordinal FROM pages GROUP BY 1),
    h AS (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages),
    i AS (SELECT DISTINCT src, href FROM h), c AS (SELECT src, href, unnest(['/en' || href, '/de' || href, '/en/' || (ord(substr(href, 2, 1)) % 100)::VARCHAR, '/fr/' || (length(href) * 7)::VARCHAR]) AS path FROM i)
    SELECT src, href, arg_min(path, node_ordinal) AS dst FROM c JOIN n USING (path) GROUP BY src, href""")
def import_resolve(spark, d):
    pages = read(spark, d, "pages")
    nodes = pages.groupBy(F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("path")).agg(F.min("page_id").alias("node_ordinal"))
    h = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href")).distinct()
    code = F.concat(F.lit("/en/"), (F.ascii(F.substring("href", 2, 1)) % 100).cast("string"))
    size = F.concat(F.lit("/fr/"), (F.length("href") * 7).cast("string"))
    c = h.withColumns({"import_ordinal": F.col("href"), "candidates": F.array(F.concat(F.lit("/en"), "href"), F.concat(F.lit("/de"), "href"), code, size)})
    return resolve.resolve_candidates(c, nodes).withColumnRenamed("import_ordinal", "href")


@query("""WITH f AS (SELECT source AS cited, max(n_chars) AS line_count FROM documents GROUP BY source), c AS (SELECT doc_id, source AS cited, (doc_id * 37 % 60000)::BIGINT AS line FROM documents)
    SELECT doc_id, cited, line, coalesce(line BETWEEN 1 AND line_count, false) AS valid FROM c LEFT JOIN f USING (cited)""")
def citation_validate(spark, d):
    docs = read(spark, d, "documents")
    note = F.concat("text", F.lit(" ["), "source", F.lit(":"), (F.col("doc_id") * 37 % 60000).cast("string"), F.lit("]"))
    cited = resolve.citations(docs.select("doc_id", note.alias("t")), "doc_id", "t")
    return resolve.validate_citations(cited, docs.groupBy(F.col("source").alias("cited")).agg(F.max("n_chars").alias("line_count"))).select("doc_id", "cited", "line", "valid")


@query("""WITH k AS (SELECT known, min(p_partkey) AS ordinal FROM (SELECT unnest(string_split(p_name, ' ')) AS known, p_partkey FROM part) WHERE known <> '' GROUP BY known),
    n AS (SELECT DISTINCT known || 'q' AS name FROM k WHERE known || 'q' NOT IN (SELECT known FROM k)),
    m AS (SELECT name, known AS fixed, ordinal, levenshtein(name, known) AS distance FROM n JOIN k ON substr(name, 1, 1) = substr(known, 1, 1) AND abs(length(name) - length(known)) <= 2)
    SELECT name, fixed, distance::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, ordinal, fixed) AS r FROM m WHERE distance < 3) WHERE r = 1""")
def fuzzy_fix(spark, d):
    words = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("known"), "p_partkey").where("known <> ''")
    # words of one part tie: their order is the part's, then the word's own
    known = words.groupBy("known").agg(F.min("p_partkey").alias("p")).select("known", F.struct("p", "known").alias("ordinal"))
    return resolve.nearest_names(known.select(F.concat("known", F.lit("q")).alias("name")), known)


@query("""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace('TODO: x' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'a PLACEHOLDER b', '(?m)^.*(YOUR_|TODO:|PLACEHOLDER|\\[INSERT|\\{\\{.*\\}\\}).*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS h FROM documents""")
def prose_validate(spark, d):
    t = F.concat(F.lit("TODO: x\n"), "text", F.lit("\n\n\n\na PLACEHOLDER b"))
    return read(spark, d, "documents").select("doc_id", F.sha2(validate.clean_prose(t), 256).alias("h"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def history_cap(spark, d):
    return batching.last_n(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1, 2")
def daily_quota(spark, d):
    return batching.daily_quota(read(spark, d, "events"), "user_id", "ts", 3)


@query("SELECT event_id, n_in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n_in_window FROM events)")
def rate_limit_batch(spark, d):
    return batching.trailing_counts(read(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "n_in_window")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 1::BIGINT << 62) >= 1800000000 AS new FROM e),
    s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def debounce_sessions(spark, d):
    return batching.debounced(read(spark, d, "events"), "user_id", "ts", 1800)


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), m AS (SELECT a.event_id AS id, arg_min({'rt': b.t, 'rid': b.event_id}, {'rt': b.t, 'rid': b.event_id}) AS m
    FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 5 AND a.t + 7200 WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1) SELECT id, m.rid AS match_id, m.rt AS match_t FROM m""")
def interval_match(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "t")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("rid"), F.col("t").alias("rt"))
    return batching.first_in_interval(a, b, "user_id", 5, 7200, 7200)


@query("SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 4.0)::BIGINT AS batch FROM conversations")
def fixed_batches(spark, d):
    return batching.fixed_batches(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("""SELECT doc_id, (len(string_split(p, '/')) > 3)::BOOLEAN AS deep, CASE WHEN list_has_any(string_split(lower(p), '/'), ['services', 'providers', 'adapters']) THEN 'Services' WHEN list_has_any(string_split(lower(p), '/'), ['tests', 'test', '__tests__', 'spec']) THEN 'Tests' ELSE upper(substr(lang, 1, 1)) || substr(lang, 2) END AS section
    FROM (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'src/Providers/' WHEN 1 THEN 'a/spec/' ELSE 'q/' END || lang || '/' || source AS p FROM documents)""")
def logical_sections(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "src/Providers/").when(F.col("doc_id") % 3 == 1, "a/spec/").otherwise("q/")
    p = F.concat(head, "lang", F.lit("/"), "source")
    return read(spark, d, "documents").select("doc_id", (F.size(F.split(p, "/")) > 3).alias("deep"), T.logical_section(p).alias("section"))


@query("""SELECT conv_id, turn, n // 7 AS wave, CASE WHEN n % 7 < 4 THEN 0 WHEN n % 7 < 5 THEN 2 ELSE 3 END AS slot
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)""")
def wave_plan(spark, d):
    return batching.wave_plan(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", [4, 0, 1, 2])


_SYMBOL = "(['get', 'List', 'postUser', 'x'])[(p_partkey % 4 + 1)::INTEGER] || upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) || 'ById'"


@query(f"""WITH s AS (SELECT p_partkey, {_SYMBOL} AS n, p_partkey % 8 = 3 AS deco FROM part), r AS (SELECT *, regexp_replace(n, '^(get|post|put|delete|patch)', '', 'i') AS rest FROM s)
    SELECT p_partkey, CASE WHEN starts_with(n, 'get') THEN 'GET' WHEN starts_with(n, 'post') THEN 'POST' ELSE 'DELETE' END AS verb,
    '/' || lower(regexp_replace(lower(substr(rest, 1, 1)) || substr(rest, 2), '([A-Z])', '/\\1', 'g')) AS path FROM r WHERE deco OR starts_with(n, 'get') OR starts_with(n, 'post')""")
def route_signals(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("get", "List", "postUser", "x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(head, F.upper(F.substring("p_brand", 1, 1)), F.lower(F.substr("p_brand", F.lit(2))), F.lit("ById"))
    deco = F.when(F.col("p_partkey") % 8 == 3, F.array(F.lit("@app.Delete('/x')")))
    s = read(spark, d, "part").select("p_partkey", name.alias("n"), deco.alias("deco")).withColumn("verb", signals.route_verb(F.col("n"), F.col("deco")))
    return s.where("verb is not null").select("p_partkey", "verb", signals.route_path(F.col("n")).alias("path"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages as markdown: headings and paragraphs of their html."""
    t = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav>.*?</nav>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<h[1-3][^>]*>", "\n\n## "), r"</h[1-6]>|</?p>|<br>", "\n\n")
    return read(spark, d, "pages").select("page_id", F.regexp_replace(t, "<[^>]*>", "").alias("md"))


@query()
def chunk_pages(spark, d):
    return folds.chunk_pages(_markdown(spark, d), "page_id", "md")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id::VARCHAR AS path, ceil(length(text) / 4.0)::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id % 11 DESC, doc_id) AS n FROM documents),
    r AS (SELECT source, path, size, n, size <= 8000 AS taken, CASE WHEN size <= 8000 THEN size ELSE 0 END AS used FROM d WHERE n = 1
      UNION ALL SELECT d.source, d.path, d.size, d.n, r.used < 8000 AND d.size <= 8000 - r.used, r.used + CASE WHEN r.used < 8000 AND d.size <= 8000 - r.used THEN d.size ELSE 0 END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)
    SELECT source, path, size, used::BIGINT AS used FROM r WHERE taken""")
def greedy_context(spark, d):
    docs = read(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 11 / 10).alias("score"), F.col("doc_id").alias("ordinal"), T.estimate_tokens(F.col("text")).alias("size"))
    return folds.greedy_context(docs, "source", 8000)


_FOLDERS = "SELECT source, lang || '/' || doc_id % 5 AS leaf, lang AS top, lang || '/' || doc_id % 5 || '/' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents"


@query(f"""WITH RECURSIVE d AS ({_FOLDERS}), r AS (SELECT source, n, path, true AS taken, [leaf] AS leaves, [top] AS tops FROM d WHERE n = 1
      UNION ALL SELECT source, n, path, ok, CASE WHEN ok THEN list_append(leaves, leaf) ELSE leaves END, CASE WHEN ok THEN list_append(tops, top) ELSE tops END FROM
      (SELECT d.source, d.n, d.path, d.leaf, d.top, r.leaves, r.tops, len(r.leaves) < 20 AND len(list_filter(r.leaves, lambda x: x = d.leaf)) < 4 AND len(list_filter(r.tops, lambda x: x = d.top)) < 6 AS ok FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1))
    SELECT source, path, place FROM (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY NOT taken, n) - 1 AS place FROM r) WHERE place < 20""")
def diverse_select(spark, d):
    docs = read(spark, d, "documents").select("source", F.concat_ws("/", F.col("lang"), (F.col("doc_id") % 5).cast("string"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("ordinal"))
    return folds.diverse_select(docs, "source", 20)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, t, n, true AS accepted, [t] AS recent FROM e WHERE n = 1
      UNION ALL SELECT user_id, event_id, t, n, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END FROM (SELECT e.*, list_filter(r.recent, lambda x: e.t - x < 36000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, t, accepted FROM r""")
def rate_limit_exact(spark, d):
    from siltstone.streaming.limits import rate_limited

    e = read(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return rate_limited(e, "user_id", 36_000, 2)
