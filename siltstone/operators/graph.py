"""Dependency-graph measures over edges (src, dst, ordinal): parallel edges and loops count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.shared import Rounds
from siltstone.operators.shared import cut as _cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, degree, first_seen): one pass; a loop counts twice; first_seen is 2 ordinal, or + 1 as a target."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("end"), F.col("ordinal")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("end"), F.col("ordinal")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("end").alias("n_in"), F.sum(1 - F.col("end")).alias("n_out"), F.count("*").alias("degree"), F.min(2 * F.col("ordinal") + F.col("end")).alias("first_seen"))


def top_connected(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "first_seen").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return nodes.join(ends, "node", "left_anti")


def impact(edges: DataFrame, seeds: DataFrame, steps: int = 4) -> DataFrame:
    """(node, depth): all that reach a seed along edges, seeds excluded; depth is the fewest steps.

    Frontier by frontier, so many steps a job. Edges are dealt by their target once. A step moves the frontier and leaves out what earlier jobs have
    seen; the job's finds join the table of visited nodes with their least depth.
    """
    back = _cut(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct().repartition("a"))
    seen = _cut(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    frontier, depth = seen.select("node"), 0
    while True:
        found = seen
        for _ in range(steps):
            depth += 1
            frontier = frontier.join(back, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
            found = found.unionByName(frontier.withColumn("depth", F.lit(depth).cast("bigint")))
        seen = _cut(found.groupBy("node").agg(F.min("depth").alias("depth")))
        frontier = seen.where(F.col("depth") == depth).select("node")
        if frontier.isEmpty():
            return seen.where("depth > 0")


#: Hashes by which a turn tells nodes apart: the more there are, the fewer turns.
_COLORS = 4


def _colors(e: DataFrame, turn: int) -> DataFrame:
    """(node, f, b): for each node the least of all that reach it along edges (src, dst), and the least of all that it reaches, itself included, by each of a turn's hashes.

    Each round a node hears from those before it (after it), and from one that lies twice as far as the round before: a stretch
    without branches is passed in a logarithm of its length, others in as many rounds as they have steps at most.
    """
    ways = Rounds(e.sparkSession, "ways").put(e.select(F.lit(0).alias("way"), F.col("src").alias("via"), F.col("dst").alias("node")).union(e.select(F.lit(1), "dst", "src")))
    rounds, names = Rounds(e.sparkSession, "colors"), [f"c{i}" for i in range(_COLORS)]
    own = [F.struct(F.xxhash64("node", F.lit(turn * _COLORS + i)).alias("h"), F.col("node").alias("n")).alias(c) for i, c in enumerate(names)]
    ends = ways.select("way", F.col("via").alias("node")).distinct().join(ways.groupBy("way", "node").agg(F.min("via").alias("far")), ["way", "node"], "full")
    c = rounds.put(ends.select("way", "node", F.coalesce("far", "node").alias("far"), *own))
    while True:
        asks = ways.select("way", "via", "node", F.lit(False).alias("jump")).union(c.select("way", F.col("far").alias("via"), "node", F.lit(True)))
        told = asks.join(c.withColumnRenamed("node", "via"), ["way", "via"])
        heard = told.select("way", "node", F.when(F.col("jump"), F.col("far")).alias("far"), F.lit(False).alias("own"), *names)
        heard = heard.union(c.select("way", "node", F.lit(None).cast(c.schema["far"].dataType), F.lit(True), *names))
        least = [F.min(x).alias(x) for x in names]
        before = F.max(F.when(F.col("own"), F.struct(*names))).alias("before")
        new = rounds.put(heard.groupBy("way", "node").agg(F.max("far").alias("far"), *least, before))
        c = new.drop("before")
        if new.where(F.struct(*names) != F.col("before")).isEmpty():
            both = lambda way: F.max(F.when(F.col("way") == way, F.array(*names)))
            return c.groupBy("node").agg(both(0).alias("f"), both(1).alias("b"))


#: Edges are trimmed as long as a round leaves at most this share of them.
_TRIMMED = 0.9


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges (src, dst) without those whose source nothing leads to, or whose target leads nowhere: they lie on no cycle. Not all of them: long tails are left to the turns."""
    rounds, n = Rounds(e.sparkSession, "trimmed"), e.count()
    while n:
        e = rounds.put(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        n, before = e.count(), n
        if n > _TRIMMED * before:
            break
    return e


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, root): nodes that reach themselves, with the least node of their strongly connected component, whatever the order of rows.

    Edges that lead out of or into nothing are trimmed first, and nodes go by numbers from then on. Nodes of a component have the least of
    all before them in common, and the least of all after them. Where both are the same node, it is in the component, which is thereby found; edges between nodes that differ in either lie on no cycle, and the rest goes through another turn.
    """
    turns, parts = Rounds(edges.sparkSession, "turn"), Rounds(edges.sparkSession, "found")
    whole = _cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left = _trimmed(whole.where("src <> dst"))
    names = _cut(left.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
    e = _cut(left.join(names.toDF("src", "s"), "src").join(names.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))
    found, turn = e.select(F.col("src").alias("node"), F.col("src").alias("group")).limit(0), 0
    while not e.isEmpty():
        c = _colors(e, turn)
        of = lambda end: c.select(F.col("node").alias(end), F.struct("f", "b").alias(f"{end}_c"))  # noqa: E731, B023
        met = F.filter(F.zip_with("src_c.f", "src_c.b", lambda f, b: F.when(f == b, f["n"])), lambda n: n.isNotNull())
        same = turns.put(e.join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c").select("src", "dst", F.get(met, F.lit(0)).alias("group")))
        found = parts.put(found.union(same.where("group is not null").select(F.explode(F.array("src", "dst")).alias("node"), "group").distinct()))
        e, turn = same.where("group is null").select("src", "dst"), turn + 1
    found = found.join(names.withColumnRenamed("id", "node"), "node").select(F.col("name").alias("node"), "group")
    loops = whole.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
    least = found.groupBy("group").agg(F.min("node").alias("root"))
    return found.join(least, "group").select("node", "root").union(loops.join(found, "node", "left_anti"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves."""
    return cycle_components(edges).select("node")


def _places_on_rings(e: DataFrame) -> DataFrame:
    """(root, node, place): steps from root to each node of rings (root, src, dst), by pointers that reach twice as far each round."""
    rounds = Rounds(e.sparkSession, "ring")
    c = rounds.put(e.select("root", F.col("dst").alias("node"), F.when(F.col("dst") == F.col("root"), F.col("root")).otherwise(F.col("src")).alias("far"), (F.col("dst") != F.col("root")).cast("bigint").alias("place")))
    while not c.where("far <> root").isEmpty():
        ahead = c.select("root", F.col("node").alias("far"), F.col("far").alias("farther"), F.col("place").alias("more"))
        c = rounds.put(c.join(ahead, ["root", "far"]).select("root", "node", F.col("farther").alias("far"), (F.col("place") + F.col("more")).alias("place")))
    return c.select("root", "node", "place")


def _places_by_steps(e: DataFrame, steps: int) -> DataFrame:
    """(root, node, place) of a shortest cycle through each root of edges (root, src, dst): of equally near nodes before one, the least leads to it.

    So many steps a job from the root, until one leads back to it; then the cycle's nodes are told from the tree of steps by pointers that reach twice as far each round.
    """
    kind = e.schema["src"].dataType
    steps_kept, ends_kept, fronts, on_kept, far_kept = (Rounds(e.sparkSession, x) for x in ("steps", "ends", "fronts", "on", "far"))
    seen, depth = steps_kept.put(e.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("place"), F.lit(None).cast(kind).alias("parent"))), 0
    frontier, closed = seen.select("root", "node"), seen.select("root", F.col("parent").alias("last"), F.col("place").alias("length")).limit(0)
    while not frontier.isEmpty():
        found, ends, now = seen, closed, frontier
        for _ in range(steps):
            depth += 1
            met = now.join(e.withColumnRenamed("src", "node"), ["root", "node"]).groupBy("root", "dst").agg(F.min("node").alias("parent"))
            ends = ends.union(met.where("dst = root").select("root", F.col("parent").alias("last"), F.lit(depth).cast("bigint")))
            new = met.where("dst <> root").select("root", F.col("dst").alias("node"), F.lit(depth).cast("bigint").alias("place"), "parent").join(seen, ["root", "node"], "left_anti")
            found, now = found.union(new), new.select("root", "node")
        best = F.min(F.struct("place", "parent"))
        closed = ends_kept.put(ends.groupBy("root").agg(F.min(F.struct("length", "last")).alias("c")).select("root", "c.last", "c.length"))
        seen = steps_kept.put(found.groupBy("root", "node").agg(best.alias("b")).select("root", "node", "b.place", "b.parent"))
        frontier = fronts.put(seen.where(F.col("place") == depth).select("root", "node").join(closed, "root", "left_anti"))
    on = closed.select("root", F.col("last").alias("node"))
    far, reach, most = seen.where("parent is not null").select("root", "node", F.col("parent").alias("far")), 1, closed.agg(F.max("length")).first()[0] or 0
    while reach < most:
        on = on_kept.put(on.union(on.join(far, ["root", "node"]).select("root", F.col("far").alias("node"))).distinct())
        ahead = far.select("root", F.col("node").alias("far"), F.col("far").alias("farther"))
        far, reach = far_kept.put(far.join(ahead, ["root", "far"]).select("root", "node", F.col("farther").alias("far"))), 2 * reach
    return on.join(seen, ["root", "node"]).select("root", "node", "place")


def shortest_cycles(edges: DataFrame, most: int = 10, steps: int = 3) -> DataFrame:
    """(cycle, place, node): a shortest cycle through the least node (cycle) of each of the first most components by that node, from it (place 0) along edges.

    Components that are rings need no search; the others are searched side by side, no further than their cycles are long.
    """
    parts = _cut(cycle_components(edges))
    roots = parts.select("root").distinct().orderBy("root").limit(most)
    own = _cut(parts.join(F.broadcast(roots), "root"))  # at most `most` roots
    src, dst = own.select(F.col("node").alias("src"), "root"), own.select(F.col("node").alias("dst"), F.col("root").alias("root2"))
    e = _cut(edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").where("root = root2").select("root", "src", "dst"))
    rings = e.groupBy("root").agg(F.count("*").alias("n")).join(own.groupBy("root").agg(F.count("*").alias("m")), "root").where("n = m").select("root")
    ring, other = e.join(rings, "root", "left_semi"), e.join(rings, "root", "left_anti")
    return _places_on_rings(ring).union(_places_by_steps(_cut(other), steps).select("root", "node", "place")).select(F.col("root").alias("cycle"), "place", "node")


def neighbour_scores(edges: DataFrame, target: DataFrame) -> DataFrame:
    """(node, score): direct 1.0 and 0.6 for two hops the same way, of the nodes in target (node), which are not in the result."""
    step = lambda rows, a, b: edges.select(F.col(a).alias("n"), F.col(b).alias("m")).join(rows, "n", "left_semi").select(F.col("m").alias("n")).distinct()
    own = target.select(F.col("node").alias("n"))
    down, up = step(own, "src", "dst"), step(own, "dst", "src")
    down2, up2 = step(down, "src", "dst"), step(up, "dst", "src")
    scored = down.union(up).withColumn("score", F.lit(1.0)).union(down2.union(up2).withColumn("score", F.lit(0.6)))
    return scored.groupBy("n").agg(F.max("score").alias("score")).withColumnRenamed("n", "node").join(target, "node", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """The first edges by ordinal with both ends in nodes."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").orderBy("ordinal").limit(most)


def cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src_cluster, dst_cluster, n, style): edges between different clusters; style (type_only) is the first edge's."""
    a = clusters.select(F.col("node").alias("src"), F.col("cluster").alias("src_cluster"))
    b = clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("dst_cluster"))
    both = edges.join(a, "src").join(b, "dst").where("src_cluster <> dst_cluster")
    return both.groupBy("src_cluster", "dst_cluster").agg(F.count("*").alias("n"), F.min_by("type_only", "ordinal").alias("style"))


def graph_stats(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("n_nodes"))
    facts = edges.agg(F.count("*").alias("n_edges"), F.count_if("type_only").alias("n_type_only"))
    return facts.crossJoin(ends).withColumn("avg_edges", F.round(F.col("n_edges") / F.col("n_nodes"), 1))


def neighbourhood(edges: DataFrame, shown: int = 8) -> DataFrame:
    """(node, upstream, downstream, n_in, n_out, referenced_by): the first shown edges' other ends each way by ordinal, and the first shown sources by name.

    Each list is cut by rank before it is gathered.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way"), "ordinal"), F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way"), "ordinal"))).alias("e")).select("e.*")
    by_order = F.row_number().over(Window.partitionBy("node", "way").orderBy("ordinal", "other"))
    by_name = F.row_number().over(Window.partitionBy("node", "way").orderBy("other", "ordinal"))
    lists = lambda rank, way: ends.withColumn("r", rank).where((F.col("r") <= shown) & (F.col("way") == way)).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("l"))
    counts = ends.groupBy("node").agg(F.count_if(F.col("way") == "in").alias("n_in"), F.count_if(F.col("way") == "out").alias("n_out"))
    out, empty = counts, F.array().cast(f"array<{dict(edges.dtypes)['src']}>")
    for name, rank, way in (("upstream", by_order, "in"), ("downstream", by_order, "out"), ("referenced_by", by_name, "in")):
        out = out.join(lists(rank, way).withColumnRenamed("l", name), "node", "left").withColumn(name, F.coalesce(name, empty))
    return out


def class_members(symbols: DataFrame, most: int = 10) -> DataFrame:
    """(id, place, member, kind, visibility): the first most children (parent_id) of each symbol of the same file, by ordinal."""
    place = F.row_number().over(Window.partitionBy("path", "parent_id").orderBy("ordinal", "name", "kind", "visibility"))
    rows = symbols.where("parent_id is not null").withColumn("place", place).where(F.col("place") <= most)
    return rows.join(symbols.select(F.col("id").alias("parent_id"), "path").distinct(), ["parent_id", "path"], "left_semi").select(F.col("parent_id").alias("id"), "place", F.col("name").alias("member"), "kind", "visibility")


def class_hierarchy(symbols: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """Classes (place, id, name, kind) of a diagram and its edges (base, name, relation).

    Exported classes and interfaces that extend, implement or have members come first, by ordinal, then the others that these name; most in all.
    An edge stands for each base among them.
    """
    kinds = symbols.where(F.col("exported") & F.col("kind").isin("class", "interface"))
    parents = symbols.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    told = kinds.join(parents, "id", "left").withColumn("own", F.col("extends").isNotNull() | (F.size(F.coalesce("implements", F.array().cast("array<string>"))) > 0) | F.coalesce("has_children", F.lit(False)))
    first = told.where("own")
    bases = first.select(F.explode(F.concat(F.array("extends"), F.coalesce("implements", F.array().cast("array<string>")))).alias("name")).where("name is not null").distinct()
    named = told.where("not own").join(bases, "name", "left_semi").join(first.select("name"), "name", "left_anti")
    both = first.withColumn("turn", F.lit(0)).unionByName(named.withColumn("turn", F.lit(1)))
    chosen = both.orderBy("turn", "ordinal").limit(most).withColumn("place", F.row_number().over(Window.orderBy("turn", "ordinal")))
    known = chosen.select(F.col("name").alias("base")).distinct()
    links = chosen.select("name", F.explode(F.concat(F.array(F.struct(F.col("extends").alias("base"), F.lit("extends").alias("relation"))), F.transform(F.coalesce("implements", F.array().cast("array<string>")), lambda i: F.struct(i.alias("base"), F.lit("implements").alias("relation"))))).alias("l")).select("l.base", "name", "l.relation")
    return chosen.select("place", "id", "name", "kind"), links.where("base is not null").join(known, "base", "left_semi").distinct()
