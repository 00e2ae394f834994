import random
import uuid

import pytest

from siltstone.operators import graph


def reach(edges, start):
    seen, front = set(), {start}
    while front:
        front = {b for a, b in edges if a in front} - seen
        seen |= front
    return seen


def shortest(edges, root):
    """The shortest cycle through root; of equally near nodes before one, the least."""
    parent, level, depth = {root: None}, [root], 0
    while level:
        back = [a for a in level if (a, root) in edges]
        if back:
            path, at = [], min(back)
            while at is not None:
                path.append(at)
                at = parent[at]
            return path[::-1]
        new = {}
        for a, b in sorted(edges):
            if a in level and b not in parent:
                new.setdefault(b, a)
        parent |= new
        level = list(new)
    raise AssertionError(root)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 14, 30])
    edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(int(n * rng.choice([0.8, 1.2, 1.8])))}
    rows = [(a, b) for a, b in edges] * 2 + [(None, "n01"), ("n01", None)]
    df = spark.createDataFrame(rows, "src string, dst string").repartition(3)
    can = {x: reach(edges, x) for e in edges for x in e}
    want = {(x, min(y for y in can[x] if x in can[y])) for x in can if x in can[x]}
    assert {tuple(r) for r in graph.cycle_components(df).collect()} == want
    assert graph.cycle_components(df).count() == len(want)
    got = {}
    for r in sorted(graph.shortest_cycles(df).collect()):
        assert r.place == len(got.setdefault(r.cycle, []))
        got[r.cycle].append(r.node)
    roots = sorted({r for _, r in want})[:10]
    assert got == {r: shortest(edges, r) for r in roots}


def jobs(spark, run):
    sc, group = spark.sparkContext, f"counted-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "counted")
    out = run()
    n = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setJobGroup("", "")
    return out, n


def test_a_long_ring_takes_few_jobs(spark):
    n = 1000
    ring = spark.range(n).selectExpr("(id * 7) % 1000 src", "((id + 1) * 7) % 1000 dst")
    members, a = jobs(spark, lambda: graph.cycle_members(ring).count())
    assert members == n and a < 100
    rows, b = jobs(spark, lambda: graph.shortest_cycles(ring).collect())
    assert [r.node for r in sorted(rows, key=lambda r: r.place)] == [i * 7 % 1000 for i in range(n)] and b < 200


def test_a_long_chain_is_no_cycle(spark):
    chain = spark.range(60).selectExpr("id src", "id + 1 dst")
    none, n = jobs(spark, lambda: graph.shortest_cycles(chain).count())
    assert none == 0 and n < 150


def test_rings_side_by_side_and_loops(spark):
    rows = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (5, 6), (4, 4), (7, 8)]
    df = spark.createDataFrame(rows, "src int, dst int")
    assert {tuple(r) for r in graph.cycle_components(df).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 6)}
    assert {tuple(r) for r in graph.shortest_cycles(df).collect()} == {(1, 0, 1), (1, 1, 2), (4, 0, 4), (6, 0, 6)}
    assert {r.cycle for r in graph.shortest_cycles(df, most=2).collect()} == {1, 4}
    assert graph.shortest_cycles(df.limit(0)).count() == 0
