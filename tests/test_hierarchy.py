import random

import pytest

from strandloom.operators import hierarchy as hi


def brute(nodes, parent):
    out = {}
    for n in nodes:
        path, at = [n], {n: 0}
        x = n
        while x in parent:
            x = parent[x]
            if x in at:
                cycle = path[at[x] :]
                out[n] = (min(cycle), -1, "on_cycle" if at[x] == 0 else "below_cycle")
                break
            at[x] = len(path)
            path.append(x)
        else:
            out[n] = (path[-1], len(path) - 1, "rooted")
    return out


def forest(seed, n=300):
    rng = random.Random(seed)
    parent = {}
    for v in range(n):
        roll = rng.random()
        if roll < 0.05:
            continue
        parent[v] = v - 1 if roll < 0.5 and v else rng.randrange(n)
    for v in range(n, 2 * n):  # a star under one hub
        parent[v] = 3
    return list(range(2 * n)), parent


@pytest.mark.parametrize("seed,limit", [(1, 1_000_000), (2, 60)])
def test_matches_brute_force_both_ways(spark, seed, limit):
    nodes, parent = forest(seed)
    links = spark.createDataFrame([(v, parent.get(v)) for v in nodes], "node_id bigint, parent bigint")
    rows = hi.hierarchy(links, limit, paths=True).collect()
    want = brute(nodes, parent)
    assert len(rows) == len(nodes)
    assert {r.node_id: (r.root_id, r.depth, r.state) for r in rows} == want
    below = {}
    for r in rows:
        if r.state == "rooted":
            assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.depth + 1
            for a in r.path[:-1]:
                below[a] = below.get(a, 0) + 1
        else:
            assert r.path is None
    assert all(r.n_descendants == below.get(r.node_id, 0) for r in rows if r.state == "rooted")
    cycles = {want[v][0] for v in nodes if want[v][2] == "on_cycle"}
    assert sum(r.closes_cycle for r in rows) == len(cycles)


NODES = "node_id bigint, left_id bigint, right_id bigint, exported_at timestamp, parent bigint"
INDEX = "node_id bigint, parent_by_node bigint, exported_at timestamp"


def test_dirty_rows(spark):
    from datetime import datetime as t

    old, new = t(2024, 1, 1), t(2024, 2, 1)
    nodes = spark.createDataFrame(
        [(1, 9, 8, old, 0), (1, 2, 3, new, 0), (1, 2, 3, new, 0), (2, -1, -1, old, 0), (3, None, 77, None, 0), (None, 1, 2, new, 0), (8, -1, -1, new, 0)],
        NODES,
    )
    index = spark.createDataFrame([(4, 3, old), (4, 3, old), (2, 1, new), (5, 99, new), (3, None, new), (None, 1, new)], INDEX)
    got = {r.node_id: r.parent for r in hi.child_links(nodes, index).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 3, 5: None, 8: None}


def test_empty(spark):
    links = hi.child_links(spark.createDataFrame([], NODES), spark.createDataFrame([], INDEX))
    assert hi.hierarchy(links).collect() == []


def test_self_link_is_a_cycle(spark):
    rows = hi.hierarchy(spark.createDataFrame([(1, 1), (2, 1)], "node_id bigint, parent bigint")).collect()
    assert {r.node_id: r.state for r in rows} == {1: "on_cycle", 2: "below_cycle"}


def test_descendants(spark):
    tree = hi.hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node_id bigint, parent bigint"))
    got = {tuple(r) for r in hi.descendants(tree, lambda n: n < 3).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_deep_chain_is_linear(spark):
    """A chain of 500,000 nodes: whole in one task, and cut into pieces."""
    n = 500_000
    links = spark.range(n).selectExpr("id as node_id", "case when id > 0 then id - 1 end as parent")
    for most in (n, 100_000):
        got = hi.hierarchy(links, most).selectExpr("count(*) as n", "sum(depth) as d", "sum(n_descendants) as b", "sum(case when pre = node_id and root_id = 0 then 1 else 0 end) as ok").first()
        assert tuple(got) == (n, n * (n - 1) // 2, n * (n - 1) // 2, n)


@pytest.mark.parametrize("limit", [60])
def test_numbers_are_a_pre_order(spark, limit):
    nodes, parent = forest(3)
    links = spark.createDataFrame([(v - 50, parent[v] - 50 if v in parent else None) for v in nodes], "node_id bigint, parent bigint")
    rows = {r.node_id: r for r in hi.hierarchy(links, limit).collect()}
    by_comp = {}
    for r in rows.values():
        by_comp.setdefault(r.root_id, []).append(r.pre)
    assert all(sorted(p) == list(range(len(p))) for p in by_comp.values())
    for v in nodes:
        if v in parent and v - 50 != rows[v - 50].root_id:
            up, r = rows[parent[v] - 50], rows[v - 50]
            assert up.pre < r.pre and r.pre + r.n_descendants <= up.pre + up.n_descendants


def test_subtree_items_come_from_paths(spark):
    from strandloom.operators import trees

    tree = hi.hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 1)], "node_id bigint, parent bigint"), paths=True)
    leaves = spark.createDataFrame([(2, "A"), (3, "B")], "node_id bigint, item string")
    assert {tuple(r) for r in trees.subtree_items(tree, leaves).collect()} == {(1, "A"), (1, "B"), (2, "A"), (3, "B")}
