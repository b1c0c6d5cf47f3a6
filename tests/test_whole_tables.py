import numpy as np
import pytest

from strandloom.operators import blocks, walks
from strandloom.plans import network_queries
from test_whole_blocks import EDGE, MORE, frames, same, values


def test_tables_hold_every_link_once(spark, monkeypatch):
    """From the few nodes with many links and from the others, over several tiles."""
    monkeypatch.setattr(blocks, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = [(x, f"p{rng.integers(70)}", f"s{rng.integers(3)}", float(rng.integers(1, 4))) for x in "ab" for _ in range(200)] + [("a", "p1", "p1", 2.0), ("a", "s1", "s1", 5.0)]
    net = blocks.Network(spark.createDataFrame(rows, EDGE))
    order, hubs = blocks.ordered(net.root, net.n, net.width, net.held)
    assert hubs == 3 and sorted(order.tolist()) == list(range(net.n))
    got = np.zeros((2 * net.n, 2 * net.n))
    for k in net.held:
        tables, places, weights, slots = blocks.tabled(net.root, k, 2, net.width, order, hubs)
        link = slot = 0
        for tile, d, many in tables.tolist():
            assert places[link : link + d * many].max() < 8
            into = np.tile(slots[slot : slot + many], d)
            np.add.at(got, (tile + places[link : link + d * many].astype(int), into), weights[link : link + d * many])
            link, slot = link + d * many, slot + many
    number = {x: k for k, x in enumerate(blocks.names_of(net.root).take(order).to_pylist())}
    want = np.zeros_like(got)
    for layer, src, dst, w in rows:
        a, b = ((layer == "b") * net.n + number[x] for x in (src, dst))
        want[a, b] += w
        want[b, a] += w * (a != b)
    assert np.array_equal(got, want)
    net.release()


@pytest.mark.parametrize("weight", [1.0, None])
def test_walks_over_stored_tables(spark, monkeypatch, weight):
    monkeypatch.setattr(blocks, "WHOLE_LINKS", 3)
    stored = []
    keep = blocks.Network._store_tables
    monkeypatch.setattr(blocks.Network, "_store_tables", lambda self, *a: keep(self, *a) or stored.append(self._tabled))
    edges, seeds = frames(spark, [(layer, src, dst, weight or w) for layer, src, dst, w in MORE])
    key = ("set_id", "node")
    for how in walks.REDUCTIONS:
        few, many = (values(walks.reduced_walks(edges, seeds, how=how, max_local_moves=m), key, "score") for m in (0, 10**6))
        assert same(few, many) and few.keys() == many.keys()
    assert stored == [True] * 3


def test_vectors_are_walked_on_numbers(spark, monkeypatch):
    seen = []
    keep = walks.reduced_walks
    monkeypatch.setattr(walks, "reduced_walks", lambda edges, seeds, *a, **o: seen.append((edges.schema, seeds.schema)) or keep(edges, seeds, *a, **o))
    got = network_queries.QUERIES["walk_reduced_geometric"](spark, "/root/testdata/sf0.001")
    assert {s[x].dataType.simpleString() for e, n in seen for s, x in ((e, "src"), (e, "dst"), (n, "node"))} == {"bigint"}
    assert {r.node[0] for r in got.select("node").collect()} == {"P", "S"}
