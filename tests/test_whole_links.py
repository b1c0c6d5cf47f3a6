import pytest

from strandloom.operators import blocks, walks
from strandloom.plans import network_queries
from test_whole_blocks import EDGE, MORE, frames, same, values


def test_repeated_links_are_added_up(spark):
    """Of links that are mostly repeated one each is stored for walks, none is put aside for searches."""
    rows = [(layer, src, dst, w / 5) for layer, src, dst, w in MORE for _ in range(5)]
    edges, seeds = frames(spark, rows)
    stored = {}
    for merge in (False, True):
        net = blocks.Network(edges, merge=merge)
        stored[merge] = sum(len(blocks.get(net.root, f"a{k}")) for k in net.held), sum(blocks.get(net.root, f"w{k}").sum() for k in net.held)
        net.release()
    distinct = {(layer, *ends) for layer, src, dst, _ in MORE for ends in ((src, dst), (dst, src))}
    assert stored[True][0] == len(distinct) < stored[False][0] / 2 and abs(stored[False][1] - stored[True][1]) < 1e-9
    few, many = (values(walks.reduced_walks(e, seeds, max_local_moves=m), ("set_id", "node"), "score") for e, m in ((edges, 0), (frames(spark)[0], 10**6)))
    assert same(few, many) and few.keys() == many.keys()


@pytest.mark.parametrize("at_once", [1, 3])
def test_links_are_moved_in_pieces(spark, monkeypatch, at_once):
    monkeypatch.setattr(blocks, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(blocks, "NAMES_AT_ONCE", at_once)
    monkeypatch.setattr(blocks, "WHOLE_LINKS", 0)
    edges, seeds = frames(spark, [(layer, src, dst, 1.0) for layer, src, dst, _ in [*MORE, *MORE[:3], (None, "n1", "n2", 1.0)]])
    key = ("set_id", "node")
    few, many = (values(walks.reduced_walks(edges.where("layer is not null") if m else edges, seeds, how="sum", max_local_moves=m), key, "score") for m in (0, 10**6))
    assert same(few, many) and few.keys() == many.keys()


def test_walks_do_not_store_the_edges_first(spark, monkeypatch):
    def stored(df, tag):
        raise AssertionError(tag)

    monkeypatch.setattr(network_queries, "materialize", stored)
    for query in ("walk_reduced_arithmetic", "walk_reduced_geometric", "lines_of_evidence"):
        assert network_queries.QUERIES[query](spark, "/root/testdata/sf0.001").columns
