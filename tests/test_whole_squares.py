import numpy as np

from strandloom.operators import blocks
from test_whole_blocks import EDGE, MORE


def test_tables_of_links_keep_to_a_layer(spark):
    """All links are in tables, each of one layer and one number of links, whose scores lie close together."""
    net = blocks.Network(spark.createDataFrame(MORE, EDGE))
    starts, _, tag, *walk, _ = net._started(spark.createDataFrame([("s", "n0")], "set_id string, node string"), 0.5)
    shape = (net.n, len(net.layers), net.width, net.blocks)
    plain, tables = (blocks.Whole(net.root, tag, shape, net.held, np.array([s for _, s, _ in starts]), 99, *walk, sets) for sets in (1, 4))
    assert all(len(np.unique(tables.slots[to] % tables.n_layers)) == 1 for to, _, _ in tables.squares)
    assert sum(a.size for _, a, _ in tables.squares) == len(plain.links[0])
    now = np.random.default_rng(1).random((len(plain.slots), 4))
    assert np.allclose(plain.moved(now), tables.moved(now))
    net.release()
