import pytest

from strandloom.operators import walks
from test_whole_blocks import frames, same, values


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("how", ["arithmetic", "geometric"])
def test_reductions_of_a_network_in_blocks(spark, how):
    edges, seeds = frames(spark)
    few, many = (values(walks.reduced_walks(edges, seeds, how=how, max_local_moves=m), ("set_id", "node"), "score") for m in (0, 10**6))
    assert same(few, many) and few.keys() == many.keys()


def test_means_of_a_network_in_blocks(spark):
    edges, seeds = frames(spark)
    few, many = (values(walks.layer_means(edges, seeds, tolerance=1e-12, max_local_moves=m), ("set_id", "node"), "score") for m in (0, 10**6))
    assert near(few, many) and few
