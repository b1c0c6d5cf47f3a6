import pytest
from pyspark.sql import functions as F

from strandloom.operators import hierarchy as hi
from test_hierarchy import brute, forest


@pytest.mark.parametrize("limit", [1_000_000, 60])
def test_intervals_hold_all_nodes_below_every_node(spark, limit):
    nodes, parent = forest(1)
    links = spark.createDataFrame([(v, parent.get(v)) for v in nodes], "node_id bigint, parent bigint")
    want = set()
    for n in nodes:
        x, seen = n, set()
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.add(x)
            want.add((x, n))
    states = {s for _, _, s in brute(nodes, parent).values()}
    assert states == {"rooted", "on_cycle", "below_cycle"}
    spans = hi.intervals(links, limit)
    assert spans.count() == len(nodes)
    assert {(r.node_id, r.descendant_id) for r in hi.below(spans, lambda x: F.lit(True)).collect()} == want
