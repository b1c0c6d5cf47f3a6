from strandloom.operators import blocks, walks
from test_whole_blocks import EDGE, MORE, values


def test_ranks_of_left_out_nodes_in_blocks(spark, monkeypatch):
    """No table of scores is written, and the ranks are those of one task."""
    written, keep = [], blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, tag: written.append(tag) or keep(df, tag))
    edges = spark.createDataFrame(MORE, EDGE)
    sets = [("s", "n0"), ("s", "n5"), ("s", "lone"), ("t", "x"), ("t", "absent"), ("u", "absent"), ("u", "gone")]
    loo = walks.leave_one_out(spark.createDataFrame(sets, "set_id string, node string"))
    few, many = (values(walks.left_out_ranks(edges, loo, 0.7, 0.5, m), ("set_id", "left_out"), "rank") for m in (0, 10**6))
    assert few == many and len(few) == 7 and written == ["ranks"]
