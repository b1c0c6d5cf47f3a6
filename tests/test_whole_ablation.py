from strandloom.operators import blocks, walks
from test_whole_blocks import frames, same, values


def test_seeds_are_worked_out_once_for_all_layers(spark, monkeypatch):
    edges, seeds = frames(spark)
    given, started = [], blocks.Network._started
    monkeypatch.setattr(blocks.Network, "_started", lambda self, rows, *rest: given.append(rows) or started(self, rows, *rest))
    few, many = (walks.ablation(edges, seeds, max_local_moves=m) for m in (0, 10**6))
    assert len(given) == 4 and all(rows is given[0] is not seeds for rows in given)
    assert same(values(few, ("layer", "set_id", "node"), "score"), values(many, ("layer", "set_id", "node"), "score"))
