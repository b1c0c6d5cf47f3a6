import numpy as np
import pytest

from strandloom.operators import blocks, walks
from test_whole_walks import CHAIN, SETS, power

EDGE = "layer string, src string, dst string, weight double"
MORE = [*CHAIN, ("b", "n5", "n5", 3.0), ("b", "n0", "n5", 1.5), ("c", "x", "n3", 1.0), ("c", "lone", "n1", 2.0)]


def frames(spark, edges=MORE):
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame([*SETS, ("t", "absent")], "set_id string, node string")


def values(rows, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in rows.collect()}


def same(a, b):
    return max(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()) < 1e-9


def test_large_networks_are_walked_without_joins_in_each_round(spark, monkeypatch):
    """Tables are written before and after the rounds only, whatever their number."""
    edges, seeds = frames(spark, CHAIN)
    written = []
    for module in (walks, blocks):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, keep=keep: written.append(tag) or keep(df, tag))
    got = values(walks.layer_walks(edges, seeds.where("node <> 'absent'"), 0.35, max_local_moves=0), ("set_id", "layer", "node"), "score")
    assert len(written) <= 4
    want = power(CHAIN, SETS, 0.35)
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


@pytest.mark.parametrize("whole", [0, 10**6])
def test_blocks_agree_with_one_task(spark, monkeypatch, whole):
    monkeypatch.setattr(blocks, "SCORE_BYTES", 1)  # one seed set at a time
    monkeypatch.setattr(blocks, "WHOLE_SLOTS", whole)
    edges, seeds = frames(spark)
    key = ("set_id", "layer", "node")
    few, many = (values(walks.multiplex_walks(edges, seeds, max_local_moves=m), key, "score") for m in (0, 10**6))
    assert same(few, many) and few


@pytest.mark.parametrize("node, links", [("n5", 10**6), ("n5", 0), ("x", 0), ("lone", 10**6), ("nobody", 0)])
def test_perturbation_in_blocks(spark, monkeypatch, node, links):
    monkeypatch.setattr(blocks, "WHOLE_LINKS", links)
    edges, seeds = frames(spark)
    key = ("set_id", "node")
    few, many = (walks.perturbation(edges, seeds, node, max_local_moves=m) for m in (0, 10**6))
    assert same(values(few, key, "score"), values(many, key, "score")) and same(values(few, key, "base"), values(many, key, "base"))


def test_ablation_in_blocks(spark):
    edges, seeds = frames(spark)
    key = ("layer", "set_id", "node")
    few, many = (walks.ablation(edges, seeds, max_local_moves=m) for m in (0, 10**6))
    assert same(values(few, key, "score"), values(many, key, "score")) and same(values(few, key, "base"), values(many, key, "base"))


@pytest.mark.parametrize("links", [0, 10**6])
def test_tables_of_links_and_blocks_read_again_agree(spark, monkeypatch, links):
    """Of four seed sets in a task, also where it does not hold the links."""
    plain = [e for e in MORE if e[1] != e[2]]
    net = blocks.Network(spark.createDataFrame(plain, EDGE))
    sets = [(f"s{k}", f"n{k}") for k in range(4)]
    seen = {}
    prepare = blocks.Network._walk_whole

    def keep(self, starts, names, tag, *rest):
        monkeypatch.setattr(blocks, "WHOLE_LINKS", links)
        shape = (self.n, len(self.layers), self.width, self.blocks)
        slots = np.array([slot for _, slot, _ in starts])
        for n_sets in (1, 4):
            whole = blocks.Whole(self.root, tag, shape, self.held, slots, 99, 0.5, 0.5, n_sets)
            p0 = np.zeros((len(whole.slots), 4))
            for s, slot, value in starts:
                p0[whole.place[slot], s] = value
            seen[n_sets] = whole.walk(p0, 0.7, 1e-12, 99, ValueError)
        return prepare(self, starts, names, tag, *rest)

    monkeypatch.setattr(blocks.Network, "_walk_whole", keep)
    got = net.walk(spark.createDataFrame(sets, "set_id string, node string"), 0.7, 1e-12, 99, 0.5)
    want = power(plain, sets, 0.7, 0.5)
    assert np.allclose(seen[1], seen[4], atol=1e-12)
    scores = values(got, ("set_id", "layer", "node"), "score")
    assert same(scores, want)
    net.release()


def test_links_of_a_block_are_whole(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f"p{rng.integers(50)}", f"s{rng.integers(9)}", 1.0) for _ in range(300)]
    net = blocks.Network(spark.createDataFrame(rows, EDGE))
    assert sum(len(blocks.get(net.root, f"a{k}")) for k in net.held) == 600
    net.release()
