import numpy as np
import pytest

from strandloom.operators import walks

CHAIN = [("a", f"n{k}", f"n{k + 1}", 1.0 + k % 3) for k in range(12)] + [("b", "n0", "n5", 2.0), ("b", "n5", "x", 1.0)]
SETS = [("s", "n0"), ("s", "n5"), ("t", "x")]


def power(edges, sets, restart, delta=None):
    """Scores by dense power iteration, coupled with ``delta``, else one walk a layer."""
    layers = sorted({e[0] for e in edges})
    slots = sorted({(e[0], n) for e in edges for n in e[1:3]})
    at = {s: k for k, s in enumerate(slots)}
    m = np.zeros((len(slots), len(slots)))
    for layer, a, b, w in edges:
        m[at[layer, a], at[layer, b]] += w
        m[at[layer, b], at[layer, a]] += w
    m /= m.sum(1, keepdims=True)
    if delta is not None:
        m *= 1 - delta
        for layer, n in slots:
            others = [x for x in layers if x != layer and (x, n) in at]
            for x in others:
                m[at[layer, n], at[x, n]] = delta / len(others)
    out = {}
    for name in {s for s, _ in sets}:
        own = [n for s, n in sets if s == name]
        p0 = np.zeros(len(slots))
        for layer in layers:
            held = [n for n in own if (layer, n) in at]
            for n in held:
                p0[at[layer, n]] = 1 / len(held) if delta is None else 1 / len(layers) / len(own)
        v = p0
        for _ in range(400):
            v = (1 - restart) * v @ m + restart * p0
        out |= {(name, *slots[k]): v[k] for k in np.flatnonzero(v > 1e-13)}
    return out


@pytest.mark.parametrize("local", [walks.MAX_LOCAL_MOVES, 0])
def test_walks_converge_by_both_routes(spark, local):
    edges = spark.createDataFrame(CHAIN, "layer string, src string, dst string, weight double")
    seeds = spark.createDataFrame(SETS, "set_id string, node string")
    for got, want in (
        (walks.layer_walks(edges, seeds, max_local_moves=local), power(CHAIN, SETS, 0.35)),
        (walks.multiplex_walks(edges, seeds, max_local_moves=local), power(CHAIN, SETS, 0.7, 0.5)),
    ):
        scores = {(r.set_id, r.layer, r.node): r.score for r in got.collect()}
        assert want.keys() <= scores.keys()  # nodes far from every seed too
        assert max(abs(v - want.get(k, 0)) for k, v in scores.items()) < 1e-8


def test_rounds_are_bounded():
    assert walks.most_rounds(0.35, 1e-8) == 50 and walks.most_rounds(0.05, 1e-8) > 300
    with pytest.raises(ValueError):
        walks.most_rounds(0.0, 1e-8)


@pytest.mark.parametrize("local", [walks.MAX_LOCAL_MOVES, 0])
def test_unreached_seeds_keep_the_last_rank(spark, local):
    two = [("a", "n0", "n1", 1.0), ("a", "n1", "n2", 1.0), ("a", "n2", "n3", 1.0), ("a", "n3", "n4", 1.0), ("a", "u", "v", 1.0)]
    edges = spark.createDataFrame(two, "layer string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("s", "n0"), ("s", "n4"), ("s", "u")], "set_id string, node string")
    null = walks.random_sets(edges.selectExpr("src as node"), seeds)
    assert null.groupBy("set_id").count().where("count = 3").count() == 100
    got = {r.left_out: r for r in walks.essentiality(edges, seeds, null, max_local_moves=local).collect()}
    assert sorted(r.position for r in got.values()) == [1, 2, 3] and all(r.null_median is not None for r in got.values())
    assert got["u"].rank == 4.5  # n1, n2, n3 come first; u and v tie at 0
    assert got["n0"].rank == 5.0 and got["n4"].rank == 5.0  # four hops away, after n1, n2, n3 and v
