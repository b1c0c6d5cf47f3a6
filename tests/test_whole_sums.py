import numpy as np

from strandloom.operators import vectors


def test_distances_of_all_sets_in_sums(spark):
    rng = np.random.default_rng(5)
    v = {s: {f"n{k}": float(rng.integers(0, 4)) / 7 for k in range(40) if rng.random() < 0.7} for s in "abc"}
    rows = spark.createDataFrame([(s, n, x) for s, own in v.items() for n, x in own.items()], "set_id string, node string, score double")
    names = sorted({n for own in v.values() for n in own})
    full = {s: np.array([own.get(n, 0.0) for n in names]) for s, own in v.items()}
    rank = {s: np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x]) for s, x in full.items()}
    got = {(r.a, r.b): r for r in vectors.set_distances(rows).collect()}
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]
    for (a, b), r in got.items():
        x, y = full[a], full[b]
        want = 1 - np.corrcoef(x, y)[0, 1], 1 - x @ y / np.sqrt((x @ x) * (y @ y)), 1 - np.corrcoef(rank[a], rank[b])[0, 1]
        assert np.allclose((r.pearson, r.cosine, r.spearman), want, atol=1e-9)
