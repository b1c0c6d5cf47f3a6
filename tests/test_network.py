import pytest
from pyspark.sql import functions as F

from strandloom.operators import edges as ed
from strandloom.operators import graph, vectors, walks

E = "layer string, src string, dst string, weight string"
TOY = [("ppi", "G1", "G2", "1.0"), ("ppi", "G2", "G3", "0.9"), ("coexp", "G1", "G3", "0.8"), ("coexp", "G3", "G4", "0.7")]


@pytest.fixture(scope="module")
def toy(spark):
    return ed.clean(spark.createDataFrame(TOY, E))


def test_clean_defaults(spark):
    df = ed.clean(spark.createDataFrame([("a", "x", "y", None), ("a", "x", None, "1"), ("a", "x", "z", "bad")], E))
    assert [(r.dst, r.weight) for r in df.orderBy("dst").collect()] == [("y", 1.0), ("z", 1.0)]


def test_neighbours_and_subgraph(spark, toy):
    got = {(r.layer, r.node): r.neighbours for r in ed.neighbours(toy).collect()}
    assert got["ppi", "G1"] == ["G2"] and got["coexp", "G1"] == ["G3"]
    nodes = spark.createDataFrame([("G1",), ("G2",), ("G4",), ("none",)], "node string")
    assert {r.layer: (r.present, r.edges) for r in ed.induced_summary(toy, nodes).collect()} == {"ppi": (2, 1), "coexp": (2, 0)}
    with pytest.raises(ValueError):
        ed.chosen_layers(toy, ["none"])
    assert ed.chosen_layers(toy, ["ALL", "*"]).count() == 4


def test_shortest_path(toy):
    row = graph.shortest_path(toy, "G2", "G4").first()
    assert (row.hops, row.path) == (2, ["G2", "G3", "G4"])
    assert graph.shortest_path(toy, "G2", "nowhere").first().path is None


def test_components(spark):
    df = spark.createDataFrame([("l", f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(120) if k != 60] + [("l", "z", "z", 1.0)], "layer string, src string, dst string, weight double")
    got = {r.component: r.size for r in graph.component_summary(df).collect()}
    assert got == {"n000": 61, "n061": 60, "z": 1}
    assert graph.components(df.limit(0)).collect() == []


def test_walks_keep_mass_and_order(spark, toy):
    seeds = spark.createDataFrame([("s", "G1"), ("s", "G1"), ("s", "absent")], "set_id string, node string")
    scores = walks.layer_walks(toy, seeds, 0.35, 6)
    mass = {r.layer: r.m for r in scores.groupBy("layer").agg(F.sum("score").alias("m")).collect()}
    assert all(abs(m - 1) < 1e-9 for m in mass.values())
    ranked = walks.ranked(walks.mean_over_layers(scores, toy), seeds)
    assert ranked.orderBy("rank").first().node == "G1"
    coupled = walks.reduced(walks.multiplex_walks(toy, seeds.where("node = 'G1'"), 0.7, 0.5, 4), toy, "geometric")
    zero = {r.node for r in coupled.where("score = 0").collect()}
    assert zero == {"G2", "G4"}  # each is missing in one layer


def test_vector_guard(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, None)], "id int, v array<double>")
    got = {(r.a, r.b): r for r in vectors.pairwise(df, "id", "v", F.lit(True)).collect()}
    assert got[0, 1].pearson == 0 and round(got[1, 2].pearson, 9) == -1 and round(got[1, 2].spearman, 9) == -1 and got[1, 2].dot == 10
