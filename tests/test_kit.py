from pyspark.sql import functions as F

from strandloom.functions import scalar as sc
from strandloom.operators import ranking as rk
from strandloom.operators import records as rc
from strandloom.operators import sampling as sa
from strandloom.sources import readers, writers


def test_ranks_and_normalisation(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0), ("b", 4, 5.0)], "g string, i int, v double")
    assert [r.rank for r in rk.competition_rank(df, ["g"], "v", "average").orderBy("i").collect()] == [1.5, 1.5, 3.0, 1.0]
    assert [r.normalized for r in rk.min_max(df, ["g"], "v").orderBy("i").collect()] == [1.0, 1.0, 0.0, 1.0]
    padded = rk.padded_epoch(df, [F.asc("i")], 3)
    assert padded.count() == 6 and padded.where("padding").count() == 2
    assert rk.padded_epoch(df.limit(0), [F.asc("i")], 3).collect() == []


def test_set_metrics_edges(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "b", "c"]), (None, []), ([], ["a"])], "p array<string>, t array<string>")
    got = [tuple(round(x, 4) for x in r) for r in df.select(*rc.set_metrics(F.col("p"), F.col("t")).values()).collect()]
    assert got == [(0.3333, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_greedy_choice_has_no_conflicts(spark):
    df = spark.createDataFrame([("g", k, [str(k % 4)]) for k in range(20)], "g string, i int, m array<string>")
    assert sa.conflict_free(df, "g", "i", "m", 10).count() == 4


def test_wilson(spark):
    low, high = sc.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_format_score(spark):
    df = spark.createDataFrame([("<think>a</think> so <answer>b</answer>",), ("none",), ("",)], "t string")
    assert [round(r[0], 6) for r in df.select(sc.format_score(F.col("t"))).collect()] == [1.0, 0.0, 0.0]


def test_edge_files_and_store(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("n1 n2 0.5\n# note\nn2 n2 1\nn3\n\nn2 n3 bad\n")
    (tmp_path / "b.tsv").write_text("n1\tn3\n")
    (tmp_path / "list").write_text("a.tsv\tA\nb.tsv\tB\t1\nc.tsv\tC\tfalse\n")
    net = readers.multiplex(spark, str(tmp_path / "list"))
    assert sorted(map(tuple, net.collect())) == [("A", "n1", "n2", 0.5), ("A", "n2", "n3", 1.0), ("B", "n1", "n3", 1.0)]
    writers.write_store(net, str(tmp_path / "store"))
    assert writers.read_store(spark, str(tmp_path / "store")).count() == 3
    assert writers.network_json(net).count() == 2


def test_matrix_and_seeds(spark, tmp_path):
    (tmp_path / "m").write_text("INDEX\tx\ty\nx\tNA\t\ny\t0.25\t0\n")
    pairs = readers.distance_pairs(readers.labelled_matrix(spark, str(tmp_path / "m"))).collect()
    assert [tuple(p) for p in pairs] == [("x", "y", 0.25)]
    (tmp_path / "s").write_text("s1\ta\tb\ns2\tc\n")
    assert readers.seed_sets(spark, str(tmp_path / "s"), True).count() == 3
