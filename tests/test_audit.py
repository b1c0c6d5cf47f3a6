import json

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scalar as sc
from strandloom.operators import annotate as an
from strandloom.operators import audit as au
from strandloom.operators import ranking as rk
from strandloom.operators import sampling as sa
from strandloom.operators import scoring as so
from strandloom.sources import readers, writers


def test_split_counts(spark):
    sizes = {1: (1, 0, 0), 5: (5, 0, 0), 10: (8, 1, 1), 15: (11, 2, 2), 25: (21, 2, 2)}
    df = spark.createDataFrame([(n, k) for n in sizes for k in range(n)], "g int, i int")
    got = {r.g: (r.train, r.val, r.test) for r in rk.stratified_split(df, ["g"], [F.asc("i")]).groupBy("g").pivot("split", ["train", "val", "test"]).count().fillna(0).collect()}
    assert got == sizes


def test_tasks_without_metrics_or_sets(spark):
    df = spark.createDataFrame([("recovery", None, None), ("none", "insufficient_support", ["A"])], "k string, s string, p array<string>")
    none = {k: F.lit(None).cast("double") for k in ("jaccard", "precision", "recall")}
    out = so.task_success(F.col("k"), none, F.col("s"), so.seed_retention(F.lit(None).cast("array<string>"), F.col("p")))
    rows = df.select(out["level"].alias("level"), out["reasons"].alias("reasons")).collect()
    assert rows[0].level == "negative" and len(rows[0].reasons) == 3
    out = so.none_success(F.col("s"), F.col("p"))
    assert [r.level for r in df.select(out["level"].alias("level")).collect()] == ["partial", "partial"]


def test_equal_groups_keep_the_smaller_name(spark):
    df = spark.createDataFrame([("t", "b", ["A", "B"], ["A", "B", "C"], "recovery"), ("t", "a", ["A", "B"], ["A", "B", "C"], "recovery"), ("t", "c", ["A", "X"], ["A", "B", "C"], "recovery")], "t string, g string, i array<string>, w array<string>, k string")
    best = so.best_group(df, ["t"], "g", "i", "w", "k").collect()
    assert [(r.g, r.false_positives) for r in best] == [("a", 0)]


def test_pairs_respect_margin_and_safety(spark):
    rows = [("p", b, True, n, n, "recovery", d, 0.5, 0.5, 0.5) for b, n, d in (("a", 1.0, 0.4), ("b", 0.9, 0.1), ("c", 0.5, 0.9), ("d", 0.2, 0.1), ("e", 0.0, 0.0))]
    rows += [("q", "a", True, 1.0, 1.0, "none", 0.0, 0.0, 0.0, 0.0), ("q", "b", False, 0.0, 0.0, "none", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pool string, branch_id string, usable boolean, normalized double, total double, kind string, delta double, jaccard double, recall double, precision double")
    got = {(r.chosen, r.rejected, r.difficulty) for r in so.preference_pairs(df, ["pool"], 0.15).collect()}
    assert got == {("a", "e", "easy"), ("a", "d", "medium")}  # c is unsafe, b within the margin


def test_blocked_fields_at_any_depth(spark):
    text = json.dumps({"a": [{"secret": 1}, {"b": {"secret": {"secret": 2}}}], "ok": None})
    df = spark.createDataFrame([(1, text), (2, None), (3, "{bad"), (4, "")], "id int, t string")
    assert sorted(r.path for r in au.blocked_paths(df, "id", "t", ["secret"]).collect()) == ["a[0].secret", "a[1].b.secret", "a[1].b.secret.secret"]


def test_promised_matches_are_enforced(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 1), (3, 1)], "k int, w int")
    with pytest.raises(au.NoMatch):
        au.whole_join(a, b, "k")
    assert au.whole_join(a, b.replace(3, 2, "k"), "k").count() == 2
    assert [r.k for r in au.excluded(a, a.where("k = 1"), "k", ["v"]).collect()] == [2]
    with pytest.raises(au.NoMatch):
        au.excluded(a, spark.createDataFrame([(1, "changed")], "k int, v string"), "k", ["v"])
    with pytest.raises(au.NoMatch):
        au.public_rows(a.select("k", F.struct("v").alias("s")), ["v"])


def test_epochs_are_padded_and_cut(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    plan = au.epoch_plan(df, "k", 2, 4)
    assert plan.count() == 24 and plan.where("padding").count() == 4 and plan.agg(F.max("step")).first()[0] == 5
    assert plan.groupBy("epoch", "position").count().where("count > 1").isEmpty()
    assert au.epoch_plan(df.limit(0), "k", 2, 4).collect() == []
    assert au.exposure(au.epoch_plan(df, "k", 2, 4, 1), "k").agg(F.sum("uses")).first()[0] == 4


def test_conflict_free_choice_is_whole_or_an_error(spark):
    df = spark.createDataFrame([("g", k, [str(k // 2)]) for k in range(8)], "g string, i int, m array<string>")
    assert sa.conflict_free_exactly(df, "g", "i", "m", 4).count() == 4
    with pytest.raises(ValueError):
        sa.conflict_free_exactly(df, "g", "i", "m", 5, attempts=2)


def test_answer_shape(spark):
    cases = {
        "<think>a</think> and <answer>b</answer>": 1.0, "<think>a</think><answer>b</answer>": 0.9, "<answer>b</answer><think>a</think>": 0.7,
        "<think>a</think><think>b</think><answer>c</answer>": 0.4, "none": 0.0, "": 0.0, f"<think>{'x' * 4001}</think> - <answer>b</answer>": 0.8,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [round(r[0], 6) for r in df.select(sc.format_score(F.col("t"))).collect()] == list(cases.values())
    words = spark.createDataFrame([("They were GENE_1, the naïve (best)!",)], "t string").select(sc.answer_words(F.col("t"))).first()[0]
    assert sorted(words) == ["best", "gene1", "naïve"]


def test_list_items_are_trimmed_whole(spark):
    row = spark.createDataFrame([(["a1 ", None, " b1", "a1", " "], " x1; y2 ;;x1")], "i array<string>, t string").select(an.ordered_distinct(F.col("i")), sc.list_field(F.col("t")), an.nfkc(F.lit(" ﬁ x "))).first()
    assert tuple(row) == (["a1", "b1"], ["x1", "y2", "x1"], "fi x")


def test_graph_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("n1 n2 0.5\nn2 n2 1\nn2 n1 0.7\n")
    (tmp_path / "list").write_text("a.tsv\tA\n")
    assert sorted(map(tuple, readers.multiplex(spark, str(tmp_path / "list"), overwrite=True).collect())) == [("A", "n1", "n2", 0.7), ("A", "n2", "n2", 1.0)]
    (tmp_path / "m").write_text("INDEX\tx\ty\nx\t0\t0.5\ny\t0.25\t0\n")
    with pytest.raises(ValueError):
        readers.distance_pairs(readers.labelled_matrix(spark, str(tmp_path / "m")))
    (tmp_path / "l.csv").write_text("review_item_id,chosen\nr1,b0\n")
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "l.csv"), ["review_item_id", "chosen", "notes"]).collect()] == [("r1", "b0", None)]
    ranks = spark.createDataFrame([("s", "x", 0.5, 1.5)], "set_id string, node string, score double, rank double")
    seeds = spark.createDataFrame([("s", "y"), ("s", "z")], "set_id string, node string")
    row = writers.evidence_table(ranks, seeds, "net").first()
    assert (row.NodeNames, row["rank"], row.num_seeds, row.seed_geneset) == ("x", 1, 2, "y,z")
    writers.write_rounded_network(spark.createDataFrame([("A", "x", "y", 0.12345)], "layer string, src string, dst string, weight double"), str(tmp_path / "net"))
    assert [r.value for r in spark.read.text(str(tmp_path / "net")).collect()] == ["x\ty\t0.123"]
