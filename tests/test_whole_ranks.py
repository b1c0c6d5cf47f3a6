from pyspark.sql import functions as F

from strandloom.operators import walks
from test_whole_blocks import frames, values


def test_ranks_come_from_distinct_scores(spark):
    rows = spark.createDataFrame([("s", f"n{k}", float(k // 2)) for k in range(6)], "set_id string, node string, score double")
    seeds = spark.createDataFrame([("s", "n5")], "set_id string, node string")
    got = walks.ranked(rows, seeds, drop_seeds=True)
    assert values(got, ("node",), "rank") == {("n4",): 1.0, ("n3",): 2.5, ("n2",): 2.5, ("n1",): 4.5, ("n0",): 4.5}
    assert "Window" not in got.select("node", "score")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_best_are_the_top_of_all_ranks(spark):
    rows = spark.createDataFrame([(s, f"n{k}", float(k % 4)) for s in "st" for k in range(12)], "set_id string, node string, score double")
    seeds = spark.createDataFrame([("s", "n3"), ("t", "n1"), ("t", "absent")], "set_id string, node string")
    for k in (1, 4, 5, 20):
        want = walks.top(walks.ranked(rows, seeds, drop_seeds=True, ties="min"), k).select("set_id", "node", "score", "rank")
        assert sorted(walks.best(rows, seeds, k).select("set_id", "node", "score", "rank").collect()) == sorted(want.collect())


def test_tasks_that_walk_tell_only_what_can_be_best(spark):
    edges, seeds = frames(spark, [("a", f"n{k}", f"n{k + 1}", 1.0) for k in range(11)] + [("a", "n0", f"m{k}", 1.0) for k in range(3)])
    for k in (1, 2, 5, 30):
        every, few = (walks.reduced_walks(edges, seeds, how="arithmetic", max_local_moves=0, best=b) for b in (None, k))
        want, got = (walks.best(x.withColumn("score", F.round("score", 8)), seeds, k).select("set_id", "node", "score", "rank") for x in (every, few))
        assert sorted(got.collect()) == sorted(want.collect())
        assert (few.count() < every.count()) == (k < 30)
