"""Record operators: set metrics, resolution, deduplication, summaries, pair mining.

Sets are arrays; null arrays count as empty; repeats inside an array count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalar import safe_divide, wilson


def set_metrics(predicted: Column, target: Column) -> dict[str, Column]:
    """Jaccard (1 if both are empty), precision and recall (0 without a denominator)."""
    none = F.array().cast("array<string>")
    p, t = F.array_distinct(F.coalesce(predicted, none)), F.array_distinct(F.coalesce(target, none))
    both = F.size(F.array_intersect(p, t)).cast("double")
    union = F.size(F.array_union(p, t))
    return {
        "jaccard": F.when(union == 0, 1.0).otherwise(both / union),
        "precision": safe_divide(both, F.size(p)),
        "recall": safe_divide(both, F.size(t)),
    }


#: Weights of (jaccard, precision, recall) by kind of task (fixed values).
SCORE_WEIGHTS = {"recovery": (0.2, 0.2, 0.6), "refinement": (0.2, 0.6, 0.2), "explanation": (1 / 3, 1 / 3, 1 / 3)}


def weighted_set_score(kind: Column, metrics: dict[str, Column]) -> Column:
    """Weighted sum of the set metrics; null for a kind without weights."""
    out = None
    for name, (j, p, r) in SCORE_WEIGHTS.items():
        value = j * metrics["jaccard"] + p * metrics["precision"] + r * metrics["recall"]
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def resolve(requests: DataFrame, scopes: list[DataFrame]) -> DataFrame:
    """(request_id, candidate, scope): the candidate of the first scope that has exactly one.

    ``requests`` has (request_id, scope, term), each scope table (term, candidate). Requests
    without such a scope are left out.
    """
    found = None
    for k, scope in enumerate(scopes):
        part = requests.where(F.col("scope") == k).join(scope.distinct(), "term").select("request_id", "scope", "candidate")
        found = part if found is None else found.unionByName(part)
    single = found.groupBy("request_id", "scope").agg(F.count_distinct("candidate").alias("n"), F.min("candidate").alias("candidate")).where("n = 1")
    return single.groupBy("request_id").agg(F.min(F.struct("scope", "candidate")).alias("b")).select("request_id", "b.candidate", "b.scope")


def dedup_sets(df: DataFrame, key: str, items: str) -> DataFrame:
    """(set_key, primary_id, n, ids): one row per distinct set, the smallest id its primary."""
    text = F.concat_ws(",", F.array_sort(F.array_distinct(F.col(items))))
    return df.groupBy(text.alias("set_key")).agg(
        F.min(key).alias("primary_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ids")
    )


def shared_items(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): pairs of groups with common items, by an equi-join on the item."""
    rows = df.select(group, item).distinct()
    a, b = rows.toDF("a", "_i"), rows.toDF("b", "_i")
    return a.join(b, "_i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def split_report(df: DataFrame, split: str, kind: str) -> DataFrame:
    """(split, kind, n, share): counts and shares within each split."""
    n = df.groupBy(split, kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def items_in_several_splits(df: DataFrame, item: str, split: str) -> DataFrame:
    """(item, n_splits, n): items of more than one split."""
    return df.groupBy(item).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def rate_summary(df: DataFrame, groups: list[str], flags: list[str]) -> DataFrame:
    """Count, hits, rate and 95% interval of every flag per group; null flags count as false."""
    long = df.select(
        *groups, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("hit")) for f in flags])).alias("_x")
    )
    counted = long.groupBy(*groups, F.col("_x.flag").alias("flag")).agg(F.count("*").alias("n"), F.count_if("_x.hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counted.select(*groups, "flag", "n", "hits", safe_divide(F.col("hits"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def macro_gate(rates: DataFrame, rate: str, threshold: float) -> DataFrame:
    """(mean, least, passed): over groups, whether every rate reaches the threshold."""
    return rates.agg(F.avg(rate).alias("mean"), F.min(rate).alias("least"), F.every(F.col(rate) >= threshold).alias("passed"))


def cardinalities(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n_a, n_b, ambiguous_b, largest): distinct sides of a many-to-many map, the b's with
    several a's, and the most a's of one b."""
    per = pairs.distinct().groupBy(b).agg(F.count_distinct(a).alias("n"))
    sides = pairs.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))
    return sides.crossJoin(F.broadcast(per.agg(F.count_if(F.col("n") > 1).alias("ambiguous_b"), F.max("n").alias("largest"))))  # one row each


def service_metrics(df: DataFrame, tool: str, seconds: str, failed: Column) -> DataFrame:
    """(tool, n, errors, mean, p95, slowest): p95 is the value at the rounded place 0.95 (n - 1)
    of the sorted ones, picked by rank so that no group is gathered."""
    w = Window.partitionBy(tool)
    placed = df.select(F.col(tool), F.col(seconds).alias("_s"), failed.alias("_f")).withColumn(
        "_p", F.row_number().over(w.orderBy("_s")) - 1
    ).withColumn("_n", F.count("*").over(w))
    at = F.bround((F.col("_n") - 1) * 0.95)
    return placed.groupBy(tool).agg(
        F.count("*").alias("n"), F.count_if("_f").alias("errors"), F.avg("_s").alias("mean"),
        F.max(F.when(F.col("_p") == at, F.col("_s"))).alias("p95"), F.max("_s").alias("slowest"),
    )


def recovered_by(ranked: DataFrame, targets: DataFrame, task: str, item: str, rank: str, ks: list[int]) -> DataFrame:
    """(k, recovered, rate): tasks with a target within the first k, for each k."""
    best = targets.select(task, item).distinct().join(ranked, [task, item], "left").groupBy(task).agg(F.min(rank).alias("best"))
    return best.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "best").groupBy("k").agg(
        F.count_if(F.col("best") <= F.col("k")).alias("recovered"),
        (F.count_if(F.col("best") <= F.col("k")) / F.count("*")).alias("rate"),
    )


def mine_pairs(df: DataFrame, pool: list[str], item: str, score: str, margin: float) -> DataFrame:
    """(pool, chosen, rejected, margin): within a pool all pairs whose scores differ by at
    least ``margin``, the better one chosen. Pools are bounded by the branches of one step."""
    a = df.select(*pool, F.col(item).alias("chosen"), F.col(score).alias("_a"))
    b = df.select(*pool, F.col(item).alias("rejected"), F.col(score).alias("_b"))
    return a.join(b, pool).where(F.col("_a") - F.col("_b") >= margin - 1e-12).select(
        *pool, "chosen", "rejected", F.round(F.col("_a") - F.col("_b"), 6).alias("margin")
    )


def repeats(df: DataFrame, groups: list[str], fingerprint: Column, order: list[Column]) -> DataFrame:
    """``is_repeat`` where an earlier row of the group has the same fingerprint."""
    w = Window.partitionBy(*groups, "_fp").orderBy(*order)
    return df.withColumn("_fp", fingerprint).withColumn("is_repeat", F.row_number().over(w) > 1).drop("_fp")


def label_accuracy(labels: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, n, matched, accuracy): distinct labels that match a target by id or by name
    (trimmed, in lower case). Both tables have (key, label_id, label_name)."""
    name = F.lower(F.trim("label_name"))
    l = labels.select(key, "label_id", name.alias("name")).distinct()  # noqa: E741
    by_id = targets.where("label_id is not null").select(key, "label_id").distinct().withColumn("id_ok", F.lit(True))
    by_name = targets.select(key, name.alias("name")).where("name is not null").distinct().withColumn("name_ok", F.lit(True))
    hit = F.coalesce("id_ok", F.lit(False)) | F.coalesce("name_ok", F.lit(False))
    return l.join(by_id, [key, "label_id"], "left").join(by_name, [key, "name"], "left").groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("matched"), (F.count_if(hit) / F.count("*")).alias("accuracy")
    )
