"""Scores of predicted sets and of candidate branches, as column expressions and windows.

Null metrics count as 0, null sets as empty; a kind of task without thresholds has no level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalar import clamp01, safe_divide
from strandloom.operators.records import set_metrics, weighted_set_score

# ---- fixed values: thresholds, statuses and weights ----
THRESHOLDS = {
    "explanation": {"positive_recall": 0.85, "positive_jaccard": 0.75, "partial_recall": 0.60, "partial_jaccard": 0.50},
    "recovery": {"positive_recall": 0.80, "positive_jaccard": 0.80, "partial_recall": 0.60, "partial_jaccard": 0.60},
    "refinement": {
        "positive_recall": 0.80, "positive_jaccard": 0.80, "positive_precision": 0.80,
        "partial_recall": 0.60, "partial_jaccard": 0.60, "partial_precision": 0.60,
    },
}
GROUP_STATUSES = ("validated_group", "partially_observed_group")
NO_GROUP_STATUS = "insufficient_support"
REASONS = {
    "recall": "target_recall_below_positive_threshold",
    "jaccard": "target_jaccard_below_positive_threshold",
    "precision": "target_precision_below_positive_threshold",
    "dropped": "visible_module_genes_were_dropped",
    "status": "relationship_status_not_group",
    "none_status": "relationship_status_not_insufficient_support",
    "not_empty": "predicted_genes_not_empty",
    "weak": "validated_group_weak_enrichment_support",
}
MECHANISM_CAPS = {"positive": 1.0, "partial": 0.50}
LOWEST_CAP = 0.15
WEAK_INTERSECTION, WEAK_PRECISION, WEAK_QUERY_SIZE, WEAK_CAP = 1, 0.25, 4, 0.18
AUDIT_PARTIAL = 0.60
STRONG_EDGE_DENSITY, WEAK_VALIDATED_PRECISION = 1.0, 0.20
STEP_SHARE, INVALID_SHARE = 0.05, 0.95


def _limit(kind: Column, name: str) -> Column:
    """The threshold of a kind; null where the kind has none of that name."""
    out = F.lit(None).cast("double")
    for k, limits in THRESHOLDS.items():
        if name in limits:
            out = F.when(kind == k, F.lit(limits[name])).otherwise(out)
    return out


def seed_retention(seeds: Column, predicted: Column) -> Column:
    """Share of the seeds that are predicted; 1 without seeds."""
    n = F.size(F.coalesce(seeds, F.array().cast("array<string>")))
    kept = F.size(F.filter(F.coalesce(seeds, F.array().cast("array<string>")), lambda x: F.array_contains(predicted, x)))
    return F.when(n == 0, 1.0).otherwise(kept / n)


def task_success(kind: Column, metrics: dict[str, Column], status: Column, retention: Column) -> dict[str, Column]:
    """``level`` (positive, partial, negative), ``success`` and ``reasons`` of a task with a target."""
    j, p, r = (F.coalesce(metrics[k], F.lit(0.0)) for k in ("jaccard", "precision", "recall"))
    in_group = F.coalesce(status.isin(*GROUP_STATUSES), F.lit(False))
    refine, explain = kind == "refinement", kind == "explanation"
    failed = [
        (r < _limit(kind, "positive_recall"), "recall"),
        (j < _limit(kind, "positive_jaccard"), "jaccard"),
        (refine & (p < _limit(kind, "positive_precision")), "precision"),
        (explain & (retention < _limit(kind, "positive_recall")), "dropped"),
        (~in_group, "status"),
    ]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(REASONS[name])) for bad, name in failed]), lambda x: x.isNotNull())
    partial = in_group & ((r >= _limit(kind, "partial_recall")) | (j >= _limit(kind, "partial_jaccard")))
    partial = partial & ~(refine & (p < _limit(kind, "partial_precision"))) & ~(explain & (retention < _limit(kind, "partial_recall")))
    good = F.size(reasons) == 0
    return {"level": F.when(good, "positive").when(partial, "partial").otherwise("negative"), "success": good, "reasons": reasons}


def none_success(status: Column, predicted: Column) -> dict[str, Column]:
    """The same of a task without a target: no group found, and none predicted."""
    right = F.coalesce(status == NO_GROUP_STATUS, F.lit(False))
    empty = F.size(F.coalesce(predicted, F.array().cast("array<string>"))) == 0
    reasons = F.filter(
        F.array(F.when(~right, F.lit(REASONS["none_status"])), F.when(~empty, F.lit(REASONS["not_empty"]))), lambda x: x.isNotNull()
    )
    return {"level": F.when(right & empty, "positive").when(right | empty, "partial").otherwise("negative"), "success": right & empty, "reasons": reasons}


def calibrated(outcome: dict[str, Column], kind: Column, status: Column, weak: Column) -> dict[str, Column]:
    """A validated group with weak enrichment is no success: positive drops to partial. Tasks
    without a target stay as they are."""
    hit = (kind != "none") & F.coalesce(weak, F.lit(False)) & F.coalesce(status == GROUP_STATUSES[0], F.lit(False))
    return {
        "level": F.when(hit & (outcome["level"] == "positive"), "partial").otherwise(outcome["level"]),
        "success": outcome["success"] & ~hit,
        "reasons": F.when(hit, F.array_union(outcome["reasons"], F.array(F.lit(REASONS["weak"])))).otherwise(outcome["reasons"]),
    }


def mechanism_cap(level: Column) -> Column:
    """The most that the mechanism part of a final score may be."""
    out = F.lit(LOWEST_CAP)
    for name, cap in MECHANISM_CAPS.items():
        out = F.when(level == name, F.lit(cap)).otherwise(out)
    return out


def final_alignment(kind: Column, metrics: dict[str, Column]) -> Column:
    """The level a run's audit gives: thresholds of success, but one cut for partial in all kinds."""
    j, p, r = (F.coalesce(metrics[k], F.lit(0.0)) for k in ("jaccard", "precision", "recall"))
    exact = F.coalesce(p >= _limit(kind, "positive_precision"), F.lit(True))
    good = (r >= _limit(kind, "positive_recall")) & (j >= _limit(kind, "positive_jaccard")) & exact
    return F.when(good, "positive").when((r >= AUDIT_PARTIAL) | (j >= AUDIT_PARTIAL), "partial").otherwise("negative")


def best_group(groups: DataFrame, task: list[str], group: str, items: str, target: str, kind: str) -> DataFrame:
    """One row per task: its group of the greatest weighted score; ties by fewer false
    positives, then the smaller name. Weighs the metrics by ``kind``."""
    metrics = set_metrics(F.col(items), F.col(target))
    false = F.size(F.array_except(F.array_distinct(F.col(items)), F.col(target)))
    scored = groups.withColumn("score", weighted_set_score(F.col(kind), metrics)).withColumn("false_positives", false)
    order = Window.partitionBy(*task).orderBy(F.desc_nulls_last("score"), "false_positives", group)
    return scored.withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def enrichment_score(intersection: Column, precision: Column, p_value: Column, significant: Column, query_size: Column) -> dict[str, Column]:
    """``score`` of one enrichment result, and whether it is ``weak``: few common items in a
    long query or at a low precision, which caps it."""
    n, p = F.coalesce(intersection, F.lit(0)), F.coalesce(precision, F.lit(0.0))
    base = F.when(F.coalesce(significant, F.lit(False)), 1.0).otherwise(0.5)
    sure = F.when(p_value <= 1e-6, 1.0).when(p_value <= 1e-3, F.greatest(base, F.lit(0.8))).when(p_value <= 0.05, F.greatest(base, F.lit(0.6))).otherwise(base)
    score = clamp01(0.45 * sure + 0.35 * F.least(n / 3.0, F.lit(1.0)) + 0.20 * p)
    weak = (n <= WEAK_INTERSECTION) & ((F.coalesce(query_size, F.lit(0)) >= WEAK_QUERY_SIZE) | (p <= WEAK_PRECISION))
    return {"score": F.when(weak, F.least(score, F.lit(WEAK_CAP))).otherwise(score), "weak": weak}


def best_enrichment(results: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key: its best result (intersection_size, precision, p_value, significant,
    query_size), the first by ``position`` of equally good ones; keys without any are left out."""
    parts = enrichment_score(*[F.col(c) for c in ("intersection_size", "precision", "p_value", "significant", "query_size")])
    scored = results.withColumn("support", parts["score"]).withColumn("weak_group_support", parts["weak"]).where("support > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("support"), position)
    return scored.withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def weak_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """(key, weak): whether a validated group rests on weak evidence.

    ``evidence`` has (key, tool_name, precision, edges, query_size). A dense subgraph clears it,
    as does another tool where no enrichment was measured; else the best precision decides."""
    enrich = F.col("tool_name") == "enrich_gene_set"
    dense = (F.col("tool_name") == "induce_subgraph") & (safe_divide(F.col("edges").cast("double"), F.col("query_size")) >= STRONG_EDGE_DENSITY)
    seen = evidence.groupBy(key).agg(
        F.bool_or(F.coalesce(dense, F.lit(False))).alias("dense"),
        F.bool_or(F.coalesce(~enrich, F.lit(False))).alias("other"),
        F.max(F.when(enrich, F.col("precision"))).alias("best"),
    )
    weak = F.when(F.col("dense") | (F.col("other") & F.col("best").isNull()), False).when(F.col("best").isNull(), True).otherwise(F.col("best") <= WEAK_VALIDATED_PRECISION)
    return seen.select(key, weak.alias("weak"))


def branch_score(schema_score: Column, set_delta: Column, mechanism_delta: Column, step: Column, max_steps: Column, invalid: Column, calls: Column, mismatch: Column) -> Column:
    """Local score: what schema, set and mechanism gain, less the price of steps, of invalid
    calls and of a mismatch."""
    price = STEP_SHARE * F.least(safe_divide(step.cast("double"), max_steps), F.lit(1.0)) + INVALID_SHARE * safe_divide(invalid.cast("double"), calls)
    return schema_score + set_delta + mechanism_delta - price - mismatch


def quality_deltas(before: dict[str, Column], after: dict[str, Column]) -> dict[str, Column]:
    """Change of every set metric from one state to the next."""
    return {f"{k}_delta": after[k] - before[k] for k in ("jaccard", "precision", "recall")}


def task_safe(kind: Column, chosen: dict[str, Column], rejected: dict[str, Column]) -> Column:
    """Whether a chosen branch is no worse than the rejected one in its set score and metrics
    (``delta``, ``jaccard``, ``recall``, and ``precision`` in refinement); always so without a target."""
    ok = F.lit(True)
    for name in ("delta", "jaccard", "recall"):
        ok = ok & (chosen[name] + 1e-9 >= rejected[name])
    ok = ok & ((kind != "refinement") | (chosen["precision"] + 1e-9 >= rejected["precision"]))
    return (kind == "none") | ok


def preference_pairs(branches: DataFrame, pool: list[str], margin: float, balanced: bool = False) -> DataFrame:
    """(pool, chosen, rejected, difficulty, gap): pairs of each pool's best usable branch with
    others at least ``margin`` below it.

    ``branches`` has (pool, branch_id, usable, normalized, total, kind, delta, jaccard, recall,
    precision). The rejected are ordered from the worst; the first, middle and last are easy,
    medium and hard (each branch once), or with ``balanced`` all are taken, the first easy, the
    last hard, a single one medium. Pairs that are not task-safe are left out.
    """
    usable = branches.where("usable").withColumn("normalized", F.coalesce("normalized", F.lit(0.0)))
    best = Window.partitionBy(*pool).orderBy(F.desc("normalized"), F.desc("total"), "branch_id")
    kept = ["branch_id", "normalized", "kind", "delta", "jaccard", "recall", "precision"]
    top = usable.withColumn("_p", F.row_number().over(best)).where("_p = 1").select(*pool, F.struct(*kept).alias("c"))
    others = usable.join(top, pool).where((F.col("branch_id") != F.col("c.branch_id")) & (F.col("c.normalized") - F.col("normalized") >= margin - 1e-12))
    at = F.row_number().over(Window.partitionBy(*pool).orderBy("normalized", "total", "branch_id")) - 1
    placed = others.withColumn("_at", at).withColumn("_n", F.count("*").over(Window.partitionBy(*pool)))
    first, last = F.col("_at") == 0, F.col("_at") == F.col("_n") - 1
    if balanced:
        name = F.when(F.col("_n") == 1, "medium").when(first, "easy").when(last, "hard").otherwise("medium")
    else:
        name = F.when(first, "easy").when(F.col("_at") == F.floor(F.col("_n") / 2), "medium").when(last, "hard")
    measures = ("delta", "jaccard", "recall", "precision")
    safe = task_safe(F.col("c.kind"), {k: F.col(f"c.{k}") for k in measures}, {k: F.col(k) for k in measures})
    return placed.withColumn("difficulty", name).where(F.col("difficulty").isNotNull() & safe).select(
        *pool, F.col("c.branch_id").alias("chosen"), F.col("branch_id").alias("rejected"), "difficulty", (F.col("c.normalized") - F.col("normalized")).alias("gap")
    )


