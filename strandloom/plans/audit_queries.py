"""Registered queries of scoring, audit and annotation operators, with the same results in SQL.

Tasks are the orders: the parts of an order are its target, a shortened list with one wrong
part its prediction. Pools of branches are the orders, their line items the branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import scalar as sc
from strandloom.operators import annotate as an
from strandloom.operators import audit as au
from strandloom.operators import ranking as rk
from strandloom.operators import records as rc
from strandloom.operators import sampling as sa
from strandloom.operators import scoring as so
from strandloom.operators import walks as wk
from strandloom.plans import network_queries as nq
from strandloom.plans.kit_queries import _SPLIT, order_sets, stratified_split
from strandloom.runtime import table

KINDS = ["recovery", "refinement", "explanation"]
STATUSES = ["validated_group", "partially_observed_group", "insufficient_support", "unknown"]


def _pick(names: list[str], by):
    return F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, parts, predicted, kind, status)."""
    shorter = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - (F.col("l_orderkey") % 3).cast("int"), F.lit(0)))
    wrong = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    return order_sets(spark, d).select("l_orderkey", "parts", F.concat(shorter, wrong).alias("predicted"), _pick(KINDS, F.col("l_orderkey")).alias("kind"), _pick(STATUSES, F.col("l_orderkey")).alias("status"))


def _outcome(t: DataFrame) -> dict:
    metrics = rc.set_metrics(F.col("predicted"), F.col("parts"))
    return so.task_success(F.col("kind"), metrics, F.col("status"), so.seed_retention(F.slice("parts", 1, 2), F.col("predicted")))


def _shown(t: DataFrame, o: dict) -> DataFrame:
    return t.select("l_orderkey", o["level"].alias("level"), o["success"].alias("success"), F.concat_ws(",", o["reasons"]).alias("reasons"))


def task_success(spark, d):
    t = tasks(spark, d)
    return _shown(t, _outcome(t))


def none_success(spark, d):
    t = tasks(spark, d)
    return _shown(t, so.none_success(F.col("status"), F.when(F.col("l_orderkey") % 5 > 1, F.array().cast("array<string>")).otherwise(F.col("predicted"))))


def calibrated_success(spark, d):
    t = tasks(spark, d)
    out = so.calibrated(_outcome(t), F.col("kind"), F.col("status"), F.col("l_orderkey") % 8 == 0)
    return t.select("l_orderkey", out["level"].alias("level"), F.size(out["reasons"]).alias("n_reasons"), so.mechanism_cap(out["level"]).alias("cap"))


def final_alignment(spark, d):
    t = tasks(spark, d)
    return t.select("l_orderkey", so.final_alignment(F.col("kind"), rc.set_metrics(F.col("predicted"), F.col("parts"))).alias("level"))


def best_groups(spark, d):
    """Per customer the order whose parts fit those of the first order best."""
    sets = order_sets(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = sets.groupBy("o_custkey").agg(F.min_by("parts", "o_orderkey").alias("target"), F.min("o_orderkey").alias("first"))
    groups = sets.join(first, "o_custkey").where("o_orderkey <> first").withColumn("kind", _pick(KINDS, F.col("o_custkey")))
    return so.best_group(groups, ["o_custkey"], "o_orderkey", "parts", "target", "kind").select("o_custkey", "o_orderkey", F.round("score", 6).alias("score"), "false_positives")


def _results(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("intersection_size"), (F.col("l_discount") * 10).alias("precision"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("p_value"), (F.col("l_returnflag") == "R").alias("significant"), (F.col("l_quantity") / 5).cast("int").alias("query_size"),
    )


def enrichment_support(spark, d):
    return so.best_enrichment(_results(spark, d), ["l_orderkey"], "l_linenumber").select("l_orderkey", F.round("support", 6).alias("support"), "weak_group_support")


def enrichment_order(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return an.ordered_enrichment(rows, ["l_orderkey"], "p", "l_returnflag", "l_linenumber", 2, ["A"]).select("l_orderkey", "l_linenumber", "place")


def weak_evidence(spark, d):
    tools = ["enrich_gene_set", "induce_subgraph", "rwr"]
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", _pick(tools, F.col("l_linenumber") + F.col("l_orderkey")).alias("tool_name"), (F.col("l_discount") * 4).alias("precision"),
        F.col("l_quantity").alias("edges"), F.lit(40).alias("query_size"),
    )
    return so.weak_evidence(rows, "l_orderkey")


def _branches(spark, d):
    score = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("branch_id"), (F.col("l_returnflag") != "A").alias("usable"), F.round(score, 4).alias("total"),
        _pick([*KINDS, "none"], F.col("l_orderkey")).alias("kind"), F.col("l_tax").alias("delta"), F.col("l_quantity").alias("jaccard"), (F.col("l_quantity") + F.col("l_tax")).alias("recall"), F.col("l_discount").alias("precision"),
    )
    return rk.min_max(rows, ["l_orderkey"], "total", "normalized").withColumn("normalized", F.round("normalized", 6))


def preference_mining(spark, d):
    return so.preference_pairs(_branches(spark, d), ["l_orderkey"], 0.15).withColumn("gap", F.round("gap", 6))


def preference_mining_balanced(spark, d):
    return so.preference_pairs(_branches(spark, d), ["l_orderkey"], 0.15, balanced=True).withColumn("gap", F.round("gap", 6))


def branch_scores(spark, d):
    t = table(spark, d, "lineitem")
    score = so.branch_score(F.lit(1.0), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"), F.lit(5), (F.col("l_quantity") % 4), F.lit(4), F.when(F.col("l_returnflag") == "R", 0.25).otherwise(0.0))
    return t.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


def quality_changes(spark, d):
    t = tasks(spark, d)
    before, after = rc.set_metrics(F.slice("parts", 1, 1), F.col("parts")), rc.set_metrics(F.col("predicted"), F.col("parts"))
    return t.select("l_orderkey", *[F.round(c, 6).alias(n) for n, c in so.quality_deltas(before, after).items()])


def _pairs(spark, d):
    return table(spark, d, "preference_pairs").distinct()


def pair_filter(spark, d):
    found = au.record_filter(_pairs(spark, d), {"difficulty_bin": ["hard", "medium"]}, {"task_type": "recov"}, {"margin": 0.2}, {"step_index": 3})
    return found.select("pair_id", "task_type", "margin")


def audit_counters(spark, d):
    return au.counters(_pairs(spark, d), ["task_type", "evidence_mode", "difficulty_bin", "step_index"])


def margin_spread(spark, d):
    out = au.spread_of(_pairs(spark, d), ["difficulty_bin"], "margin")
    return out.select("difficulty_bin", "n", *[F.round(c, 6).alias(c) for c in ("least", "mean", "greatest")])


def tied_pools(spark, d):
    return au.tie_rate(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").withColumn("rate", F.round("rate", 6))


def blocked_fields(spark, d):
    """How often forbidden fields stand at each place of the branch texts."""
    paths = au.blocked_paths(table(spark, d, "branch_pools"), "pool_id", "branches", ["score_metadata", "arguments", "weights"])
    return paths.groupBy(F.element_at(F.split("path", r"\."), -1).alias("field")).agg(F.count("*").alias("n"), F.count_distinct("pool_id").alias("pools"))


RULES = [("rows", 1000.0, None, "high"), ("mean_quantity", None, 20.0, "low"), ("returned", 0.1, 0.9, "high"), ("gone", 0.0, None, "low")]


def audit_findings(spark, d):
    t = table(spark, d, "lineitem")
    values = t.agg(F.count("*").cast("double").alias("rows"), F.avg("l_quantity").alias("mean_quantity"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    metrics = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in values.columns])).alias("x")).select("x.*")
    rules = spark.createDataFrame(RULES, "metric string, least double, most double, severity string")
    return au.findings(metrics, rules).withColumn("value", F.round("value", 6))


def label_agreement(spark, d):
    o = table(spark, d, "orders")
    labels = o.select(
        F.col("o_orderkey").alias("item"), ((F.col("o_orderkey") % 4) + 1).cast("string").alias("chosen"), F.array(((F.col("o_orderkey") % 3) + 1).cast("string")).alias("acceptable"),
        _pick(["0.9", "0.5", "certain", "low"], F.col("o_custkey")).alias("confidence"),
    )
    packets = o.select(F.col("o_orderkey").alias("item"), ((F.col("o_custkey") % 4) + 1).cast("string").alias("selected"))
    branches = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("string").alias("branch_id"), F.col("l_quantity").alias("score"))
    out = au.agreement(labels, packets, branches)
    return out.select("labels", "comparisons", "sure_disagreements", *[F.round(c, 6).alias(c) for c in ("selected_top1", "model_top1", "model_top2", "pairwise")])


def record_scores(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size")
    want = F.to_json(F.struct(F.col("p_name").alias("name"), size.alias("size"), F.when(size % 5 == 0, "defer").otherwise("answer").alias("action"), F.lit("ambiguous").alias("status")))
    said = (
        F.when(size % 4 == 0, F.concat(want, F.lit("}"))).when(size % 4 == 1, F.regexp_replace(want, '"size":', '"size":1')).when(size % 4 == 2, want)
    )
    rows = part.select(F.col("p_partkey").alias("record_id"), F.when(size % 2 == 0, "a").otherwise("b").alias("family"), want.alias("expected"), said.alias("predicted"))
    return au.record_scores(rows, {"a": "size", "b": "name"}, "a")


def review_packets(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").alias("branch_id"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") % 4 + 1).cast("int").alias("selected"))
    return au.review_packets(rows, ["l_orderkey"], "selected", 3)


def split_cube(spark, d):
    rows = stratified_split(spark, d).join(table(spark, d, "orders"), "o_orderkey")
    return au.split_cube(rows, "split", ["o_orderpriority", "o_orderstatus"])


def epoch_plan(spark, d):
    return au.epoch_plan(table(spark, d, "customer"), "c_custkey", 2, 64).select("epoch", "position", "c_custkey", "padding", "step")


def exposure(spark, d):
    return au.exposure(au.epoch_plan(table(spark, d, "customer"), "c_custkey", 3, 64, 40), "c_custkey")


def worker_ranges(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.select("o_orderpriority", F.explode(au.worker_ranges(F.col("n"), 7)).alias("r")).select("o_orderpriority", "r.worker", "r.first", "r.size")


def load_check(spark, d):
    return au.load_check(table(spark, d, "actor_candidates"), ["query_text", "reasoning_text", "raw_text"], 600)


def public_rows(spark, d):
    return au.flat_texts(au.public_rows(table(spark, d, "complex_records"), ["gene_symbols", "pmids", "source_complex_ids", "updated_at"])).distinct().groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.length("gene_ids")).alias("chars")
    )


def symbol_facts(spark, d):
    return an.symbol_facts(table(spark, d, "part"), "p_partkey", "p_type")


def annotation_index(spark, d):
    """The last order of each customer names its priority; customers without one keep their segment."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("note"))
    return an.annotation_index(o, "c_custkey", "o_orderdate", ["note"], table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("note")))


def ordered_genes(spark, d):
    rows = table(spark, d, "complex_records").select("record_no", "updated_at", "gene_ids").distinct()
    return rows.select("record_no", "updated_at", F.concat_ws(",", an.ordered_distinct(F.col("gene_ids"))).alias("genes"))


def set_algebra(spark, d):
    t = tasks(spark, d)
    return t.select("l_orderkey", *[F.concat_ws(",", c).alias(n) for n, c in an.set_algebra(F.col("parts"), F.col("predicted")).items()])


def degrees_within(spark, d):
    return an.degrees_within(nq.network(spark, d), nq._subgraph_nodes(spark, d))


def _ranked(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("node"), F.col("l_quantity").alias("score"))
    return wk.ranked(rows.groupBy("set_id", "node").agg(F.max("score").alias("score")), ties="min")


def best_ranks(spark, d):
    return an.best_ranks(_ranked(spark, d), "node", "rank", "set_id")


def asked_ranks(spark, d):
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("set_id"), F.lit(1).cast("bigint").alias("node"))
    return an.rank_of(_ranked(spark, d), wanted)


def dot_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    a, b = e.where("vec_id % 100 = 0").toDF("a", "x", "l"), e.toDF("b", "y", "m")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    # a stated query set against the rows of its own label
    return a.join(b, F.col("l") == F.col("m")).select("a", "b", F.round(an.dot_similarity(F.col("a"), F.col("b"), dot), 5).alias("dot"))


def rows_before_elbow(spark, d):
    ranks = _ranked(spark, d)
    elbow = ranks.groupBy("set_id").agg(F.floor(F.avg("rank")).alias("elbow"))
    return an.rows_before_elbow(ranks, elbow, "set_id", "node", "rank").select("set_id", "node", "rank")


def band_negatives(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_quantity")
    return an.band_negatives(rows, ["l_orderkey"], "l_linenumber", "l_quantity", 2, (0.4, 0.7), strict=False).select("l_orderkey", "l_linenumber", "from_band", "place")


def cached_lookups(spark, d):
    """Requests of customers against a cache that holds those of the first segments."""
    c = table(spark, d, "customer")
    key = an.request_key({"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})
    cache = c.where("c_nationkey % 3 = 0").select(key.alias("key"), F.col("c_nationkey").alias("answer")).distinct()
    return an.cached(c.select("c_custkey", key.alias("key")), cache, "key").select("c_custkey", "status", "answer")


def train_exclusion(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return au.excluded(o, o.where("o_orderkey % 7 = 0"), "o_orderkey", ["o_orderpriority"])


def mode_expansion(spark, d):
    p = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("n_nationkey"), "c_custkey")
    return au.expanded(p, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", ["seed", "graph", "full"], "mode").select("c_custkey", "n_name", "mode")


def unmatched_labels(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    return au.unmatched(c, table(spark, d, "orders").select(F.col("o_custkey").alias("item")), "item")


def pilot_selection(spark, d):
    o = table(spark, d, "orders")
    late = F.when(F.col("o_orderpriority").startswith("5"), 0).otherwise(1)
    return rk.round_robin(o, ["o_orderpriority"], [sc.stable_key(F.col("o_orderkey"))], late, 200).select("o_orderkey", "turn")


def noise_counts(spark, d):
    n = F.size("parts")
    return order_sets(spark, d).select("l_orderkey", sc.add_count(n, F.lit("medium")).alias("medium"), sc.add_count(n, F.lit("hard")).alias("hard"), sc.audit_bin(n * 3).alias("bin"))


def format_scores(spark, d):
    shape = [
        "concat('<think>', text, '</think> so <answer>', source, '</answer>')", "concat('<answer>', source, '</answer><think>', text, '</think>')",
        "concat('x <think>', text, '</think>-<answer> </answer>')", "concat('<think>', text, '</think><think>b</think><answer>c</answer>')", "text",
    ]
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    made = t.select("doc_id", F.expr("case doc_id % 5 " + " ".join(f"when {k} then {s}" for k, s in enumerate(shape)) + " end").alias("t"))
    return made.select("doc_id", F.round(sc.format_score(F.col("t")), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        task_success, none_success, calibrated_success, final_alignment, best_groups, enrichment_support, enrichment_order, weak_evidence,
        preference_mining, preference_mining_balanced, branch_scores, quality_changes, pair_filter, audit_counters, margin_spread, tied_pools,
        blocked_fields, audit_findings, label_agreement, record_scores, review_packets, split_cube, epoch_plan, exposure, worker_ranges, load_check,
        public_rows, symbol_facts, annotation_index, ordered_genes, set_algebra, degrees_within, best_ranks, asked_ranks, dot_similarity,
        rows_before_elbow, band_negatives, cached_lookups, train_exclusion, mode_expansion, unmatched_labels, pilot_selection, noise_counts, format_scores,
    )
}

# ---- SQL ----
_TASKS = """sets AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS parts FROM lineitem GROUP BY l_orderkey),
tasks AS (SELECT l_orderkey, parts, list_concat(parts[1:greatest(len(parts) - l_orderkey % 3, 0)], CASE WHEN l_orderkey % 2 = 0 THEN ['X'] ELSE [] END) AS predicted,
  (['recovery', 'refinement', 'explanation'])[l_orderkey % 3 + 1] AS kind, (['validated_group', 'partially_observed_group', 'insufficient_support', 'unknown'])[l_orderkey % 4 + 1] AS status FROM sets),
met AS (SELECT *, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS j, CASE WHEN np = 0 THEN 0.0 ELSE i / np END AS p, CASE WHEN nt = 0 THEN 0.0 ELSE i / nt END AS r
  FROM (SELECT *, np + nt - i AS u FROM (SELECT *, CAST(len(list_intersect(predicted, parts)) AS DOUBLE) AS i, len(predicted) AS np, len(parts) AS nt FROM tasks)))"""
_OUT = f"""{_TASKS}, lim AS (SELECT * FROM (VALUES ('explanation', 0.85, 0.75, NULL, 0.6, 0.5, NULL), ('recovery', 0.8, 0.8, NULL, 0.6, 0.6, NULL), ('refinement', 0.8, 0.8, 0.8, 0.6, 0.6, 0.6)) v(kind, pr, pj, pp, qr, qj, qp)),
seen AS (SELECT *, status IN ('validated_group', 'partially_observed_group') AS grp, len(list_filter(parts[1:2], lambda x: list_contains(predicted, x))) / len(parts[1:2]) AS kept FROM met JOIN lim USING (kind)),
why AS (SELECT *, list_filter([CASE WHEN r < pr THEN 'target_recall_below_positive_threshold' END, CASE WHEN j < pj THEN 'target_jaccard_below_positive_threshold' END,
  CASE WHEN kind = 'refinement' AND p < pp THEN 'target_precision_below_positive_threshold' END, CASE WHEN kind = 'explanation' AND kept < pr THEN 'visible_module_genes_were_dropped' END,
  CASE WHEN NOT grp THEN 'relationship_status_not_group' END], lambda x: x IS NOT NULL) AS reasons FROM seen),
outc AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'positive' WHEN grp AND (r >= qr OR j >= qj) AND NOT (kind = 'refinement' AND p < qp) AND NOT (kind = 'explanation' AND kept < qr) THEN 'partial' ELSE 'negative' END AS level FROM why)"""
_BR = """raw AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS branch_id, l_returnflag <> 'A' AS usable, round(l_extendedprice * (1 - l_discount), 4) AS total,
  (['recovery', 'refinement', 'explanation', 'none'])[l_orderkey % 4 + 1] AS kind, l_tax AS delta, l_quantity AS jaccard, l_quantity + l_tax AS recall, l_discount AS precision FROM lineitem),
br AS (SELECT *, round(CASE WHEN max(total) OVER w = min(total) OVER w THEN CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE 0.5 END ELSE (total - min(total) OVER w) / (max(total) OVER w - min(total) OVER w) END, 6) AS normalized FROM raw WINDOW w AS (PARTITION BY l_orderkey)),
us AS (SELECT * FROM br WHERE usable),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY normalized DESC, total DESC, branch_id) AS p FROM us) WHERE p = 1),
rej AS (SELECT u.*, t.branch_id AS cb, t.normalized - u.normalized AS gap, t.kind = 'none' OR (t.delta + 1e-9 >= u.delta AND t.jaccard + 1e-9 >= u.jaccard AND t.recall + 1e-9 >= u.recall AND (t.kind <> 'refinement' OR t.precision + 1e-9 >= u.precision)) AS safe
  FROM us u JOIN top t USING (l_orderkey) WHERE u.branch_id <> t.branch_id AND t.normalized - u.normalized >= 0.15 - 1e-12),
pl AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY normalized, total, branch_id) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM rej)"""
_MINED = "SELECT l_orderkey, cb AS chosen, branch_id AS rejected, difficulty, round(gap, 6) AS gap FROM (SELECT *, {0} AS difficulty FROM pl) WHERE safe AND difficulty IS NOT NULL"
_PREF = "pp AS (SELECT DISTINCT * FROM preference_pairs)"
_RANKED = "rk AS (SELECT *, CAST(rank() OVER (PARTITION BY set_id ORDER BY score DESC) AS DOUBLE) AS rank FROM (SELECT l_suppkey AS set_id, l_partkey AS node, max(l_quantity) AS score FROM lineitem GROUP BY ALL))"
_PLAN = """each AS (SELECT e.epoch, c_custkey, sha256(e.epoch || '|' || c_custkey) AS h FROM customer, (SELECT unnest(range({epochs})) AS epoch) e),
n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 64) * 64 AS BIGINT) AS padded FROM customer),
pos AS (SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY h, c_custkey) - 1 AS position, c_custkey FROM each),
plan AS (SELECT epoch, position, c_custkey, padding, (epoch * padded + position) // 64 AS step FROM (
  SELECT epoch, position, c_custkey, FALSE AS padding FROM pos UNION ALL SELECT epoch, position + n, c_custkey, TRUE FROM pos, n WHERE position < padded - n), n)"""

ORACLE = {
    "task_success": f"WITH {_OUT} SELECT l_orderkey, level, len(reasons) = 0 AS success, array_to_string(reasons, ',') AS reasons FROM outc",
    "none_success": f"""WITH {_TASKS}, n AS (SELECT l_orderkey, status = 'insufficient_support' AS ok, l_orderkey % 5 > 1 OR len(predicted) = 0 AS none FROM tasks)
SELECT l_orderkey, CASE WHEN ok AND none THEN 'positive' WHEN ok OR none THEN 'partial' ELSE 'negative' END AS level, ok AND none AS success,
concat_ws(',', CASE WHEN NOT ok THEN 'relationship_status_not_insufficient_support' END, CASE WHEN NOT none THEN 'predicted_genes_not_empty' END) AS reasons FROM n""",
    "calibrated_success": f"""WITH {_OUT}, c AS (SELECT *, l_orderkey % 8 = 0 AND status = 'validated_group' AS hit FROM outc),
d AS (SELECT l_orderkey, CASE WHEN hit AND level = 'positive' THEN 'partial' ELSE level END AS level, len(reasons) + CAST(hit AS INT) AS n_reasons FROM c)
SELECT *, CASE level WHEN 'positive' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.15 END::DOUBLE AS cap FROM d""",
    "final_alignment": f"""WITH {_OUT} SELECT l_orderkey, CASE WHEN r >= pr AND j >= pj AND coalesce(p >= pp, TRUE) THEN 'positive' WHEN r >= 0.6 OR j >= 0.6 THEN 'partial' ELSE 'negative' END AS level FROM seen""",
    "best_groups": f"""WITH {_TASKS}, s AS (SELECT o_custkey, o_orderkey, parts FROM sets JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT o_custkey, arg_min(parts, o_orderkey) AS target, min(o_orderkey) AS first FROM s GROUP BY o_custkey),
g AS (SELECT s.*, target, CAST(len(list_intersect(parts, target)) AS DOUBLE) AS i, o_custkey % 3 AS k FROM s JOIN f USING (o_custkey) WHERE o_orderkey <> first),
w AS (SELECT *, i / (len(parts) + len(target) - i) AS j, i / len(parts) AS p, i / len(target) AS r FROM g),
sc AS (SELECT *, CASE k WHEN 0 THEN 0.2 * j + 0.2 * p + 0.6 * r WHEN 1 THEN 0.2 * j + 0.6 * p + 0.2 * r ELSE (j + p + r) / 3 END AS score, CAST(len(parts) - i AS INT) AS fp FROM w)
SELECT o_custkey, o_orderkey, round(score, 6) AS score, fp AS false_positives FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 9) DESC, fp, o_orderkey) AS q FROM sc) WHERE q = 1""",
    "enrichment_support": """WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS n, l_discount * 10 AS p, CASE WHEN l_tax > 0 THEN l_tax END AS pv, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.5 END AS b, CAST(trunc(l_quantity / 5) AS INT) AS q FROM lineitem),
s AS (SELECT *, CASE WHEN pv <= 1e-6 THEN 1.0 WHEN pv <= 1e-3 THEN greatest(b, 0.8) WHEN pv <= 0.05 THEN greatest(b, 0.6) ELSE b END AS sure FROM a),
t AS (SELECT *, least(greatest(0.45 * sure + 0.35 * least(n / 3.0, 1.0) + 0.2 * p, 0.0), 1.0) AS raw, n <= 1 AND (q >= 4 OR p <= 0.25) AS weak FROM s),
u AS (SELECT *, CASE WHEN weak THEN least(raw, 0.18) ELSE raw END AS support FROM t)
SELECT l_orderkey, round(support, 6) AS support, weak AS weak_group_support FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY support DESC, l_linenumber) AS k FROM u WHERE support > 0) WHERE k = 1""",
    "enrichment_order": """SELECT l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0 THEN l_tax ELSE 1.0 END, l_returnflag, l_linenumber) AS place FROM lineitem WHERE l_returnflag <> 'A') WHERE place <= 2""",
    "weak_evidence": """WITH a AS (SELECT l_orderkey, (l_linenumber + l_orderkey) % 3 AS t, l_discount * 4 AS p, l_quantity / 40 AS dens FROM lineitem),
g AS (SELECT l_orderkey, bool_or(t = 1 AND dens >= 1) AS dense, bool_or(t <> 0) AS other, max(CASE WHEN t = 0 THEN p END) AS best FROM a GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN dense OR (other AND best IS NULL) THEN FALSE WHEN best IS NULL THEN TRUE ELSE best <= 0.2 END AS weak FROM g""",
    "preference_mining": f"WITH {_BR} " + _MINED.format("CASE WHEN k = 0 THEN 'easy' WHEN k = n // 2 THEN 'medium' WHEN k = n - 1 THEN 'hard' END"),
    "preference_mining_balanced": f"WITH {_BR} " + _MINED.format("CASE WHEN n = 1 THEN 'medium' WHEN k = 0 THEN 'easy' WHEN k = n - 1 THEN 'hard' ELSE 'medium' END"),
    "branch_scores": """SELECT l_orderkey, l_linenumber, round(1.0 + l_discount + l_tax - (0.05 * least(l_linenumber / 5, 1.0) + 0.95 * (l_quantity % 4) / 4) - CASE WHEN l_returnflag = 'R' THEN 0.25 ELSE 0.0 END, 6) AS score FROM lineitem""",
    "quality_changes": f"WITH {_TASKS} SELECT l_orderkey, round(j - 1 / nt, 6) AS jaccard_delta, round(p - 1.0, 6) AS precision_delta, round(r - 1 / nt, 6) AS recall_delta FROM met",
    "pair_filter": f"WITH {_PREF} SELECT pair_id, task_type, margin FROM pp WHERE difficulty_bin IN ('hard', 'medium') AND contains(lower(task_type), 'recov') AND margin >= 0.2 AND step_index <= 3",
    "audit_counters": f"WITH {_PREF} " + " UNION ALL ".join(f"SELECT '{c}' AS counter, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM pp GROUP BY {c}" for c in ("task_type", "evidence_mode", "difficulty_bin", "step_index")),
    "margin_spread": f"WITH {_PREF} SELECT difficulty_bin, count(margin) AS n, round(min(margin), 6) AS least, round(avg(margin), 6) AS mean, round(max(margin), 6) AS greatest FROM pp GROUP BY difficulty_bin",
    "tied_pools": """WITH p AS (SELECT l_orderkey, count(*) AS m, count(*) FILTER (l_quantity = top) AS t FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 1)
SELECT count(*) AS pools, count(*) FILTER (t > 1) AS tied, round(count(*) FILTER (t > 1) / count(*), 6) AS rate FROM p""",
    "audit_findings": """WITH m AS (SELECT count(*)::DOUBLE AS rows, avg(l_quantity) AS mean_quantity, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned FROM lineitem),
v AS (SELECT 'rows' AS metric, rows AS value FROM m UNION ALL SELECT 'mean_quantity', mean_quantity FROM m UNION ALL SELECT 'returned', returned FROM m),
r AS (SELECT * FROM (VALUES ('rows', 1000.0::DOUBLE, NULL::DOUBLE, 'high'), ('mean_quantity', NULL, 20.0, 'low'), ('returned', 0.1, 0.9, 'high'), ('gone', 0.0, NULL, 'low')) x(metric, least, most, severity)),
b AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN value < least THEN 'below' WHEN value > most THEN 'above' END AS rule FROM r LEFT JOIN v USING (metric))
SELECT metric, severity, round(value, 6) AS value, CASE rule WHEN 'below' THEN least WHEN 'above' THEN most END AS bound, rule FROM b WHERE rule IS NOT NULL""",
    "label_agreement": """WITH l AS (SELECT o_orderkey AS item, CAST(o_orderkey % 4 + 1 AS VARCHAR) AS chosen, CAST(o_orderkey % 3 + 1 AS VARCHAR) AS fine, o_custkey % 4 IN (0, 2) AS sure, CAST(o_custkey % 4 + 1 AS VARCHAR) AS selected FROM orders),
b AS (SELECT l_orderkey AS item, CAST(l_linenumber AS VARCHAR) AS branch_id, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CAST(l_linenumber AS VARCHAR)) AS p FROM lineitem),
t AS (SELECT item, max(branch_id) FILTER (p = 1) AS first, list(branch_id) AS two FROM b WHERE p <= 2 GROUP BY item),
s AS (SELECT l.*, selected = chosen AS a, coalesce(first = chosen, FALSE) AS f, coalesce(list_contains(two, chosen) OR list_contains(two, fine), FALSE) AS w FROM l LEFT JOIN t USING (item)),
q AS (SELECT o.score AS own, b.score FROM l JOIN b o ON o.item = l.item AND o.branch_id = l.chosen JOIN b ON b.item = l.item AND b.branch_id <> l.chosen)
SELECT count(*) AS labels, (SELECT count(*) FROM q) AS comparisons, count(*) FILTER (sure AND NOT (a AND f)) AS sure_disagreements, round(avg(a::INT), 6) AS selected_top1, round(avg(f::INT), 6) AS model_top1,
round(avg(w::INT), 6) AS model_top2, (SELECT round(avg((own >= score)::INT), 6) FROM q) AS pairwise FROM s""",
    "record_scores": """WITH p AS (SELECT p_partkey AS record_id, p_size % 2 = 0 AS a, p_size % 4 AS k, p_size FROM part)
SELECT record_id, CASE WHEN a THEN 'a' ELSE 'b' END AS family, k IN (1, 2) AS valid_json, CASE WHEN a THEN k = 2 ELSE k = 1 END AS mapping_exact, k = 2 AS exact_record,
NOT a OR (k = 2 AND p_size % 5 = 0) AS defer_correct FROM p""",
    "review_packets": """SELECT l_orderkey, branch_id, place FROM (SELECT l_orderkey, l_linenumber AS branch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber = l_orderkey % 4 + 1) DESC, l_quantity DESC, l_linenumber) AS place FROM lineitem) WHERE place <= 3""",
    "split_cube": f"""WITH {_SPLIT}, j AS (SELECT split, o_orderpriority, o_orderstatus FROM sp JOIN orders USING (o_orderkey, o_orderstatus))
SELECT split, 'all' AS dimension, NULL AS value, count(*) AS n FROM j GROUP BY split UNION ALL SELECT split, 'o_orderpriority', o_orderpriority, count(*) FROM j GROUP BY ALL UNION ALL SELECT split, 'o_orderstatus', o_orderstatus, count(*) FROM j GROUP BY ALL""",
    "epoch_plan": f"WITH {_PLAN.format(epochs=2)} SELECT epoch, position, c_custkey, padding, step FROM plan",
    "exposure": f"WITH {_PLAN.format(epochs=3)} SELECT c_custkey, count(*) AS uses, min(step) AS first_step, max(step) AS last_step FROM plan WHERE step < 40 GROUP BY c_custkey",
    "worker_ranges": """WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT o_orderpriority, n, unnest(range(7)) AS worker FROM n)
SELECT o_orderpriority, worker::INT AS worker, worker * (n // 7) + least(worker, n % 7) AS first, n // 7 + CASE WHEN worker < n % 7 THEN 1 ELSE 0 END AS size FROM w""",
    "load_check": "SELECT 'rows' AS \"check\", count(*) AS n FROM actor_candidates UNION ALL " + " UNION ALL ".join(
        f"SELECT '{c}_blank', count(*) FILTER (trim(coalesce({c}, '')) = '') FROM actor_candidates UNION ALL SELECT '{c}_long', count(*) FILTER (length({c}) > 600) FROM actor_candidates" for c in ("query_text", "reasoning_text", "raw_text")
    ),
    "symbol_facts": """WITH m AS (SELECT DISTINCT p_partkey::VARCHAR AS i, p_type AS s FROM part)
SELECT CASE WHEN count(*) = 1 THEN 'symbol' ELSE 'ambiguous' END AS family, s AS subject, string_agg(i, ',' ORDER BY i) AS object FROM m GROUP BY s UNION ALL SELECT 'id', i, string_agg(s, ',' ORDER BY s) FROM m GROUP BY i""",
    "annotation_index": """WITH o AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END DESC NULLS LAST) AS k FROM orders)
SELECT coalesce(c, c_custkey) AS c_custkey, coalesce(note, c_mktsegment) AS note FROM (SELECT * FROM o WHERE k = 1) FULL JOIN customer ON c = c_custkey""",
    "ordered_genes": """WITH r AS (SELECT DISTINCT record_no, updated_at, gene_ids FROM complex_records), t AS (SELECT record_no, updated_at, list_filter(list_transform(gene_ids, lambda x: trim(x, ' ')), lambda x: x IS NOT NULL AND x <> '') AS g FROM r)
SELECT record_no, updated_at, coalesce(array_to_string(list_transform(list_filter(list_zip(g, range(1, len(g) + 1)), lambda z: list_position(g, z[1]) = z[2]), lambda z: z[1]), ','), '') AS genes FROM t""",
    "set_algebra": f"""WITH {_TASKS} SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(parts, predicted))), ',') AS "union", array_to_string(list_sort(list_intersect(parts, predicted)), ',') AS intersection,
array_to_string(list_sort(list_filter(parts, lambda x: NOT list_contains(predicted, x))), ',') AS difference FROM tasks""",
    "degrees_within": f"""WITH {nq._E}, {nq._SUB}, i AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM sub) AND dst IN (SELECT node FROM sub))
SELECT node, count(*) AS degree FROM (SELECT src AS node FROM i UNION ALL SELECT dst FROM i) GROUP BY node""",
    "best_ranks": f"WITH {_RANKED} SELECT node, min(rank) AS rank, arg_min(set_id, (rank, set_id)) AS set_id FROM rk GROUP BY node",
    "asked_ranks": f"WITH {_RANKED} SELECT s_suppkey AS set_id, 1::BIGINT AS node, rank, score FROM supplier LEFT JOIN rk ON set_id = s_suppkey AND node = 1",
    "dot_similarity": """SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) END, 5) AS dot
FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0""",
    "rows_before_elbow": f"WITH {_RANKED}, el AS (SELECT set_id, floor(avg(rank)) AS elbow FROM rk GROUP BY set_id) SELECT set_id, node, rank FROM rk JOIN el USING (set_id) WHERE rank < elbow",
    "band_negatives": """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) - 1) / (count(*) OVER w - 1) END AS pc FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
b AS (SELECT *, pc BETWEEN 0.4 AND 0.7 AS from_band FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY from_band DESC, CASE WHEN from_band THEN 0.0 ELSE abs(pc - 0.55) END, sha256(l_linenumber::VARCHAR), l_linenumber) AS place FROM b)
SELECT l_orderkey, l_linenumber, from_band, place FROM o WHERE place <= 2""",
    "cached_lookups": "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'hit' ELSE 'cache_miss' END AS status, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey END AS answer FROM customer",
    "train_exclusion": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0",
    "mode_expansion": "SELECT c_custkey, n_name, unnest(['seed', 'graph', 'full']) AS mode FROM customer LEFT JOIN nation ON c_custkey % 3 > 0 AND n_nationkey = c_nationkey",
    "unmatched_labels": "SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "pilot_selection": """SELECT o_orderkey, turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderkey::VARCHAR)) AS turn FROM orders)
ORDER BY turn, CASE WHEN starts_with(o_orderpriority, '5') THEN 0 ELSE 1 END, o_orderpriority LIMIT 200""",
    "noise_counts": f"""WITH {_TASKS}, n AS (SELECT l_orderkey, len(parts) AS n FROM sets) SELECT l_orderkey, greatest(1, round_even(n * 0.2, 0))::INT AS medium, greatest(2, round_even(n * 0.33, 0))::INT AS hard,
CASE WHEN n * 3 BETWEEN 5 AND 10 THEN 'small' WHEN n * 3 BETWEEN 11 AND 15 THEN 'medium' WHEN n * 3 >= 16 THEN 'large' ELSE 'other' END AS bin FROM n""",
    "format_scores": r"""WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS x, trim(coalesce(source, ''), E' \t\n\r') AS s FROM documents), f AS (SELECT *, trim(x, E' \t\n\r') <> '' AS full_, CASE WHEN length(x) > 4000 THEN 0.2 ELSE 0.0 END AS pen FROM t)
SELECT doc_id, round(CASE doc_id % 5 WHEN 0 THEN 0.4 + 0.2 + 0.2 + CASE WHEN full_ AND s <> '' THEN 0.1 ELSE 0 END + 0.1 - pen WHEN 1 THEN 0.4 + 0.2 + CASE WHEN full_ AND s <> '' THEN 0.1 ELSE 0 END - pen
WHEN 2 THEN 0.4 + 0.2 + 0.2 - pen WHEN 3 THEN 0.4 ELSE 0.0 END::DOUBLE, 6) AS score FROM f""",
}
