"""Registered queries of the record kit (ranks, sampling, sets, trees, texts), with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import scalar as sc
from strandloom.operators import hierarchy as hi
from strandloom.operators import ranking as rk
from strandloom.operators import records as rc
from strandloom.operators import sampling as sa
from strandloom.operators import trees as tr
from strandloom.plans.network_queries import id_symbols
from strandloom.plans.record_queries import _LINKS
from strandloom.runtime import materialize, table

ITEM = ["l_orderkey", "l_linenumber"]


def items(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: the line items of an order are one pool, scored by their net price."""
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", "l_quantity", net.alias("score"))


def order_sets(spark, d):
    """Item sets: the distinct parts of each order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("parts"))


def rank_min(spark, d):
    return rk.competition_rank(items(spark, d), ["l_returnflag"], "l_quantity").select(*ITEM, "rank")


def rank_average(spark, d):
    return rk.competition_rank(items(spark, d), ["l_returnflag"], "l_quantity", "average").select(*ITEM, "rank")


def pool_min_max(spark, d):
    return rk.min_max(items(spark, d), ["l_orderkey"], "score").select(*ITEM, F.round("normalized", 6).alias("normalized"))


def pool_top1(spark, d):
    return rk.top_k(items(spark, d), ["l_orderkey"], [F.desc("score"), F.asc("l_linenumber")], 1).select(*ITEM, "score")


def pool_best_within(spark, d):
    return rk.best_within_margin(items(spark, d), ["l_orderkey"], "score", 5000.0, ["l_quantity", "l_linenumber", "score"]).select(*ITEM, "score")


def pool_difficulty(spark, d):
    return rk.difficulty_picks(items(spark, d), ["l_orderkey"], [F.desc("score"), F.asc("l_linenumber")]).select(*ITEM, "difficulty")


def pool_rank_difficulty(spark, d):
    return rk.rank_difficulty(items(spark, d), ["l_orderkey"], [F.desc("score"), F.asc("l_linenumber")], F.lit("medium")).select(*ITEM, "difficulty")


def round_robin(spark, d):
    o = table(spark, d, "orders")
    return rk.round_robin(o, ["o_orderpriority"], [sc.stable_key(F.col("o_orderkey"))]).select("o_orderkey", "o_orderpriority", "turn")


def stratified_split(spark, d):
    o = table(spark, d, "orders")
    return rk.stratified_split(o, ["o_orderpriority"], [sc.stable_key(F.col("o_orderkey"))]).select("o_orderkey", "split")


def cyclic_difficulty(spark, d):
    o = table(spark, d, "orders")
    return rk.cyclic(o, ["o_orderpriority"], [F.asc("o_orderkey")], ["easy", "medium", "hard"], "difficulty").select("o_orderkey", "difficulty")


def percentile_band(spark, d):
    return tr.percentile_band(items(spark, d), ["l_orderkey"], [F.asc("score"), F.asc("l_linenumber")], 0.25, 0.75).select(*ITEM, F.round("percentile", 6).alias("percentile"))


def median_by_place(spark, d):
    return rk.median_by_place(items(spark, d), ["l_orderkey"], "l_returnflag", "score").withColumn("median", F.round(F.col("median") + 1.3e-6, 3))


def keep_fraction(spark, d):
    return rk.keep_fraction(items(spark, d), ["l_orderkey"], [F.desc("score"), F.asc("l_linenumber")], 0.5).select(*ITEM, "place")


def padded_epoch(spark, d):
    return rk.padded_epoch(table(spark, d, "customer").select("c_custkey"), [F.asc("c_custkey")], 7)


def hash_subset(spark, d):
    return sa.subset(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 50, "pick").select("o_orderkey")


def balanced_items(spark, d):
    o = table(spark, d, "orders")
    return sa.balance(o, ["o_orderpriority"], ["o_orderstatus"], "o_orderkey").select("o_orderkey")


def capped_fill(spark, d):
    return sa.capped_fill(table(spark, d, "orders"), F.col("o_orderstatus") == "P", "o_orderkey", 1000).select("o_orderkey")


def hash_shards(spark, d):
    return sa.shard(table(spark, d, "orders"), F.col("o_orderkey").cast("string"), 12).groupBy("shard").agg(F.count("*").alias("n"))


def leave_one_out(spark, d):
    return sa.leave_one_out_sets(table(spark, d, "nation"), "n_regionkey", "n_name").select("n_regionkey", "left_out", "n_name")


def first_of_equal(spark, d):
    return sa.first_of_equal(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


def disjoint_panels(spark, d):
    return sa.disjoint_panels(table(spark, d, "part").select("p_name", "p_partkey"), "p_name", [("validation", 10), ("test", 20)]).select("p_partkey", "panel")


def conflict_free_picks(spark, d):
    """Per customer up to three orders that share no part."""
    sets = order_sets(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sa.conflict_free(sets.select("o_custkey", "o_orderkey", "parts"), "o_custkey", "o_orderkey", "parts", 3)


def _set_pairs(spark, d):
    """Each order's parts against those of the customer's next order."""
    s = order_sets(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    after = F.lead("parts").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return s.withColumn("target", after).select("o_orderkey", "o_orderpriority", "parts", "target")


def set_metrics(spark, d):
    m = rc.set_metrics(F.col("parts"), F.col("target"))
    return _set_pairs(spark, d).select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in m.items()])


def weighted_set_scores(spark, d):
    m = rc.set_metrics(F.col("parts"), F.col("target"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "recovery").when(F.col("o_orderkey") % 3 == 1, "refinement").otherwise("explanation")
    return _set_pairs(spark, d).select("o_orderkey", F.round(rc.weighted_set_score(kind, m), 6).alias("score"))


def resolve_names(spark, d):
    """Customers resolved to suppliers: first by the number of the name, else by nation if it has one supplier."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    digits = lambda col: F.regexp_extract(col, r"([0-9]+)$", 1)
    requests = c.select(F.col("c_custkey").alias("request_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("scope"), digits("c_name").alias("term")), F.struct(F.lit(1).alias("scope"), F.col("c_nationkey").cast("string").alias("term"))
    )).alias("r")).select("request_id", "r.*")
    scopes = [
        s.select(digits("s_name").alias("term"), F.col("s_suppkey").alias("candidate")),
        s.select(F.col("s_nationkey").cast("string").alias("term"), F.col("s_suppkey").alias("candidate")),
    ]
    return rc.resolve(requests, scopes)


def dedup_sets(spark, d):
    return rc.dedup_sets(order_sets(spark, d), "l_orderkey", "parts").withColumn("ids", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))


def co_supplied(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rc.shared_items(rows, "l_suppkey", "l_partkey")


def split_report(spark, d):
    split = stratified_split(spark, d).join(table(spark, d, "orders"), "o_orderkey")
    return rc.split_report(split, "split", "o_orderstatus").withColumn("share", F.round("share", 6))


def items_across_splits(spark, d):
    split = stratified_split(spark, d).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rc.items_in_several_splits(split, "l_partkey", "split")


def flag_rates(spark, d):
    li = table(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R").withColumn("large", F.col("l_quantity") >= 25)
    out = rc.rate_summary(li, ["l_linestatus"], ["returned", "large"])
    return out.select("l_linestatus", "flag", "n", "hits", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


def rate_gate(spark, d):
    return rc.macro_gate(flag_rates(spark, d), "rate", 0.2).select(F.round("mean", 6).alias("mean"), "least", "passed")


def identifier_cardinalities(spark, d):
    return rc.cardinalities(id_symbols(spark, d), "id", "symbol")


def tool_metrics(spark, d):
    e = table(spark, d, "events")
    out = rc.service_metrics(e, "event_type", "value", F.col("value") < 0)
    return out.select("event_type", "n", "errors", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "slowest")])


def recovered_at(spark, d):
    """Orders whose most heavily ordered part is among the first k by price."""
    i = items(spark, d).withColumn("item", F.concat_ws("/", "l_linenumber", "l_partkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_linenumber", "l_partkey"))
    ranked = i.select("l_orderkey", "item", place.alias("place"))
    target = rk.top_k(i, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")], 1).select("l_orderkey", "item")
    return rc.recovered_by(ranked, target, "l_orderkey", "item", "place", [1, 2, 3, 5]).withColumn("rate", F.round("rate", 6))


def mined_pairs(spark, d):
    return rc.mine_pairs(items(spark, d), ["l_orderkey"], "l_linenumber", "score", 10000.0)


def repeated_calls(spark, d):
    e = table(spark, d, "events")
    return rc.repeats(e, ["user_id"], F.concat_ws("|", "event_type", "props"), [F.asc("ts"), F.asc("event_id")]).groupBy("event_type").agg(
        F.count_if("is_repeat").alias("repeats")
    )


def label_matches(spark, d):
    """Labels: the parts of an order; targets: what the customer's next order holds, by id or name."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labels = li.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("label_id"), F.col("p_name").alias("label_name"))
    o = table(spark, d, "orders")
    nxt = o.select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("after"))
    targets = labels.join(nxt, F.col("k") == F.col("after")).select(F.col("o_orderkey").alias("k"), "label_id", "label_name")
    return rc.label_accuracy(labels, targets, "k").withColumn("accuracy", F.round("accuracy", 6))


def _dendrogram(spark, d):
    dn = table(spark, d, "dendrogram_nodes")
    tree = materialize(hi.hierarchy(hi.child_links(dn, table(spark, d, "parent_index")), paths=True), "dendrogram")
    rows = hi.latest_rows(dn, "node_id", "exported_at", ["height", "label"])
    leaves = rows.select("node_id", F.regexp_extract("label", r"(?i)(ENSG[0-9]+)", 1).alias("item")).where("item <> ''").withColumn("item", F.upper("item"))
    return tree, leaves, rows.select("node_id", "height")


def subtree_sizes(spark, d):
    tree, leaves, _ = _dendrogram(spark, d)
    return tr.subtree_items(tree, leaves).groupBy("node_id").agg(F.count("*").alias("n"))


def tree_modules(spark, d):
    tree, leaves, heights = _dendrogram(spark, d)
    return tr.modules(tree, leaves, heights)


def fact_ids(spark, d):
    return id_symbols(spark, d).select("id", sc.fact_id(F.concat_ws("|", F.col("id").cast("string"), "symbol")).alias("fact"))


def size_bins(spark, d):
    n = F.size("parts")
    return order_sets(spark, d).select("l_orderkey", sc.small_bin(n).alias("bin"), sc.drop_count(n, F.lit("medium")).alias("drops"))


def document_word_overlap(spark, d):
    """Benchmark items of whose words a document has half or more, for the documents of the
    stated query set (ids divisible by 100) against all items."""
    words = lambda df, key: df.where("text is not null").select(key, F.explode(sc.answer_words(F.col("text"))).alias("w"))
    item = words(table(spark, d, "benchmark_items"), "item_id")
    n = item.groupBy("item_id").agg(F.count("*").alias("n"))
    docs = words(table(spark, d, "documents").where("doc_id % 100 = 0").select("doc_id", "text").distinct(), "doc_id")
    both = docs.join(item, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("k")).join(n, "item_id")
    return both.where("k / n >= 0.5").select("doc_id", "item_id", F.round(F.col("k") / F.col("n"), 6).alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_min, rank_average, pool_min_max, pool_top1, pool_best_within, pool_difficulty, pool_rank_difficulty, round_robin,
        stratified_split, cyclic_difficulty, percentile_band, median_by_place, keep_fraction, padded_epoch, hash_subset, balanced_items,
        capped_fill, hash_shards, leave_one_out, first_of_equal, disjoint_panels, conflict_free_picks, set_metrics, weighted_set_scores,
        resolve_names, dedup_sets, co_supplied, split_report, items_across_splits, flag_rates, rate_gate, identifier_cardinalities,
        tool_metrics, recovered_at, mined_pairs, repeated_calls, label_matches, subtree_sizes, tree_modules, fact_ids, size_bins,
        document_word_overlap,
    )
}

_I = "i AS (SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS score FROM lineitem)"
_KEY = "sha256(CAST(o_orderkey AS VARCHAR))"
_SETS = "sets AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS parts FROM lineitem GROUP BY l_orderkey)"
_SPLIT = f"""sp AS (SELECT o_orderkey, o_orderstatus, CASE WHEN p < n - 2 * round_even(n * 0.1, 0) THEN 'train' WHEN p < n - round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_KEY}) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders))"""
_NEXT = f"""{_SETS}, sp AS (SELECT o_orderkey, parts, lead(parts) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM sets JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT o_orderkey, len(list_intersect(parts, coalesce(target, []))) AS o, len(parts) AS p, len(coalesce(target, [])) AS t FROM sp),
mm AS (SELECT o_orderkey, CASE WHEN p + t - o = 0 THEN 1.0 ELSE o / (p + t - o) END AS jaccard, coalesce(o / nullif(p, 0), 0) AS precision, coalesce(o / nullif(t, 0), 0) AS recall FROM m)"""
_RATES = """f AS (SELECT l_linestatus, 'returned' AS flag, l_returnflag = 'R' AS hit FROM lineitem UNION ALL SELECT l_linestatus, 'large', l_quantity >= 25 FROM lineitem),
r AS (SELECT l_linestatus, flag, count(*) AS n, count(*) FILTER (hit) AS hits FROM f GROUP BY ALL), z AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM r),
rates AS (SELECT l_linestatus, flag, n, hits, round(p, 6) AS rate,
  round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z)"""
_PART = lambda order: f"PARTITION BY l_orderkey ORDER BY {order}"
_BEST = _PART("score DESC, l_linenumber")

_WORDS = f"""list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '{sc.PUNCTUATION.replace("'", "''")}', '', 'g'), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '' AND NOT list_contains({sc.STOP_WORDS}, x)))"""

ORACLE = {
    "rank_min": f"WITH {_I} SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC NULLS LAST) AS rank FROM i",
    "rank_average": f"WITH {_I} SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC NULLS LAST) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rank FROM i",
    "pool_min_max": f"""WITH {_I}, w AS (SELECT *, min(score) OVER (PARTITION BY l_orderkey) AS lo, max(score) OVER (PARTITION BY l_orderkey) AS hi, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i)
SELECT l_orderkey, l_linenumber, round(CASE WHEN hi = lo THEN CASE WHEN n = 1 THEN 1.0 ELSE 0.5 END ELSE (score - lo) / (hi - lo) END, 6) AS normalized FROM w""",
    "pool_top1": f"WITH {_I} SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER ({_BEST}) AS p FROM i) WHERE p = 1",
    "pool_best_within": f"""WITH {_I}, n AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS b FROM i)
SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, score DESC) AS p FROM n WHERE score >= b - 5000.0) WHERE p = 1""",
    "pool_difficulty": f"""WITH {_I}, w AS (SELECT *, row_number() OVER ({_BEST}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN 'easy' WHEN k = n // 2 THEN 'medium' ELSE 'hard' END AS difficulty FROM w WHERE k = 0 OR k = n // 2 OR k = n - 1""",
    "pool_rank_difficulty": f"""WITH {_I}, w AS (SELECT *, row_number() OVER ({_BEST}) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'medium' WHEN k = 1 THEN 'easy' WHEN k = n THEN 'hard' ELSE 'medium' END AS difficulty FROM w""",
    "round_robin": f"SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_KEY}) AS turn FROM orders",
    "stratified_split": f"WITH {_SPLIT} SELECT o_orderkey, split FROM sp",
    "cyclic_difficulty": "SELECT o_orderkey, (['easy', 'medium', 'hard'])[(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 3 + 1] AS difficulty FROM orders",
    "percentile_band": f"""WITH {_I}, w AS (SELECT *, row_number() OVER ({_PART('score, l_linenumber')}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i),
q AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE k / (n - 1) END AS percentile FROM w) SELECT l_orderkey, l_linenumber, round(percentile, 6) AS percentile FROM q WHERE percentile BETWEEN 0.25 AND 0.75""",
    "median_by_place": f"""WITH {_I}, w AS (SELECT l_returnflag, score, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY score) AS place FROM i)
SELECT l_returnflag, place, round(median(score) + 1.3e-6, 3) AS median FROM w GROUP BY ALL""",
    "keep_fraction": f"""WITH {_I} SELECT l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER ({_BEST}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i) WHERE place <= floor(n * 0.5)""",
    "padded_epoch": """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer), n AS (SELECT count(*) AS n FROM p)
SELECT c_custkey, position, FALSE AS padding FROM p UNION ALL SELECT c_custkey, position + n, TRUE FROM p, n WHERE position < (7 - n % 7) % 7""",
    "hash_subset": "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('pick|' || o_orderkey), o_orderkey) AS p FROM orders) WHERE p <= 50",
    "balanced_items": """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT o_orderpriority, min(n) AS least FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('balance|' || o_orderkey), o_orderkey) AS p FROM orders)
SELECT o_orderkey FROM r JOIN l USING (o_orderpriority) WHERE p <= least""",
    "capped_fill": """WITH r AS (SELECT *, sha256('fill|' || o_orderkey) AS k, row_number() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY sha256('fill|' || o_orderkey), o_orderkey) AS w FROM orders)
SELECT o_orderkey FROM r ORDER BY (o_orderstatus = 'P' AND w > 200), k, o_orderkey LIMIT 1000""",
    "hash_shards": "SELECT CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT % 12 AS INT) AS shard, count(*) AS n FROM orders GROUP BY ALL",
    "leave_one_out": "SELECT a.n_regionkey, a.n_name AS left_out, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name",
    "first_of_equal": "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name",
    "disjoint_panels": """WITH u AS (SELECT p_name, row_number() OVER (ORDER BY sha256('panel|' || p_name), p_name) AS p FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, CASE WHEN p <= 10 THEN 'validation' WHEN p <= 30 THEN 'test' END AS panel FROM part JOIN u USING (p_name)""",
    "set_metrics": f"WITH {_NEXT} SELECT o_orderkey, round(jaccard, 6) AS jaccard, round(precision, 6) AS precision, round(recall, 6) AS recall FROM mm",
    "weighted_set_scores": f"""WITH {_NEXT} SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN 0.2 * jaccard + 0.2 * precision + 0.6 * recall
WHEN 1 THEN 0.2 * jaccard + 0.6 * precision + 0.2 * recall ELSE jaccard / 3 + precision / 3 + recall / 3 END, 6) AS score FROM mm""",
    "resolve_names": """WITH q AS (SELECT c_custkey AS request_id, 0 AS scope, regexp_extract(c_name, '([0-9]+)$', 1) AS term FROM customer UNION ALL SELECT c_custkey, 1, CAST(c_nationkey AS VARCHAR) FROM customer),
s AS (SELECT 0 AS scope, regexp_extract(s_name, '([0-9]+)$', 1) AS term, s_suppkey AS candidate FROM supplier UNION SELECT 1, CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier),
one AS (SELECT request_id, scope, min(candidate) AS candidate FROM q JOIN s USING (scope, term) GROUP BY ALL HAVING count(DISTINCT candidate) = 1)
SELECT request_id, arg_min(candidate, scope) AS candidate, min(scope) AS scope FROM one GROUP BY request_id""",
    "dedup_sets": f"WITH {_SETS} SELECT array_to_string(parts, ',') AS set_key, min(l_orderkey) AS primary_id, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS ids FROM sets GROUP BY parts",
    "co_supplied": "WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL",
    "split_report": f"WITH {_SPLIT} SELECT split, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM sp GROUP BY split, o_orderstatus",
    "items_across_splits": f"WITH {_SPLIT} SELECT l_partkey, count(DISTINCT split) AS n_splits, count(*) AS n FROM sp JOIN lineitem ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT split) > 1",
    "flag_rates": f"WITH {_RATES} SELECT * FROM rates",
    "rate_gate": f"WITH {_RATES} SELECT round(avg(rate), 6) AS mean, min(rate) AS least, bool_and(rate >= 0.2) AS passed FROM rates",
    "identifier_cardinalities": """WITH p AS (SELECT DISTINCT p_partkey AS id, p_name || '/' || p_brand || '/' || p_size AS symbol FROM part), q AS (SELECT symbol, count(DISTINCT id) AS n FROM p GROUP BY symbol)
SELECT (SELECT count(DISTINCT id) FROM p) AS n_a, (SELECT count(DISTINCT symbol) FROM p) AS n_b, count(*) FILTER (n > 1) AS ambiguous_b, max(n) AS largest FROM q""",
    "tool_metrics": """WITH w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS errors, round(avg(value), 6) AS mean, round(max(value) FILTER (p = round_even((n - 1) * 0.95, 0)), 6) AS p95, round(max(value), 6) AS slowest FROM w GROUP BY event_type""",
    "recovered_at": f"""WITH {_I}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER ({_PART('score DESC, l_linenumber, l_partkey')}) AS place, row_number() OVER ({_PART('l_quantity DESC, l_linenumber, l_partkey')}) AS q FROM i)
SELECT k, count(*) FILTER (place <= k) AS recovered, round(count(*) FILTER (place <= k) / count(*), 6) AS rate FROM (SELECT q, min(place) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS place FROM r) r, (VALUES (1), (2), (3), (5)) t(k) WHERE q = 1 GROUP BY k""",
    "mined_pairs": f"WITH {_I} SELECT a.l_orderkey, a.l_linenumber AS chosen, b.l_linenumber AS rejected, round(a.score - b.score, 6) AS margin FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.score - b.score >= 10000.0 - 1e-12",
    "repeated_calls": "SELECT event_type, count(*) FILTER (p > 1) AS repeats FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type || coalesce('|' || props, '') ORDER BY ts, event_id) AS p FROM events) GROUP BY event_type",
    "label_matches": """WITH l AS (SELECT l_orderkey AS k, l_partkey AS id, lower(trim(p_name)) AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders),
t AS (SELECT o_orderkey AS k, id, name FROM l JOIN n ON l.k = n.after), d AS (SELECT DISTINCT k, id, name FROM l),
h AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.k = d.k AND t.id = d.id) OR EXISTS (SELECT 1 FROM t WHERE t.k = d.k AND t.name = d.name) AS hit FROM d)
SELECT k, count(*) AS n, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM h GROUP BY k""",
    "subtree_sizes": f"""WITH RECURSIVE {_LINKS},
lab AS (SELECT DISTINCT ON (node_id) node_id, label FROM dendrogram_nodes WHERE node_id IS NOT NULL
        ORDER BY node_id, exported_at DESC NULLS LAST, height DESC NULLS LAST, label DESC NULLS LAST),
leaf AS (SELECT node_id, upper(regexp_extract(label, '(?i)(ENSG[0-9]+)', 1)) AS item FROM lab),
up AS (SELECT CAST(unnest(string_split(path, '/')) AS BIGINT) AS anc, node_id FROM rooted)
SELECT anc AS node_id, count(DISTINCT item) AS n FROM up JOIN leaf USING (node_id) WHERE item <> '' GROUP BY anc""",
    "fact_ids": "SELECT p_partkey AS id, 'fact_' || substr(sha256(p_partkey || '|' || p_name || '/' || p_brand || '/' || p_size), 1, 24) AS fact FROM part",
    "size_bins": f"""WITH {_SETS}, n AS (SELECT l_orderkey, len(parts) AS n FROM sets) SELECT l_orderkey, CASE WHEN n <= 2 THEN '2' WHEN n = 3 THEN '3' WHEN n <= 5 THEN '4-5' ELSE '6+' END AS bin,
CAST(least(greatest(1, round_even(n * 0.2, 0)), greatest(1, n - 2)) AS INT) AS drops FROM n""",
    "document_word_overlap": f"""WITH i AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark_items WHERE text IS NOT NULL), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id % 100 = 0)), c AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (w) GROUP BY ALL)
SELECT doc_id, item_id, round(k / n, 6) AS overlap FROM c JOIN n USING (item_id) WHERE k / n >= 0.5""",
}
