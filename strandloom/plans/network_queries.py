"""Registered network queries on the derived layered network, with the same results in SQL.

The network: one layer per return flag, an edge between a part and a supplier, its weight
the number of line items. Seed sets: per region, the richest supplier of each nation.

Walks run until they change by less than TOLERANCE, which is tighter than the operators'
own, so that eight digits are certain; the SQL spells out as many rounds as leave less than
1e-13 of a walk (0.3 ** 28, 0.65 ** 75). Hop and weighted distances run until nothing
changes; their SQL has more rounds than the network is wide, and says so by a last round
that must change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import edges as ed
from strandloom.operators import graph, vectors, walks
from strandloom.runtime import materialize, table

TOLERANCE = 1e-13
STEPS, LAYER_STEPS = 28, 75
HOPS, RELAXATIONS = 8, 14
RESTART, DELTA = 0.7, 0.5


def network(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey").repartition("l_partkey")  # nearly every row is a group of its own
    return rows.groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight")).select(
        F.col("l_returnflag").alias("layer"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
        "weight",
    )


def stored_network(spark: SparkSession, d: str) -> DataFrame:
    return materialize(network(spark, d), "network")


def links(spark: SparkSession, d: str) -> DataFrame:
    """:func:`network` with a link for each line item: walks add up the weights of repeated links."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("layer"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.lit(1.0).alias("weight"),
    )


def seeds(spark: SparkSession, d: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return (
        table(spark, d, "supplier").withColumn("p", best).where("p = 1")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("set_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    )


def nodes_of_seeds(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d).select("node").distinct()


def layer_stats(spark, d):
    return ed.layer_stats(network(spark, d))


def degrees(spark, d):
    return ed.degrees(network(spark, d))


def _raw_edges(spark, d):
    return ed.clean(table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("layer"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_quantity").alias("weight"),
    ))


def merged_edges(how):
    def query(spark, d):
        return ed.canonical(_raw_edges(spark, d), how).withColumn("weight", F.round("weight", 6))

    query.__name__ = f"merge_edges_{how}"
    return query


def merged_layers(how):
    def query(spark, d):
        return ed.merge_layers(network(spark, d), how).withColumn("weight", F.round("weight", 6))

    query.__name__ = f"merge_layers_{how}"
    return query


def aggregate_layer(spark, d):
    return ed.aggregate_layer(network(spark, d)).withColumn("layers", F.concat_ws(",", "layers"))


def neighbours(spark, d):
    return ed.neighbours(network(spark, d)).withColumn("neighbours", F.concat_ws(",", "neighbours"))


def neighbour_union(spark, d):
    return ed.neighbour_union(network(spark, d))


def _subgraph_nodes(spark, d):
    """Parts of size 1 to 5 and all suppliers that are seeds."""
    parts = table(spark, d, "part").where("p_size <= 5").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"))
    return parts.unionByName(nodes_of_seeds(spark, d))


def induced_edges(spark, d):
    return ed.induced(network(spark, d), _subgraph_nodes(spark, d))


def induced_summary(spark, d):
    return ed.induced_summary(network(spark, d), _subgraph_nodes(spark, d))


def node_layers(spark, d):
    return ed.node_layers(network(spark, d)).withColumn("layers", F.concat_ws(",", "layers"))


def layer_matrix(spark, d):
    return ed.layer_matrix(network(spark, d), ["A", "N", "R"])


def present_nodes(spark, d):
    wanted = table(spark, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("node"))
    return ed.present_flags(wanted, network(spark, d))


def hop_distances(spark, d):
    return graph.hop_distances(stored_network(spark, d), nodes_of_seeds(spark, d))


def weighted_distances(spark, d):
    return graph.weighted_distances(stored_network(spark, d), nodes_of_seeds(spark, d)).withColumn("distance", F.round("distance", 6)).drop("hops")


def path_layer_counts(spark, d):
    reach = graph.hop_distances(network(spark, d), nodes_of_seeds(spark, d), 1).where("parent is not null")
    return graph.path_layer_counts(network(spark, d), reach.select(F.col("parent").alias("src"), F.col("node").alias("dst")))


def id_symbols(spark, d):
    """Identifier map: part keys and their (name, brand, size) symbols, many to many."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand", F.col("p_size").cast("string")).alias("symbol")
    )


def identifier_components(spark, d):
    pairs = id_symbols(spark, d).select(
        F.lit("map").alias("layer"), F.concat(F.lit("id:"), F.col("id").cast("string")).alias("src"),
        F.concat(F.lit("sym:"), "symbol").alias("dst"), F.lit(1.0).alias("weight"),
    )
    return graph.components(pairs)


def component_sizes(spark, d):
    return identifier_components(spark, d).groupBy("component").agg(F.count("*").alias("size"))


def layer_walks(spark, d):
    return walks.layer_walks(links(spark, d), seeds(spark, d), 0.35, tolerance=TOLERANCE).withColumn("score", F.round("score", 8))


def walk_means(spark, d):
    return walks.layer_means(links(spark, d), seeds(spark, d), 0.35, TOLERANCE).withColumn("score", F.round("score", 8))


def multiplex_walks(spark, d):
    return walks.multiplex_walks(links(spark, d), seeds(spark, d), RESTART, DELTA, tolerance=TOLERANCE).withColumn("score", F.round("score", 8))


def _vectors(spark, d, how="geometric", best=None):
    """The walks run on numbers for nodes, twice the key of a part and one more than that of a supplier; only what comes
    out of them is named."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("layer"),
        (F.col("l_partkey").cast("bigint") * 2).alias("src"),
        (F.col("l_suppkey").cast("bigint") * 2 + 1).alias("dst"),
        F.lit(1.0).alias("weight"),
    )
    given = seeds(spark, d).select("set_id", (F.substring("node", 2, 20).cast("bigint") * 2 + 1).alias("node"))
    kind = F.when(F.col("node").bitwiseAND(1) == 0, "P").otherwise("S")
    found = walks.reduced_walks(rows, given, RESTART, DELTA, how, TOLERANCE, best=best)
    return found.select("set_id", F.concat(kind, F.shiftright("node", 1).cast("string")).alias("node"), "score")


def walk_reduced(how):
    def query(spark, d):
        return _vectors(spark, d, how).withColumn("score", F.round("score", 8))

    query.__name__ = f"walk_reduced_{how}"
    return query


def walk_ranks(spark, d):
    scores = _vectors(spark, d, "arithmetic").withColumn("score", F.round("score", 8))
    return walks.ranked(scores, seeds(spark, d)).select("set_id", "node", "rank", "is_seed")


def lines_of_evidence(spark, d):
    scores = _vectors(spark, d, "arithmetic", best=20).withColumn("score", F.round("score", 8))
    return walks.best(scores, seeds(spark, d), 20).select("set_id", "node", "score", "rank")


def walk_distances(spark, d):
    """Distances between the vectors of every two seed sets."""
    v = materialize(_vectors(spark, d, "arithmetic").withColumn("score", F.round("score", 8)), "vectors")
    return vectors.set_distances(v).select("a", "b", *[F.round(c, 6).alias(c) for c in ("pearson", "cosine", "spearman")])


def layer_ablation(spark, d):
    rows = walks.ablation(links(spark, d), seeds(spark, d), RESTART, DELTA, tolerance=TOLERANCE)
    out = vectors.column_distances(rows, ["layer", "set_id"], "score", "base")
    return out.select("layer", "set_id", F.round("pearson", 6).alias("pearson"), F.round("cosine", 6).alias("cosine"))


def layer_ablation_summary(spark, d):
    out = vectors.effect_summary(layer_ablation(spark, d), "layer", "pearson")
    return out.select("layer", *[F.round(c, 6).alias(c) for c in ("mean", "max", "min")], "n")


def node_perturbation(spark, d):
    rows = walks.perturbation(links(spark, d), seeds(spark, d), "S1", RESTART, DELTA, tolerance=TOLERANCE)
    out = vectors.column_distances(rows, ["set_id"], "score", "base")
    return out.select("set_id", F.round("pearson", 6).alias("pearson"), F.round("cosine", 6).alias("cosine"))


def seed_essentiality(spark, d):
    s = seeds(spark, d)
    pool = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    null = walks.random_sets(pool.join(s.select("node"), "node", "left_anti"), s)
    return walks.essentiality(links(spark, d), s, null, RESTART, DELTA).select(
        "set_id", "position", "left_out", "rank", "null_median", "delta"
    )


def vector_pairs(spark, d):
    e = table(spark, d, "embeddings")
    out = vectors.pairwise(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return out.select("a", "b", *[F.round(c, 5).alias(c) for c in ("dot", "pearson", "spearman", "cosine")])


def score_elbow(spark, d):
    scores = _vectors(spark, d, "arithmetic")
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), "node"))
    return vectors.elbow(scores.withColumn("place", place).withColumn("score", F.round("score", 8)), "set_id", "place", "score")


QUERIES = {
    f.__name__: f
    for f in (
        layer_stats, degrees, *map(merged_edges, ed.MERGES), *map(merged_layers, [*ed.MERGES, "all"]), aggregate_layer, neighbours,
        neighbour_union, induced_edges, induced_summary, node_layers, layer_matrix, present_nodes, hop_distances, weighted_distances,
        path_layer_counts, identifier_components, component_sizes, layer_walks, walk_means, multiplex_walks,
        *map(walk_reduced, walks.REDUCTIONS), walk_ranks, lines_of_evidence, walk_distances, layer_ablation, layer_ablation_summary,
        node_perturbation, seed_essentiality, vector_pairs, score_elbow,
    )
}

# ---- SQL ----
_E = "e AS (SELECT l_returnflag AS layer, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)"
_SYM = f"{_E}, sym AS (SELECT layer, src, dst, weight FROM e UNION ALL SELECT layer, dst, src, weight FROM e)"
_SEEDS = """seeds AS (SELECT r_name AS set_id, 'S' || s_suppkey AS node FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS p FROM supplier)
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p = 1)"""
_SUB = f"""{_SEEDS}, sub AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_size <= 5 UNION SELECT node FROM seeds)"""
_HOPS = """
h0 AS (SELECT DISTINCT node AS source, node, 0 AS hops, CAST(NULL AS VARCHAR) AS parent FROM seeds),
""" + ",\n".join(
    f"""h{k} AS MATERIALIZED (SELECT * FROM h{k - 1} UNION ALL
  SELECT r.source, s.dst, {k}, min(r.node) FROM h{k - 1} r JOIN sym s ON s.src = r.node
  WHERE r.hops = {k - 1} AND NOT EXISTS (SELECT 1 FROM h{k - 1} x WHERE x.source = r.source AND x.node = s.dst) GROUP BY r.source, s.dst)"""
    for k in range(1, HOPS + 1)
)
_RELAX = ",\n".join(
    f"d{k} AS MATERIALIZED (SELECT source, node, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL SELECT source, dst, distance + l FROM d{k - 1} JOIN s ON s.src = node) GROUP BY ALL)"
    for k in range(1, RELAXATIONS + 1)
)
_AT = "held AS (SELECT DISTINCT layer, src AS node FROM sym)"


def _multiplex(e: str = "sym", tag: str = "", steps: int = STEPS, sets: str = "seeds", inter: str | None = None, n_layers: str | None = None) -> str:
    """CTEs of coupled walks: m{tag} (set_id, layer, node, score) after the last step."""
    n = n_layers or f"(SELECT count(DISTINCT layer) FROM {e})"
    delta = f"(CASE WHEN {n} < 2 THEN 0.0 ELSE {DELTA} END)"
    ctes = [
        f"occ{tag} AS (SELECT DISTINCT layer, src AS node FROM {e})",
        f"tot{tag} AS (SELECT layer, src, sum(weight) AS total FROM {e} GROUP BY ALL)",
        f"tr{tag} AS (SELECT s.layer, s.src, s.dst, sum(s.weight) / any_value(t.total) * (1 - {delta}) AS p FROM {e} s JOIN tot{tag} t USING (layer, src) GROUP BY s.layer, s.src, s.dst)",
        inter or f"inter{tag} AS (SELECT layer, node, CASE WHEN n > 1 THEN {delta} / (n - 1) ELSE 0.0 END AS d FROM occ{tag} JOIN (SELECT node, count(*) AS n FROM occ{tag} GROUP BY node) USING (node))",
        f"s0{tag} AS (SELECT set_id, layer, node, (1.0 / {n}) / size AS score FROM (SELECT DISTINCT set_id, node FROM {sets}) JOIN (SELECT set_id, count(DISTINCT node) AS size FROM {sets} GROUP BY set_id) USING (set_id) JOIN occ{tag} USING (node))",
    ]
    for k in range(1, steps + 1):
        p = f"s{k - 1}{tag}"
        ctes.append(f"""s{k}{tag} AS MATERIALIZED (SELECT set_id, layer, node, sum(score) AS score FROM (
  SELECT w.set_id, w.layer, t.dst AS node, w.score * t.p * (1 - {RESTART}) AS score FROM {p} w JOIN tr{tag} t ON t.layer = w.layer AND t.src = w.node
  UNION ALL SELECT w.set_id, a.layer, w.node, w.score * i.d * (1 - {RESTART}) FROM {p} w JOIN inter{tag} i ON i.layer = w.layer AND i.node = w.node JOIN occ{tag} a ON a.node = w.node AND a.layer <> w.layer
  UNION ALL SELECT set_id, layer, node, score * {RESTART} FROM s0{tag}) GROUP BY set_id, layer, node)""")
    return ",\n".join(ctes)


def _reduced(how: str, tag: str = "", steps: int = STEPS, e: str = "sym", name: str = "red") -> str:
    n = f"(SELECT count(DISTINCT layer) FROM {e})"
    value = {
        "arithmetic": f"sum(score) / {n}",
        "sum": "sum(score)",
        "geometric": f"CASE WHEN count(*) < {n} OR min(score) <= 0 THEN 0.0 ELSE exp(sum(ln(greatest(score, 1e-300))) / {n}) END",
    }[how]
    return f"{name} AS (SELECT set_id, node, round({value}, 12) AS score FROM s{steps}{tag} GROUP BY set_id, node)"


_MW = f"{_SYM}, {_SEEDS}, {_multiplex()}"
_VEC = f"{_MW}, {_reduced('arithmetic')}, v AS (SELECT set_id, node, round(score, 8) AS score FROM red)"
_LW = f"""{_SYM}, {_SEEDS}, {_AT},
tot AS (SELECT layer, src, sum(weight) AS total FROM sym GROUP BY ALL),
tr AS (SELECT s.layer, s.src, s.dst, sum(s.weight) / any_value(t.total) AS p FROM sym s JOIN tot t USING (layer, src) GROUP BY s.layer, s.src, s.dst),
act AS (SELECT DISTINCT set_id, layer, node FROM seeds JOIN held USING (node)),
w0 AS (SELECT set_id, layer, node, 1.0 / count(*) OVER (PARTITION BY set_id, layer) AS score FROM act),
""" + ",\n".join(
    f"""w{k} AS MATERIALIZED (SELECT set_id, layer, node, sum(score) AS score FROM (
  SELECT w.set_id, w.layer, t.dst AS node, w.score * t.p * (1 - 0.35) AS score FROM w{k - 1} w JOIN tr t ON t.layer = w.layer AND t.src = w.node
  UNION ALL SELECT set_id, layer, node, score * 0.35 FROM w0) GROUP BY set_id, layer, node)"""
    for k in range(1, LAYER_STEPS + 1)
)


def _corr(x: str, y: str) -> str:
    n = "count(*)"
    cov = lambda a, b: f"((sum({a} * {b}) - sum({a}) * sum({b}) / {n}) / ({n} - 1))"
    flat = f"sqrt(greatest({cov(x, x)}, 0)) < 1e-8 OR sqrt(greatest({cov(y, y)}, 0)) < 1e-8"
    return f"CASE WHEN {flat} THEN 0.0 ELSE {cov(x, y)} / sqrt({cov(x, x)} * {cov(y, y)}) END"


_COS = "coalesce(sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 0)"
_RAW = "raw AS (SELECT l_returnflag AS layer, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, l_quantity AS weight FROM lineitem)"
_COMP = """pairs AS (SELECT 'id:' || p_partkey AS a, 'sym:' || p_name || '/' || p_brand || '/' || p_size AS b FROM part),
comp AS (SELECT a, b, min(a) OVER (PARTITION BY b) AS component FROM pairs)"""
_FN = {"max": "max", "min": "min", "sum": "sum", "mean": "avg"}


def _ablated() -> str:
    parts = []
    for layer in ("A", "N", "R"):
        parts.append(f"sym{layer} AS (SELECT * FROM sym WHERE layer <> '{layer}')")
        parts.append(_multiplex(f"sym{layer}", layer))
        parts.append(_reduced("arithmetic", layer, e=f"sym{layer}", name=f"red{layer}"))
    union = " UNION ALL ".join(f"SELECT '{x}' AS layer, * FROM red{x}" for x in ("A", "N", "R"))
    return (
        f"{_SYM}, {_SEEDS}, {_multiplex()}, {_reduced('arithmetic')}, {', '.join(parts)}, abl AS ({union}), "
        "both_ AS (SELECT l.layer, r.set_id, coalesce(a.score, 0.0) AS x, r.score AS y FROM (SELECT DISTINCT layer FROM e) l CROSS JOIN red r "
        "LEFT JOIN abl a ON a.layer = l.layer AND a.set_id = r.set_id AND a.node = r.node), "
        f"dist AS (SELECT layer, set_id, round(1 - ({_corr('x', 'y')}), 6) AS pearson, round(1 - {_COS}, 6) AS cosine FROM both_ GROUP BY layer, set_id)"
    )


ORACLE = {
    "layer_stats": f"WITH {_SYM} SELECT layer, count(DISTINCT src) AS nodes, count(*) // 2 AS edges FROM sym GROUP BY layer",
    "degrees": f"WITH {_SYM} SELECT layer, src AS node, count(*) AS degree, sum(weight) AS strength FROM sym GROUP BY layer, src",
    **{
        f"merge_edges_{how}": f"WITH {_RAW} SELECT layer, least(src, dst) AS src, greatest(src, dst) AS dst, round({fn}(weight), 6) AS weight FROM raw GROUP BY ALL"
        for how, fn in _FN.items()
    },
    **{
        f"merge_layers_{how}": f"WITH {_E} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round({fn}(weight), 6) AS weight FROM e GROUP BY least(src, dst), greatest(src, dst)"
        for how, fn in _FN.items()
    },
    "merge_layers_all": f"WITH {_E} SELECT src, dst, weight FROM e",
    "aggregate_layer": f"WITH {_E} SELECT src, dst, sum(weight) AS weight, string_agg(layer, ',' ORDER BY layer) AS layers FROM e GROUP BY src, dst",
    "neighbours": f"WITH {_SYM} SELECT layer, src AS node, count(DISTINCT dst) AS n, string_agg(DISTINCT dst, ',' ORDER BY dst) AS neighbours FROM sym GROUP BY layer, src",
    "neighbour_union": f"WITH {_SYM} SELECT src AS node, count(DISTINCT dst) AS n FROM sym GROUP BY src",
    "induced_edges": f"WITH {_E}, {_SUB} SELECT * FROM e WHERE src IN (SELECT node FROM sub) AND dst IN (SELECT node FROM sub)",
    "induced_summary": f"""WITH {_SYM}, {_SUB}, p AS (SELECT layer, count(DISTINCT src) AS present FROM sym WHERE src IN (SELECT node FROM sub) GROUP BY layer),
g AS (SELECT layer, count(*) AS edges FROM e WHERE src IN (SELECT node FROM sub) AND dst IN (SELECT node FROM sub) GROUP BY layer)
SELECT layer, present, coalesce(edges, 0) AS edges FROM p LEFT JOIN g USING (layer)""",
    "node_layers": f"WITH {_SYM} SELECT src AS node, count(DISTINCT layer) AS n_layers, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM sym GROUP BY src",
    "layer_matrix": f"""WITH {_SYM} SELECT src AS node, max(CASE WHEN layer = 'A' THEN 1 ELSE 0 END) AS "A", max(CASE WHEN layer = 'N' THEN 1 ELSE 0 END) AS "N",
max(CASE WHEN layer = 'R' THEN 1 ELSE 0 END) AS "R" FROM sym GROUP BY src""",
    "present_nodes": f"WITH {_SYM} SELECT DISTINCT 'P' || c_custkey AS node, ('P' || c_custkey) IN (SELECT src FROM sym) AS present FROM customer",
    "hop_distances": f"WITH {_SYM}, {_SEEDS}, {_HOPS} SELECT source, node, hops, parent FROM h{HOPS}",
    "weighted_distances": f"""WITH {_E}, {_SEEDS}, m AS (SELECT src, dst, 1 / max(weight) AS l FROM e GROUP BY src, dst),
s AS (SELECT src, dst, l FROM m UNION ALL SELECT dst, src, l FROM m), d0 AS (SELECT DISTINCT node AS source, node, 0.0 AS distance FROM seeds),
{_RELAX} SELECT source, node, round(distance, 6) AS distance FROM d{RELAXATIONS}""",
    "path_layer_counts": f"""WITH {_SYM}, {_SEEDS}, {_HOPS}, st AS (SELECT parent, node FROM h1 WHERE hops = 1)
SELECT layer, count(*) AS n_edges FROM st JOIN sym ON sym.src = st.parent AND sym.dst = st.node GROUP BY layer""",
    "identifier_components": f"WITH {_COMP} SELECT DISTINCT a AS node, component FROM comp UNION SELECT DISTINCT b, component FROM comp",
    "component_sizes": f"WITH {_COMP} SELECT component, count(*) AS size FROM (SELECT DISTINCT a AS node, component FROM comp UNION SELECT DISTINCT b, component FROM comp) GROUP BY component",
    "layer_walks": f"WITH {_LW} SELECT set_id, layer, node, round(score, 8) AS score FROM w{LAYER_STEPS}",
    "walk_means": f"""WITH {_LW}, a AS (SELECT DISTINCT set_id, layer FROM w{LAYER_STEPS}), n AS (SELECT set_id, node, count(*) AS n FROM a JOIN held USING (layer) GROUP BY ALL),
t AS (SELECT set_id, node, sum(score) AS s FROM w{LAYER_STEPS} GROUP BY ALL) SELECT set_id, node, round(s / n, 8) AS score FROM n JOIN t USING (set_id, node)""",
    "multiplex_walks": f"WITH {_MW} SELECT set_id, layer, node, round(score, 8) AS score FROM s{STEPS}",
    **{f"walk_reduced_{how}": f"WITH {_MW}, {_reduced(how)} SELECT set_id, node, round(score, 8) AS score FROM red" for how in walks.REDUCTIONS},
    "walk_ranks": f"""WITH {_VEC} SELECT v.set_id, v.node, rank() OVER (PARTITION BY v.set_id ORDER BY v.score DESC) + (count(*) OVER (PARTITION BY v.set_id, v.score) - 1) / 2 AS rank,
s.node IS NOT NULL AS is_seed FROM v LEFT JOIN (SELECT DISTINCT set_id, node FROM seeds) s ON s.set_id = v.set_id AND s.node = v.node""",
    "lines_of_evidence": f"""WITH {_VEC}, k AS (SELECT v.*, CAST(rank() OVER (PARTITION BY set_id ORDER BY score DESC) AS DOUBLE) AS rank FROM v ANTI JOIN seeds USING (set_id, node)),
p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY rank, node) AS place FROM k) SELECT set_id, node, score, rank FROM p WHERE place <= 20""",
    "walk_distances": f"""WITH {_VEC}, n AS (SELECT DISTINCT set_id FROM v), g AS (SELECT a.set_id AS a, b.set_id AS b, node FROM n a JOIN n b ON a.set_id < b.set_id CROSS JOIN (SELECT DISTINCT node FROM v)),
q AS (SELECT g.a, g.b, coalesce(p.score, 0.0) AS x, coalesce(r.score, 0.0) AS y FROM g LEFT JOIN v p ON p.set_id = g.a AND p.node = g.node LEFT JOIN v r ON r.set_id = g.b AND r.node = g.node),
z AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM q)
SELECT a, b, round(1 - ({_corr('x', 'y')}), 6) AS pearson, round(1 - {_COS}, 6) AS cosine, round(1 - ({_corr('rx', 'ry')}), 6) AS spearman FROM z GROUP BY a, b""",
    "layer_ablation": f"WITH {_ablated()} SELECT * FROM dist",
    "layer_ablation_summary": f"WITH {_ablated()} SELECT layer, round(avg(pearson), 6) AS mean, round(max(pearson), 6) AS max, round(min(pearson), 6) AS min, count(pearson) AS n FROM dist GROUP BY layer",
    "node_perturbation": f"""WITH {_SYM}, {_SEEDS}, {_multiplex()}, {_reduced('arithmetic')}, cut AS (SELECT * FROM sym WHERE src <> 'S1' AND dst <> 'S1'),
{_multiplex('cut', 'c', inter='interc AS (SELECT * FROM inter)', n_layers='(SELECT count(DISTINCT layer) FROM cut)')}, {_reduced('arithmetic', 'c', e='sym', name='redc')},
b AS (SELECT coalesce(r.set_id, c.set_id) AS set_id, coalesce(c.score, 0.0) AS x, coalesce(r.score, 0.0) AS y FROM red r FULL JOIN redc c ON c.set_id = r.set_id AND c.node = r.node)
SELECT set_id, round(1 - ({_corr('x', 'y')}), 6) AS pearson, round(1 - {_COS}, 6) AS cosine FROM b GROUP BY set_id""",
    "vector_pairs": f"""WITH u AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2 AS rk FROM u)
SELECT a.id AS a, b.id AS b, round(sum(a.v * b.v), 5) AS dot, round({_corr('a.v', 'b.v')}, 5) AS pearson, round({_corr('a.rk', 'b.rk')}, 5) AS spearman,
round(coalesce(sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 0), 0), 5) AS cosine
FROM r a JOIN r b ON a.pos = b.pos AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id""",
    "score_elbow": f"""WITH {_VEC}, c AS (SELECT set_id, score, row_number() OVER (PARTITION BY set_id ORDER BY r.score DESC, node) AS place FROM (SELECT set_id, node, score FROM red) r),
k AS (SELECT set_id, place, round(score, 8) AS score FROM c), w AS (SELECT *, min(place) OVER s AS x1, max(place) OVER s AS xn, first_value(score) OVER (PARTITION BY set_id ORDER BY place) AS y1,
first_value(score) OVER (PARTITION BY set_id ORDER BY place DESC) AS yn FROM k WINDOW s AS (PARTITION BY set_id)),
d AS (SELECT set_id, place, round(abs((yn - y1) * place - (xn - x1) * score + xn * y1 - yn * x1), 9) AS away FROM w)
SELECT set_id, place AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY away DESC, place) AS p FROM d) WHERE p = 1""",
}
