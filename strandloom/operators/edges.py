"""Layered edge tables: (layer, src, dst, weight), undirected unless said otherwise.

Null ends make no edge; a null or unreadable weight counts as 1.0; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layer names that stand for all layers (fixed values).
ALL_LAYERS = {"all", "*", "all_layers", "all layers", "multiplex"}

MERGES = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def clean(edges: DataFrame) -> DataFrame:
    """Typed edges with default weights; rows without both ends are dropped."""
    weight = F.coalesce(F.expr("try_cast(weight as double)"), F.lit(1.0))
    return edges.where("src is not null and dst is not null").select("layer", "src", "dst", weight.alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; a self-loop once. One pass, no union of two scans."""
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    ends = F.when(F.col("src") == F.col("dst"), F.slice(both, 1, 1)).otherwise(both)
    return edges.select("layer", F.explode(ends).alias("e"), "weight").select(
        "layer", F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "weight"
    )


def canonical(edges: DataFrame, how: str = "sum", self_loops: bool = False, directed: bool = False) -> DataFrame:
    """One row per layer and pair of ends, repeated edges merged by ``how`` (max, min, sum, mean)."""
    a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    kept = edges if self_loops else edges.where(F.col("src") != F.col("dst"))
    return kept.groupBy("layer", a.alias("src"), b.alias("dst")).agg(MERGES[how]("weight").alias("weight"))


def merge_layers(edges: DataFrame, how: str = "max") -> DataFrame:
    """All layers as one; ``how`` "all" keeps parallel edges."""
    if how == "all":
        return edges.select("src", "dst", "weight")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        MERGES[how]("weight").alias("weight")
    )


def aggregate_layer(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, layers): weights summed over layers, and the layers of each edge."""
    return edges.groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.array_sort(F.collect_set("layer")).alias("layers")
    )


def chosen_layers(edges: DataFrame, layers: list[str] | None) -> DataFrame:
    """The edges of the named layers; none, an empty list, or only names that mean "all"
    keep every layer. An unknown layer is an error."""
    if not layers or all(x.strip().lower() in ALL_LAYERS for x in layers):
        return edges
    wanted = list(dict.fromkeys(layers))
    known = {r[0] for r in edges.select("layer").distinct().where(F.col("layer").isin(wanted)).collect()}
    missing = sorted(set(wanted) - known)
    if missing:
        raise ValueError(f"unknown layers: {missing}")
    return edges.where(F.col("layer").isin(wanted))


def degrees(edges: DataFrame) -> DataFrame:
    """(layer, node, degree, strength) of every node with an edge."""
    return symmetric(edges).groupBy("layer", F.col("src").alias("node")).agg(
        F.count("*").alias("degree"), F.sum("weight").alias("strength")
    )


def layer_stats(edges: DataFrame) -> DataFrame:
    """(layer, nodes, edges): nodes with any edge, and undirected edges."""
    return edges.select("layer", F.explode(F.array("src", "dst")).alias("node"), F.lit(0.5).alias("half")).groupBy("layer").agg(
        F.count_distinct("node").alias("nodes"), F.sum("half").cast("bigint").alias("edges")
    )


def layer_order(edges: DataFrame, by: str = "edges", descending: bool = True, top_k: int = 50) -> DataFrame:
    """Layer statistics in order of one of them; ties keep the order of the layers' names."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    return layer_stats(edges).orderBy(key, "layer").limit(top_k)


def node_universe(edges: DataFrame) -> DataFrame:
    """Distinct nodes of all layers."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(layer, node, n, neighbours): sorted distinct neighbours of ``nodes`` (node), or of all."""
    both = symmetric(edges).withColumnRenamed("src", "node")
    if nodes is not None:
        both = both.join(nodes.select("node").distinct(), "node", "left_semi")
    found = both.groupBy("layer", "node").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return found.select("layer", "node", F.size("neighbours").alias("n"), "neighbours")


def neighbour_union(edges: DataFrame) -> DataFrame:
    """(node, n): distinct neighbours over all layers."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes`` (node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("node", "dst"), "dst", "left_semi"
    ).select("layer", "src", "dst", "weight")


def induced_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer, present, edges): per layer the nodes that occur in it and the edges among them."""
    among = induced(edges, nodes).groupBy("layer").agg(F.count("*").alias("edges"))
    present = (
        edges.select("layer", F.explode(F.array("src", "dst")).alias("node"))
        .join(nodes.select("node").distinct(), "node", "left_semi")
        .groupBy("layer")
        .agg(F.count_distinct("node").alias("present"))
    )
    return present.join(among, "layer", "left").select("layer", "present", F.coalesce("edges", F.lit(0)).alias("edges"))


def node_layers(edges: DataFrame) -> DataFrame:
    """(node, n_layers, layers)."""
    found = edges.select("layer", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(
        F.array_sort(F.collect_set("layer")).alias("layers")
    )
    return found.select("node", F.size("layers").alias("n_layers"), "layers")


def layer_matrix(edges: DataFrame, layers: list[str]) -> DataFrame:
    """One row per node, one 0/1 column per layer."""
    ends = edges.select("layer", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(*[F.max((F.col("layer") == x).cast("int")).alias(x) for x in layers])


def present_flags(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, present) for wanted nodes, whether the network has them."""
    return wanted.select("node").distinct().join(
        node_universe(edges).withColumn("present", F.lit(True)), "node", "left"
    ).select("node", F.coalesce("present", F.lit(False)).alias("present"))


def normal_names(names: Column) -> Column:
    """Array of names trimmed, in upper case, sorted and distinct; path-like ones left out."""
    bare = F.transform(names, lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"[/\\]"))))
