"""Gene sets of trees. Trees come as (node_id, root_id, depth, path) from ``hierarchy`` with ``paths=True``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalar import module_bin


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(node_id, ancestor, distance) for every rooted node and each node of its path, itself too."""
    return tree.where("path is not null").select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor")).select(
        "node_id", "ancestor", (F.col("depth") - F.col("pos")).cast("int").alias("distance")
    )


def subtree_items(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node_id, item): distinct items of the leaves (node_id, item) at or below every node."""
    return ancestor_pairs(tree).join(leaves.where("item is not null").select("node_id", "item"), "node_id").select(
        F.col("ancestor").alias("node_id"), "item"
    ).distinct()


def modules(tree: DataFrame, leaves: DataFrame, heights: DataFrame, least: int = 5, most: int = 30) -> DataFrame:
    """(node_id, height, n, bin, items_key, duplicates): nodes with ``least`` to ``most`` items;
    of equal item sets the lowest (height, node_id) stays."""
    sized = subtree_items(tree, leaves).groupBy("node_id").agg(F.count("*").alias("n"))
    # Only sets of bounded size are gathered.
    kept = sized.where(F.col("n").between(least, most))
    items = subtree_items(tree, leaves).join(kept, "node_id").groupBy("node_id").agg(
        F.first("n").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items_key")
    )
    w = Window.partitionBy("items_key").orderBy(F.asc_nulls_last("height"), "node_id")
    return (
        items.join(heights, "node_id", "left")
        .withColumn("_p", F.row_number().over(w))
        .withColumn("duplicates", F.count("*").over(Window.partitionBy("items_key")) - 1)
        .where("_p = 1")
        .select("node_id", "height", "n", module_bin(F.col("n")).alias("bin"), "items_key", "duplicates")
    )


def lca_distances(tree: DataFrame, heights: DataFrame, modules_: DataFrame) -> DataFrame:
    """(module, node_id, distance): for each module (module: a node id) the nodes of its tree
    that are not below it, with the height of their lowest common ancestor above the module."""
    anc = ancestor_pairs(tree)
    up = anc.join(modules_.select(F.col("module").alias("node_id")).distinct(), "node_id").select(
        F.col("node_id").alias("module"), "ancestor", F.col("distance").alias("up")
    )
    met = up.join(anc.select("node_id", "ancestor"), "ancestor").groupBy("module", "node_id").agg(F.min(F.struct("up", "ancestor")).alias("m"))
    outside = met.where(F.col("m.up") > 0).select("module", "node_id", F.col("m.ancestor").alias("lca"))
    h = heights.select("node_id", "height")
    return (
        outside.join(h.select(F.col("node_id").alias("lca"), F.col("height").alias("h_lca")), "lca")
        .join(h.select(F.col("node_id").alias("module"), F.col("height").alias("h_own")), "module")
        .select("module", "node_id", F.greatest(F.lit(0.0), F.col("h_lca") - F.col("h_own")).alias("distance"))
    )


def percentile_band(df: DataFrame, groups: list[str], order: list[Column], low: float, high: float) -> DataFrame:
    """Rows whose place over n - 1 lies within [low, high] (1.0 in a group of one)."""
    n = F.count("*").over(Window.partitionBy(*groups))
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    placed = df.withColumn("percentile", F.when(n == 1, 1.0).otherwise(at / (n - 1)))
    return placed.where(F.col("percentile").between(low, high))
