"""Writers: layered stores, tables, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.edges import canonical, layer_stats, merge_layers, symmetric


def write_store(edges: DataFrame, path: str) -> None:
    """A layered store: merged edges, adjacency in both directions (partitioned by layer,
    sorted by source for pruning), the aggregate layer, layer statistics."""
    merged = canonical(edges)
    merged.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/edges")
    symmetric(merged).repartition("layer", "src").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("layer").parquet(f"{path}/adjacency")
    merge_layers(merged, "sum").write.mode("overwrite").parquet(f"{path}/aggregate")
    layer_stats(merged).withColumn("format_version", F.lit(2)).write.mode("overwrite").parquet(f"{path}/layers")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a store; statistics that do not fit them are an error."""
    edges = spark.read.parquet(f"{path}/edges").select("layer", "src", "dst", "weight")
    stats = spark.read.parquet(f"{path}/layers")
    if "format_version" not in stats.columns:
        raise ValueError("not a layered store")
    names = [c for c in stats.columns if c != "format_version"]
    found = layer_stats(edges).select(*names)
    if not stats.select(*names).exceptAll(found).isEmpty() or not found.exceptAll(stats.select(*names)).isEmpty():
        raise ValueError("the statistics of the store do not fit its edges")
    return edges


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_binary_matrix(vectors: DataFrame, path: str, rows: str, columns: str, value: str) -> None:
    """A long matrix as columnar files, sorted by row and column, beside a table of its axes."""
    kept = vectors.select(F.col(rows).alias("row_label"), F.col(columns).alias("col_label"), F.col(value).cast("double").alias("value"))
    kept.repartitionByRange("row_label").sortWithinPartitions("row_label", "col_label").write.mode("overwrite").parquet(f"{path}/cells")
    axes = kept.select(F.lit("row").alias("axis"), F.col("row_label").alias("label")).union(kept.select(F.lit("column"), F.col("col_label"))).distinct()
    axes.write.mode("overwrite").parquet(f"{path}/axes")


def evidence_table(ranks: DataFrame, seeds: DataFrame, networks: str) -> DataFrame:
    """Lines of evidence in their text format: NodeNames, Scores, rank (cut to a whole number),
    num_in_network, num_seeds, networks, modname, seed_geneset; one row per ranked node."""
    own = seeds.select("set_id", "node").distinct().groupBy("set_id").agg(
        F.count("*").alias("num_seeds"), F.concat_ws(",", F.array_sort(F.collect_set("node"))).alias("seed_geneset")
    )  # a set's seeds are one line of the format
    size = ranks.groupBy("set_id").agg(F.count("*").alias("num_in_network"))
    return ranks.join(size, "set_id").join(own, "set_id").select(
        F.col("node").alias("NodeNames"), F.col("score").alias("Scores"), F.floor("rank").cast("int").alias("rank"),
        "num_in_network", "num_seeds", F.lit(networks).alias("networks"), F.col("set_id").alias("modname"), "seed_geneset",
    )


def write_rounded_network(edges: DataFrame, path: str) -> None:
    """Edge lines (src, dst, weight with three decimals), tab-separated, one folder a layer."""
    edges.select("layer", F.concat_ws("\t", "src", "dst", F.format_string("%.3f", F.col("weight").cast("double"))).alias("value")).write.mode("overwrite").partitionBy("layer").text(path)


def network_json(edges: DataFrame, default_weight: float = 1.0) -> DataFrame:
    """(layer, document): each layer as a JSON text; a weight equal to the default is left out."""
    cells = F.when(F.col("weight") == default_weight, F.array("src", "dst")).otherwise(F.array("src", "dst", F.col("weight").cast("string")))
    # One document holds one layer by definition of the format.
    return edges.groupBy("layer").agg(F.array_sort(F.collect_list(cells)).alias("edges")).select(
        "layer", F.to_json(F.struct(F.lit(False).alias("directed"), F.lit(default_weight).alias("default_intra_weight"), "edges")).alias("document")
    )


def lower_triangle(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A labelled lower-triangle table (INDEX, one column per label) from (a, b, value)."""
    both = pairs.select(F.greatest("a", "b").alias("INDEX"), F.least("a", "b").alias("col"), "value")
    return both.groupBy("INDEX").pivot("col", labels).agg(F.first("value")).orderBy("INDEX")
