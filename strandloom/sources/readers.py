"""Readers of the text formats: edge lists, layer lists, matrices, JSON lines, seed sets.

Schemas are explicit. Readers named strict fail on a malformed row, tolerant ones skip it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def layer_list(spark: SparkSession, path: str, limit: int | None = None) -> list[tuple[str, str]]:
    """(path, layer) of the enabled rows of a layer list (tab-separated: path, layer, enabled).

    A third column of 0, false or False disables a row; fewer than two columns and a list
    without enabled rows are errors. Layer lists name files, so they are driver-sized."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.trim("value").alias("v")).where("v <> ''").select("c").collect()
    out = []
    for (cells,) in rows:
        if len(cells) < 2:
            raise ValueError(f"layer list row needs two columns: {cells}")
        if len(cells) > 2 and cells[2].strip() in {"0", "false", "False"}:
            continue
        out.append((cells[0].strip(), cells[1].strip()))
        if limit and len(out) >= limit:
            break
    if not out:
        raise ValueError("no enabled layer")
    return out


def edge_list(spark: SparkSession, path: str, layer: str, self_loops: bool = False) -> DataFrame:
    """(layer, src, dst, weight) of a white-space separated edge list; blank lines, comments
    and lines with one field are skipped, a bad or absent weight is 1.0."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.trim("value").alias("v")).where(
        "v <> '' and not startswith(v, '#')"
    )
    weight = F.coalesce(F.expr("try_cast(try_element_at(c, 3) as double)"), F.lit(1.0))
    edges = cells.where(F.size("c") >= 2).select(F.lit(layer).alias("layer"), F.col("c")[0].alias("src"), F.col("c")[1].alias("dst"), weight.alias("weight"))
    return edges if self_loops else edges.where("src <> dst")


def multiplex(spark: SparkSession, path: str, limit: int | None = None, overwrite: bool = False) -> DataFrame:
    """All layers of a layer list as one edge table; relative paths start at the list's folder.

    By default loops are left out and repeated edges kept (the store merges them). With
    ``overwrite`` loops stay and of a repeated edge the last line counts (see :func:`last_edges`)."""
    out = None
    for where, layer in layer_list(spark, path, limit):
        full = where if os.path.isabs(where) or "://" in where else os.path.join(os.path.dirname(path), where)
        part = last_edges(spark, full, layer) if overwrite else edge_list(spark, full, layer)
        out = part if out is None else out.unionByName(part)
    return out


def last_edges(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, src, dst, weight) of an edge list as a graph would hold it: loops stay, and of
    lines for one undirected edge the last counts, by the order of files and lines."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.trim("value").alias("v"), F.monotonically_increasing_id().alias("at")).where(
        "v <> '' and not startswith(v, '#')"
    )
    a, b = F.col("c")[0], F.col("c")[1]
    weight = F.coalesce(F.expr("try_cast(try_element_at(c, 3) as double)"), F.lit(1.0))
    rows = cells.where(F.size("c") >= 2).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), weight.alias("weight"), "at")
    return rows.groupBy("src", "dst").agg(F.max_by("weight", "at").alias("weight")).select(F.lit(layer).alias("layer"), "src", "dst", "weight")


def labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of a table of labels: comma-separated with a header if the name ends in
    .csv, else JSON lines; a missing column is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def task_rows(df: DataFrame, key, position: str, shards: int, shard_no: int, most: int | None = None) -> DataFrame:
    """The rows of one hash shard (see :func:`strandloom.operators.sampling.shard`), of these the
    first ``most`` by ``position``."""
    from strandloom.operators.sampling import shard

    own = shard(df, key, shards).where(F.col("shard") == shard_no).drop("shard")
    return own if most is None else own.orderBy(position).limit(most)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; strict reading fails on a bad row, tolerant reading drops it."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def labelled_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_label, col_label, value) of a tab-separated matrix with an INDEX header; what is no number is null."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("c"))
    head = lines.where(F.col("c")[0] == "INDEX").limit(1).collect()  # one row: the header
    if not head:
        raise ValueError("matrix without INDEX header")
    names = F.array(*[F.lit(x) for x in head[0][0][1:]])
    body = lines.where(F.col("c")[0] != "INDEX").select(F.col("c")[0].alias("row_label"), F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("k", "v"))
    return body.select("row_label", F.try_element_at(names, F.col("k") + 1).alias("col_label"), F.expr("try_cast(v as double)").alias("value"))


def distance_pairs(matrix: DataFrame) -> DataFrame:
    """(a, b, value) with a < b of a square symmetric, upper or lower matrix: one value per
    pair. Rows and columns of other labels, and halves that disagree, are an error."""
    rows, cols = matrix.select("row_label").distinct(), matrix.select("col_label").distinct()
    odd = rows.join(cols, F.col("row_label") == F.col("col_label"), "full").where("row_label is null or col_label is null")
    if not odd.isEmpty():
        raise ValueError("row and column labels of a distance matrix must be the same")
    ok = matrix.where("value is not null and row_label <> col_label")
    pairs = ok.groupBy(F.least("row_label", "col_label").alias("a"), F.greatest("row_label", "col_label").alias("b")).agg(
        F.max("value").alias("value"), F.min("value").alias("least")
    )
    if not pairs.where(F.col("value") - F.col("least") > 1e-9 * F.greatest(F.abs("value"), F.lit(1.0))).isEmpty():
        raise ValueError("the halves of a distance matrix disagree")
    return pairs.drop("least")


def seed_sets(spark: SparkSession, path: str, skip_first: bool = False, sep: str = "\t") -> DataFrame:
    """(set_id, node): one seed set per line, named by the first column if that is skipped as
    an id, else by the line's text. A line too short for its id is an error."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", sep).alias("c"), "value")
    if skip_first:
        short = lines.where(F.size("c") < 2).limit(1).collect()
        if short:
            raise ValueError(f"seed line without nodes: {short[0][1]!r}")
        return lines.select(F.col("c")[0].alias("set_id"), F.explode(F.slice("c", F.lit(2), F.size("c"))).alias("node")).where("node <> ''").distinct()
    return lines.select(F.col("value").alias("set_id"), F.explode("c").alias("node")).where("node <> ''").distinct()


def background_items(spark: SparkSession, path: str, field: str = "gene_ids") -> DataFrame:
    """Distinct items of lines that hold a JSON object with a list, a JSON list, or plain text (its first token)."""
    v = F.trim("value")
    as_list = T.ArrayType(T.StringType())
    items = (
        F.when(v.startswith("{"), F.from_json(F.get_json_object(v, f"$.{field}"), as_list))
        .when(v.startswith("["), F.from_json(v, as_list))
        .otherwise(F.array(F.split(v, r"\s+")[0]))
    )
    return spark.read.text(path).where(v != "").select(F.explode(items).alias("item")).where("item <> ''").distinct()


def gtf_genes(spark: SparkSession, path: str, id_pattern: str = r"ENSG\d{11}") -> DataFrame:
    """(gene_id, symbol) of the gene rows of a (gzipped) annotation table; symbol may be null."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").select(cells.alias("c")).where(F.size("c") == 9).where(F.col("c")[2] == "gene")
    gene = F.regexp_extract(F.col("c")[8], rf'gene_id "({id_pattern})', 1)
    name = F.trim(F.regexp_extract(F.col("c")[8], r'gene_name "([^"]*)"', 1))
    return rows.select(gene.alias("gene_id"), F.when(name != "", name).alias("symbol")).where("gene_id <> ''").distinct()


def complex_rows(spark: SparkSession, path: str) -> DataFrame:
    """Complex table (tab-separated, header): list columns split and aligned to the symbols."""
    from strandloom.functions.scalar import aligned, list_field

    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    symbols = list_field(F.col("subunits_gene_name"))
    n = F.size(symbols)
    members = F.arrays_zip(symbols.alias("symbol"), aligned(list_field(F.col("subunits_uniprot_id")), n).alias("uniprot"))
    return df.select("complex_id", "complex_name", "organism", n.alias("size"), members.alias("members"), list_field(F.col("pmid")).alias("pmids"))


def dendrogram_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed tree rows; a header other than the five expected columns is an error."""
    wanted = ["node_id", "left_id", "right_id", "height", "label"]
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    if sorted(df.columns) != sorted(wanted):
        raise ValueError(f"unexpected columns: {df.columns}")
    kinds = {"height": "double", "label": "string"}
    return df.select(*[F.expr(f"try_cast({c} as {kinds.get(c, 'bigint')})").alias(c) for c in wanted])


def tree_faults(tree: DataFrame) -> DataFrame:
    """(fault, n) of a single tree: repeated ids, one-child nodes, missing children, roots other than one."""
    kids = tree.select(F.explode(F.array("left_id", "right_id")).alias("node_id")).where("node_id >= 0")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    repeated = tree.groupBy("node_id").agg(F.count("*").alias("c")).where("c > 1")
    one = tree.where((F.col("left_id") < 0) != (F.col("right_id") < 0))
    missing = kids.distinct().join(tree.select("node_id"), "node_id", "left_anti")
    roots = tree.select("node_id").distinct().join(kids, "node_id", "left_anti")
    faults = count(repeated, "repeated_id").unionByName(count(one, "one_child")).unionByName(count(missing, "missing_child"))
    return faults.unionByName(count(roots, "roots")).where("(fault = 'roots' and n <> 1) or (fault <> 'roots' and n > 0)")
