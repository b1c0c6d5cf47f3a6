"""Annotations of items, and small set, order and rank operators on them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.scalar import canonical_json


def nfkc(text: Column) -> Column:
    """Texts in compatibility form, without outer blanks."""

    @F.pandas_udf(T.StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())

    return fold(text)


def ordered_distinct(items: Column) -> Column:
    """Trimmed items without nulls, blanks and repeats, the first of each kept in place; empty for null."""
    bare = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(bare), F.array().cast("array<string>"))


def first_rows(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by ``position``."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def set_algebra(a: Column, b: Column) -> dict[str, Column]:
    """Sorted union, intersection and difference of two item arrays; null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return {
        "union": F.array_sort(F.array_union(a, b)),
        "intersection": F.array_sort(F.array_intersect(a, b)),
        "difference": F.array_sort(F.array_except(a, b)),
    }


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of a request: the key of its cached answer."""
    return F.sha2(canonical_json(fields), 256)


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with their cached answer; ``status`` is ``hit`` or ``cache_miss``. Nothing is fetched."""
    return requests.join(cache.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "status", F.when(F.col("_hit"), "hit").otherwise("cache_miss")
    ).drop("_hit")


def ordered_enrichment(results: DataFrame, keys: list[str], p_value: str, source: str, native: str, k: int, without: list[str] | None = None) -> DataFrame:
    """The first ``k`` results of each key by p-value (null counts as 1), source and id, with
    their ``place``; results of sources ``without`` are left out before."""
    if without:
        results = results.where(~F.col(source).isin(*without))
    w = Window.partitionBy(*keys).orderBy(F.coalesce(p_value, F.lit(1.0)), source, native)
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ordered_paths(paths: DataFrame, length: str, name: str, k: int) -> DataFrame:
    """The first ``k`` paths by length (null is longest) and name."""
    return paths.orderBy(F.coalesce(length, F.lit(1e9)), name).limit(k)


def present_fields(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the order asked for."""
    return df.select(*[c for c in wanted if c in df.columns])


def annotation_index(records: DataFrame, key: str, at: str, values: list[str], fallback: DataFrame) -> DataFrame:
    """(key, values): of each key the values of its last record by ``at``; values it leaves null,
    and keys without a record, are taken from ``fallback``."""
    last = records.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *values)).alias("r")).select(key, *[F.col(f"r.{v}").alias(v) for v in values])
    other = fallback.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    return last.join(other, key, "full").select(key, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def symbol_facts(pairs: DataFrame, ident: str, symbol: str) -> DataFrame:
    """(family, subject, object): facts of a many-to-many map. A symbol of one id names it
    (``symbol``), one of several is ambiguous (``ambiguous``, its ids sorted and joined by
    commas), and every id has its symbols (``id``)."""
    rows = pairs.select(ident, symbol).where(F.col(ident).isNotNull() & F.col(symbol).isNotNull()).distinct()
    # the ids of one symbol and the symbols of one id are one fact by definition
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.col(c).cast("string"))))
    by_symbol = rows.groupBy(F.col(symbol).cast("string").alias("subject")).agg(joined(ident).alias("object"), F.count("*").alias("n"))
    by_id = rows.groupBy(F.col(ident).cast("string").alias("subject")).agg(joined(symbol).alias("object"))
    return by_symbol.select(F.when(F.col("n") == 1, "symbol").otherwise("ambiguous").alias("family"), "subject", "object").unionByName(
        by_id.select(F.lit("id").alias("family"), "subject", "object")
    )


def degrees_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree): edge ends of every node in the subgraph of ``nodes`` (node), over all layers."""
    inside = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    ends = inside.select(F.col("src").alias("node")).unionByName(inside.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def best_ranks(ranks: DataFrame, item: str, rank: str, row: str) -> DataFrame:
    """(item, rank, row): the smallest rank of each item over all rows; the first row of ties."""
    return ranks.groupBy(item).agg(F.min(F.struct(rank, row)).alias("b")).select(item, f"b.{rank}", f"b.{row}")


def rank_of(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, node, rank, score): where asked nodes stand; null where a vector lacks them."""
    return wanted.select("set_id", "node").distinct().join(ranks.select("set_id", "node", "rank", "score"), ["set_id", "node"], "left")


def dot_similarity(a: Column, b: Column, dot: Column) -> Column:
    """The raw dot product of two vectors; 1 of one with itself."""
    return F.when(a == b, F.lit(1.0)).otherwise(dot)


def rows_before_elbow(ranks: DataFrame, elbow: DataFrame, group: str, item: str, rank: str) -> DataFrame:
    """Rows of the items that any row of the group ranks before its ``elbow``."""
    kept = ranks.join(elbow, group).where(F.col(rank) < F.col("elbow")).select(group, item).distinct()
    return ranks.join(kept, [group, item], "left_semi")


def band_negatives(candidates: DataFrame, groups: list[str], item: str, distance: str, n: int, band: tuple[float, float], strict: bool = True) -> DataFrame:
    """``n`` items per group, from the band of distance percentiles first, then from the nearest
    outside it; ties by hash. ``from_band`` marks the first kind. A group of fewer than ``n``
    candidates is an error unless not ``strict``."""
    w = Window.partitionBy(*groups)
    size = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(distance, item)) - 1
    placed = candidates.withColumn("percentile", F.when(size == 1, 1.0).otherwise(at / (size - 1)))
    middle = (band[0] + band[1]) / 2
    placed = placed.withColumn("from_band", F.col("percentile").between(*band))
    order = w.orderBy(F.desc("from_band"), F.when(F.col("from_band"), 0.0).otherwise(F.abs(F.col("percentile") - middle)), F.sha2(F.col(item).cast("string"), 256), item)
    picked = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    if strict:
        short = candidates.groupBy(*groups).agg(F.count("*").alias("_n")).where(F.col("_n") < n).count()
        if short:
            raise ValueError(f"{short} groups have fewer than {n} candidates")
    return picked
