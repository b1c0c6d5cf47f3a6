"""Set-valued records: clean sets, and classes of records whose sets are equal.

A set is the distinct items of an array, trimmed, in upper case, without version suffix;
nulls and blanks are left out. Records whose set is empty (or null) belong to no class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_set(items: Column) -> Column:
    """Sorted distinct items of an array column; an empty array for null."""
    bare = F.transform(items, lambda x: F.regexp_replace(F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")), r"\.[0-9]+$", ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def latest(df: DataFrame, key: str, at: str, columns: list[Column]) -> DataFrame:
    """One row per non-null key: of its repeats the latest (ties: the greatest by the columns)."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.struct(F.col(at).alias("_at"), *columns)).alias("_row"))
        .select(F.col("_key").alias(key), "_row.*")
        .drop("_at")
    )


def set_class(items: Column) -> Column:
    """The class id of a clean set: equal sets, and only those, share it."""
    return F.md5(F.concat_ws("\u0001", items))


def classes(members: DataFrame, flags: list[str]) -> DataFrame:
    """(cls, items, *flags): one row per distinct non-empty set of ``members`` (cls, items,
    flags); a flag holds if it holds for any member."""
    return (
        members.where(F.size("items") > 0)
        .groupBy("cls")
        .agg(F.first("items").alias("items"), *[F.max(f).alias(f) for f in flags])
    )


def symbols(items: Column) -> Column:
    """Set items as sorted 64-bit symbols."""
    return F.array_sort(F.transform(items, lambda x: F.xxhash64(x)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
