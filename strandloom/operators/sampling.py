"""Deterministic sampling, balancing and sharding. Order comes from SHA-256 keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalar import stable_key
from strandloom.runtime import materialize


def subset(df: DataFrame, groups: list[str], value: str, n: Column | int, salt: str) -> DataFrame:
    """``n`` rows of each group in the order of the hash of (salt, value)."""
    w = Window.partitionBy(*groups).orderBy(stable_key(F.lit(salt), F.col(value)), value)
    return df.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= (F.lit(n) if isinstance(n, int) else n)).drop("_p")


def balance(df: DataFrame, strata: list[str], kinds: list[str], key: str, salt: str = "balance") -> DataFrame:
    """Within each stratum every kind is cut to the size of its smallest kind, by hash order."""
    sizes = df.groupBy(*strata, *kinds).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(*strata).agg(F.min("_n").alias("_least")) if strata else sizes.agg(F.min("_n").alias("_least"))
    ranked = df.withColumn(
        "_p", F.row_number().over(Window.partitionBy(*strata, *kinds).orderBy(stable_key(F.lit(salt), F.col(key)), key))
    )
    joined = ranked.join(least, strata) if strata else ranked.crossJoin(F.broadcast(least))  # one row
    return joined.where(F.col("_p") <= F.col("_least")).drop("_p", "_least")


def capped_fill(df: DataFrame, weak: Column, key: str, target: int, share: float = 0.2) -> DataFrame:
    """``target`` rows by hash order, of which weak ones at most ceil(share * target) unless
    the others do not suffice."""
    cap = -(-int(target * share * 1_000_000) // 1_000_000)
    order = (stable_key(F.lit("fill"), F.col(key)), F.col(key))
    flagged = df.withColumn("_weak", weak)
    first = flagged.withColumn("_w", F.row_number().over(Window.partitionBy("_weak").orderBy(*order)))
    late = F.col("_weak") & (F.col("_w") > cap)
    return first.orderBy(late, *order).limit(target).drop("_weak", "_w")


def shard(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """``shard``: the first 16 hex digits of the key's SHA-256, modulo ``shards`` (below 2^31)."""
    part = lambda at: F.conv(F.substring(F.sha2(key, 256), at, 8), 16, 10).cast("bigint")
    # 64 unsigned bits do not fit a long: the upper half is reduced first
    return df.withColumn("shard", F.pmod(F.pmod(part(1), F.lit(shards)) * F.lit((1 << 32) % shards) + part(9), F.lit(shards)).cast("int"))


def leave_one_out_sets(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, left_out, item): each group once per item, without it."""
    a = df.select(group, F.col(item).alias("left_out")).distinct()
    b = df.select(group, item).distinct()
    return a.join(b, group).where(F.col(item) != F.col("left_out"))


def first_of_equal(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row per distinct value, the first by ``order``."""
    return df.groupBy(value).agg(F.min_by(F.struct(*[c for c in df.columns if c != value]), order).alias("_r")).select(value, "_r.*")


def disjoint_panels(df: DataFrame, component: str, sizes: list[tuple[str, int]]) -> DataFrame:
    """``panel`` for components in hash order: fixed numbers for each panel in turn, null for the rest."""
    unique = df.select(component).distinct().withColumn(
        "_p", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(stable_key(F.lit("panel"), F.col(component)), component))
    )
    name, edge = F.lit(None).cast("string"), sum(n for _, n in sizes)
    for label, n in reversed(sizes):
        name = F.when(F.col("_p") <= edge, label).otherwise(name)
        edge -= n
    return df.join(unique.select(component, name.alias("panel")), component)


def conflict_free_exactly(df: DataFrame, group: str, item: str, member: str, n: int, attempts: int = 32) -> DataFrame:
    """As :func:`conflict_free`, but with exactly ``n`` items for every group: groups that come
    out short are drawn again in another order, up to ``attempts`` times; one that never
    reaches ``n`` is an error."""
    left, out = df, None
    for attempt in range(attempts):
        picked = materialize(conflict_free(left, group, item, member, n, salt=f"conflict{attempt or ''}"), "picked")
        full = picked.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(group)
        done = picked.join(full, group, "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, group, "left_anti")
        if left.isEmpty():
            return out
    raise ValueError(f"{left.select(group).distinct().count()} groups have no {n} items without conflicts")


def conflict_free(df: DataFrame, group: str, item: str, member: str, n: int, salt: str = "conflict") -> DataFrame:
    """Greedy choice of up to ``n`` items per group, in hash order, none sharing a ``member``
    with an earlier one.

    ``df`` has (group, item, array of members). The choice is sequential, so a group is one
    task; groups are bounded by the caller's candidates per group.
    """
    schema = f"{group} {dict(df.dtypes)[group]}, {item} {dict(df.dtypes)[item]}, place int"
    ordered = df.select(group, item, member, stable_key(F.lit(salt), F.col(item)).alias("_k"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, taken = None, set(), 0
        for pdf in batches:
            out = []
            for g, i, m in zip(pdf[group], pdf[item], pdf[member]):
                if g != now:
                    now, used, taken = g, set(), 0
                members = set(m) if m is not None else set()
                if taken < n and not used & members:
                    used |= members
                    taken += 1
                    out.append((g, i, taken))
            yield pd.DataFrame(out, columns=[group, item, "place"])

    return ordered.repartition(group).sortWithinPartitions(group, "_k", item).mapInPandas(pick, schema)
