"""Vector comparison on long tables (id, pos, value) and on array columns.

Correlations use sample moments with a guard: a vector whose deviation is below 1e-8 counts
as all zeros, so its correlation with anything is 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import materialize

GUARD = 1e-8


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, pos, value) of an array column; null vectors have no rows, null values count as 0."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.posexplode(vector).alias("pos", "v")).select(
        "id", "pos", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("value")
    )


def array_dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


PREPARED = "v array<double>, z array<double>, r array<double>, norm double"


def prepared(vectors: pd.Series) -> pd.DataFrame:
    """Of each vector: itself with nulls as 0, standardised (mean 0, sample deviation 1; all
    zeros if the deviation is tiny), its average ranks standardised, and its length."""
    out = []
    for given in vectors:
        v = np.nan_to_num(np.array([0.0 if x is None else x for x in given], float))
        values, at, count = np.unique(v, return_inverse=True, return_counts=True)
        ranks = (np.cumsum(count) - (count - 1) / 2)[at]
        row = [v]
        for x in (v, ranks):
            sd = x.std(ddof=1) if len(x) > 1 else 0.0
            row.append((x - x.mean()) / (1.0 if sd < GUARD else sd) if len(x) else x)
        out.append((*row, float(np.sqrt(v @ v))))
    return pd.DataFrame(out, columns=["v", "z", "r", "norm"])


def pairwise(df: DataFrame, key: str, vector: str, queries: Column) -> DataFrame:
    """(a, b, dot, pearson, spearman, cosine) of every query row against all others.

    ``queries`` says which rows ask. Each row is prepared once, in Arrow batches, before the
    rows meet; null keys and null vectors are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).alias("id"), queries.alias("asks"), F.pandas_udf(prepared, PREPARED)(F.col(vector)).alias("p")
    ).select("id", "asks", "p.*")
    rows = materialize(rows, "vectors")
    a = rows.where("asks").select(*[F.col(c).alias(f"{c}_a") for c in ("id", "v", "z", "r", "norm")])
    b = rows.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "v", "z", "r", "norm")])
    n = F.size("z_a") - 1
    dot = array_dot(F.col("v_a"), F.col("v_b"))
    return a.join(b, F.col("id_a") != F.col("id_b")).select(
        F.col("id_a").alias("a"),
        F.col("id_b").alias("b"),
        dot.alias("dot"),
        (array_dot(F.col("z_a"), F.col("z_b")) / n).alias("pearson"),
        (array_dot(F.col("r_a"), F.col("r_b")) / n).alias("spearman"),
        F.coalesce(F.try_divide(dot, F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"),
    )


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums, with the guard on both deviations."""
    vx, vy = (sxx - sx * sx / n) / (n - 1), (syy - sy * sy / n) / (n - 1)
    cov = (sxy - sx * sy / n) / (n - 1)
    flat = (F.sqrt(F.greatest(vx, F.lit(0.0))) < GUARD) | (F.sqrt(F.greatest(vy, F.lit(0.0))) < GUARD)
    return F.when(flat, 0.0).otherwise(cov / F.sqrt(vx * vy))


def column_distances(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Distances between two value columns within each group: dot, 1 - pearson, 1 - cosine, 1 - spearman."""
    rank = lambda c: F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (F.count("*").over(Window.partitionBy(*groups, c)) - 1) / 2
    rows = df.withColumn("_rx", rank(x)).withColumn("_ry", rank(y))
    s = lambda a, b=None: F.sum(F.col(a) if b is None else F.col(a) * F.col(b))
    r = lambda a, b: correlation(F.count("*"), s(a), s(b), s(a, a), s(b, b), s(a, b))
    return rows.groupBy(*groups).agg(
        s(x, y).alias("dot"),
        (1 - r(x, y)).alias("pearson"),
        (1 - F.coalesce(F.try_divide(s(x, y), F.sqrt(s(x, x) * s(y, y))), F.lit(0.0))).alias("cosine"),
        (1 - r("_rx", "_ry")).alias("spearman"),
    )


def set_distances(df: DataFrame) -> DataFrame:
    """(a, b, pearson, cosine, spearman): distances as of :func:`column_distances` between the
    vectors (set_id, node, score) of every two sets, over all nodes; an absent node counts as 0.

    Ranks are those of the distinct scores of a set, and are taken from the rank of 0, so that
    an absent node adds nothing to any sum."""
    n = F.lit(df.select("node").distinct().count())
    held = df.groupBy("set_id", "score").agg(F.count("*").alias("n"))
    absent = df.groupBy("set_id").agg((n - F.count("*")).alias("n")).select("set_id", F.lit(0.0).alias("score"), "n")
    held = held.unionByName(absent).groupBy("set_id", "score").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("set_id").orderBy("score"))
    held = held.withColumn("rank", ahead - (F.col("n") - 1) / 2)
    zero = held.where("score = 0").select("set_id", F.col("rank").alias("zero"))
    ranks = held.join(zero, "set_id").select("set_id", "score", (F.col("rank") - F.col("zero")).alias("r"))
    rows = materialize(df.join(ranks, ["set_id", "score"]).select("set_id", "node", F.col("score").alias("x"), "r"), "ranks")
    own = rows.groupBy("set_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(c) for c, a, b in (("xx", "x", "x"), ("rr", "r", "r"))], F.sum("x").alias("x"), F.sum("r").alias("r"))
    side = lambda t, s: t.select(*[F.col(c).alias({"set_id": s}.get(c, c if c == "node" else f"{c}_{s}")) for c in t.columns])
    met = side(rows, "a").join(side(rows, "b"), "node").where(F.col("a") < F.col("b"))
    met = met.groupBy("a", "b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("xy"), F.sum(F.col("r_a") * F.col("r_b")).alias("rs"))
    pairs = side(own, "a").join(side(own, "b"), F.col("a") < F.col("b")).join(met, ["a", "b"], "left").fillna(0.0, ["xy", "rs"])
    r = lambda x, xy: correlation(n, *[F.col(f"{c}_{s}") for c in (x, x + x) for s in "ab"], F.col(xy))
    return pairs.select(
        "a",
        "b",
        (1 - r("x", "xy")).alias("pearson"),
        (1 - F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx_a") * F.col("xx_b"))), F.lit(0.0))).alias("cosine"),
        (1 - r("r", "rs")).alias("spearman"),
    )


def effect_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, max, min, n): of the finite values of each group."""
    ok = F.when(~F.isnan(value) & F.col(value).isNotNull() & (F.abs(value) != float("inf")), F.col(value))
    return df.groupBy(group).agg(F.avg(ok).alias("mean"), F.max(ok).alias("max"), F.min(ok).alias("min"), F.count(ok).alias("n"))


def elbow(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, elbow): the place farthest from the chord of a falling curve, per group.

    Curves are (group, order, value) with order from 1; the first farthest place wins."""
    w = Window.partitionBy(group)
    x1, xn = F.min(order).over(w), F.max(order).over(w)
    y1, yn = F.max_by(value, -F.col(order)).over(w), F.max_by(value, F.col(order)).over(w)
    away = F.abs((yn - y1) * F.col(order) - (xn - x1) * F.col(value) + xn * y1 - yn * x1)
    return df.withColumn("_d", F.round(away, 9)).groupBy(group).agg(F.max(F.struct("_d", (-F.col(order)).alias("o"))).alias("b")).select(
        group, (-F.col("b.o")).alias("elbow")
    )
