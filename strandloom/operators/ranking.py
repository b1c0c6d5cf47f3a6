"""Ranks, normalisation and ordered choice within groups.

Every function orders by an explicit last key, so ties always have a defined result. Null
values rank last. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(groups: list[str], *order) -> object:
    return Window.partitionBy(*groups).orderBy(*order)


def competition_rank(df: DataFrame, groups: list[str], value: str, ties: str = "min") -> DataFrame:
    """``rank`` 1 for the highest value; tied rows share the smallest or the average rank."""
    first = F.rank().over(_by(groups, F.desc_nulls_last(value)))
    if ties == "average":
        first = first + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2
    return df.withColumn("rank", first)


def min_max(df: DataFrame, groups: list[str], value: str, out: str = "normalized") -> DataFrame:
    """Values scaled to [0, 1] within the group; if all are equal 1.0 for a single row, else 0.5."""
    w = Window.partitionBy(*groups)
    low, high, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    flat = F.when(n == 1, 1.0).otherwise(0.5)
    return df.withColumn(out, F.when(high == low, flat).otherwise((F.col(value) - low) / (high - low)))


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given order, with their ``place``."""
    return df.withColumn("place", F.row_number().over(_by(groups, *order))).where(F.col("place") <= k)


def best_within_margin(df: DataFrame, groups: list[str], value: str, margin: float, order: list[str]) -> DataFrame:
    """Of the rows within ``margin`` of the group's best value the greatest by ``order``."""
    near = df.withColumn("_best", F.max(value).over(Window.partitionBy(*groups))).where(F.col(value) >= F.col("_best") - margin)
    whole = F.max_by(F.struct(*[c for c in df.columns if c not in groups]), F.struct(*order))
    return near.groupBy(*groups).agg(whole.alias("_r")).select(*groups, "_r.*")


def difficulty_picks(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The first, middle and last row of each group as easy, medium and hard; one row is
    picked once, under its first name."""
    w = _by(groups, *order)
    n = F.count("*").over(Window.partitionBy(*groups))
    at = F.row_number().over(w) - 1
    name = F.when(at == 0, "easy").when(at == F.floor(n / 2), "medium").when(at == n - 1, "hard")
    return df.withColumn("difficulty", name).where(F.col("difficulty").isNotNull())


def rank_difficulty(df: DataFrame, groups: list[str], order: list[Column], single: Column) -> DataFrame:
    """First easy, last hard, others medium; a group of one takes ``single``."""
    n = F.count("*").over(Window.partitionBy(*groups))
    at = F.row_number().over(_by(groups, *order))
    return df.withColumn("difficulty", F.when(n == 1, single).when(at == 1, "easy").when(at == n, "hard").otherwise("medium"))


def round_robin(df: DataFrame, buckets: list[str], order: list[Column], priority: Column | None = None, n: int | None = None) -> DataFrame:
    """Rows in passes over the buckets: ``turn`` counts a bucket's rows, and the result is
    ordered by turn, then by the bucket's ``priority`` (smallest first) if given, then bucket;
    it ends after ``n`` rows if given."""
    turned = df.withColumn("turn", F.row_number().over(_by(buckets, *order)))
    rows = turned.orderBy("turn", *([priority] if priority is not None else []), *buckets)
    return rows if n is None else rows.limit(n)


def stratified_split(df: DataFrame, strata: list[str], order: list[Column], share: float = 0.1) -> DataFrame:
    """``split`` (train, val, test) by position in the stratum: val and test have ``share`` of
    it each, rounded half to even, train has the rest and comes first. If nothing would be left
    for train, test and then val give up a row."""
    n = F.count("*").over(Window.partitionBy(*strata))
    at = F.row_number().over(_by(strata, *order)) - 1
    wanted = F.bround(n * share)
    lack = F.greatest(1 - (n - 2 * wanted), F.lit(0))
    test = F.greatest(wanted - lack, F.lit(0))
    val = F.greatest(wanted - F.greatest(lack - wanted, F.lit(0)), F.lit(0))
    train = n - val - test
    return df.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))


def split_by_position(df: DataFrame, strata: list[str], order: list[Column], shares: list[tuple[str, float]]) -> DataFrame:
    """``split`` from the position in the stratum: contiguous pieces of the given shares, the
    last split taking what rounding leaves."""
    at = F.row_number().over(_by(strata, *order)) - 1
    n = F.count("*").over(Window.partitionBy(*strata))
    name, edge = F.lit(shares[-1][0]), 0.0
    cuts = []
    for label, share in shares[:-1]:
        edge += share
        cuts.append((F.bround(n * edge), label))
    for cut, label in reversed(cuts):
        name = F.when(at < cut, label).otherwise(name)
    return df.withColumn("split", name)


def cyclic(df: DataFrame, groups: list[str], order: list[Column], names: list[str], out: str) -> DataFrame:
    """Names dealt in turn by position within the group."""
    at = (F.row_number().over(_by(groups, *order)) - 1) % len(names)
    return df.withColumn(out, F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")))


def position_percentile(df: DataFrame, groups: list[str], order: list[Column], out: str = "percentile") -> DataFrame:
    """Position over n - 1; 1.0 in a group of one."""
    n = F.count("*").over(Window.partitionBy(*groups))
    at = F.row_number().over(_by(groups, *order)) - 1
    return df.withColumn(out, F.when(n == 1, 1.0).otherwise(at / (n - 1)))


def median_by_place(df: DataFrame, sets: list[str], group: str, value: str) -> DataFrame:
    """(group, place, median): each set's values sorted, then the median over sets of a group at each place."""
    place = F.row_number().over(_by([group, *sets], value))
    return df.withColumn("place", place).groupBy(group, "place").agg(F.median(value).alias("median"))


def keep_fraction(df: DataFrame, groups: list[str], order: list[Column], fraction: float) -> DataFrame:
    """The first floor(n * fraction) rows of each group."""
    n = F.count("*").over(Window.partitionBy(*groups))
    return df.withColumn("place", F.row_number().over(_by(groups, *order))).withColumn("_n", n).where(
        F.col("place") <= F.floor(F.col("_n") * fraction)
    ).drop("_n")


def padded_epoch(df: DataFrame, order: list[Column], replicas: int) -> DataFrame:
    """(.., position, padding): rows in order, the first ones repeated until the number of
    rows divides evenly among ``replicas``."""
    n = df.count()
    missing = (-n) % replicas if n else 0
    placed = df.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)
    again = placed.where(F.col("position") < missing).withColumn("position", F.col("position") + n).withColumn("padding", F.lit(True))
    return placed.withColumn("padding", F.lit(False)).unionByName(again)
