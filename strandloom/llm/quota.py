"""A sample that matches target category shares.

Method: calibration. The rows are aggregated to cells (one per combination of category
values), and Newton iterations on the dual of exponential tilting give every cell an
inclusion probability such that the expected counts of all categories meet their quotas;
cells whose probability reaches one are fixed there, as are all cells of a category of
which fewer rows exist than its quota. The sample is drawn with these probabilities by the pivotal method,
which keeps the size of every cell within one row of its expectation, and the rows of
categories that fall short of their quota are reported.

The cells are bounded by the targets (a category without a target counts as "other"), so
the dual is solved on the driver from the cell counts alone. The pivotal method runs in
bounded salted groups of a cell; each leaves at most one undecided row, and those meet in
a second round.

Input conventions: of repeated keys the latest row counts; categories are trimmed and in
lower case; a row with a null category counts for no target of that dimension, but for n; a
row with a null key is left out; a target that no row meets is reported with 0 available;
an empty table gives an empty sample; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.genesets import latest
from strandloom.runtime import materialize

#: Rows of one salted group of the pivotal method.
GROUP_ROWS = 100_000
OTHER = "\u0001other"

REPORT_SCHEMA = (
    "dimension string, category string, target_share double, quota bigint, available bigint, "
    "sampled bigint, gap bigint, reachable boolean, against array<string>"
)


@dataclass
class Target:
    dimension: str
    category: str
    share: float
    quota: int
    available: int


def quota_of(share: float, min_rows: int, fraction: float, n: int) -> int:
    size = math.floor(round(fraction * n, 6))
    return max(int(min_rows), math.ceil(round(share * size, 6)))


def calibrate(
    cells: list[tuple],
    counts: np.ndarray,
    member: np.ndarray,
    goals: np.ndarray,
    floors: np.ndarray,
    slack: np.ndarray,
    size: float,
    rounds: int = 60,
    whole: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Inclusion probability of each cell, and the multiplier of each goal (above 0 where the
    goal raises its cells, below where it lowers them). Cells of ``whole`` are taken entirely.

    ``member[k, c]``: cell c counts for goal k. The tilted probabilities start from the
    even one (size / n); Newton steps on the dual with a small ridge, which settles goals
    that contradict each other (those with more ``slack`` give way first), and a step
    length that never worsens the dual. At the end the cells of a goal whose expected rows
    stay under its floor are raised together to reach it.
    """
    n = counts.sum()
    if not n or not len(goals):
        return np.full(len(cells), min(1.0, size / n) if n else 0.0), np.zeros(len(goals))
    base = np.full(len(cells), min(1.0, size / n))
    fixed = np.zeros(len(cells), bool) if whole is None else whole.copy()
    pi = np.where(fixed, 1.0, base)
    dual = np.zeros(len(goals))
    for _ in range(len(cells) + 1):
        free = ~fixed
        m = member[:, free]
        weight = counts[free] * base[free]
        goal = goals - member[:, fixed] @ counts[fixed]
        ridge = 1e-3 * max(1.0, size) / 50 * slack
        dual = np.zeros(len(goals))

        def value(d: np.ndarray) -> float:
            return float((weight * np.exp(np.clip(d @ m, -30, 30))).sum() - d @ goal + (ridge * d * d).sum() / 2)

        for _ in range(rounds):
            w = weight * np.exp(np.clip(dual @ m, -30, 30))
            slope = m @ w - goal + ridge * dual
            if np.abs(slope).max() < 1e-6 * max(1.0, size):
                break
            step = np.linalg.solve((m * w) @ m.T + np.diag(ridge), slope)
            length = 1.0
            while length > 1e-6 and value(dual - length * step) > value(dual) - 1e-4 * length * float(slope @ step):
                length /= 2
            dual = dual - length * step
        pi[free] = base[free] * np.exp(np.clip(dual @ m, -30, 30))
        over = free & (pi > 1)
        if not over.any():
            break
        fixed |= over
        pi[over] = 1.0
    pi = np.clip(pi, 0.0, 1.0)
    for k in np.argsort(-member.sum(axis=1), kind="stable"):
        inside = member[k] > 0
        held, room = (counts * pi)[inside].sum(), (counts * (1 - pi))[inside].sum()
        if floors[k] > held and room > 0:
            pi[inside] += (1 - pi[inside]) * min(1.0, (floors[k] - held) / room)
    return pi, dual


def _uniform(h: int) -> float:
    """A number in [0, 1) from a row's hash: the draw of a row is the same in every run."""
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return ((h ^ (h >> 33)) & 0x1FFFFFFFFFFFFF) / (1 << 53)


def pivotal(probabilities: list[float], hashes: list[int]) -> tuple[list[int], int, float]:
    """The pivotal method in the order given: positions chosen, and the position and
    probability of the row left undecided (-1 if none)."""
    chosen: list[int] = []
    held, p = -1, 0.0
    eps = 1e-9
    for k, q in enumerate(probabilities):
        if q <= eps:
            continue
        if q >= 1 - eps:
            chosen.append(k)
            continue
        if held < 0:
            held, p = k, q
            continue
        u = _uniform(hashes[k] ^ (hashes[held] * 3 & 0xFFFFFFFFFFFFFFFF))
        total = p + q
        if total < 1 - eps:  # one of the two drops out
            if u * total >= p:
                held = k
            p = total
        else:  # one of the two is chosen, the other keeps what is left
            if u * (2 - total) < 1 - q:
                chosen.append(held)
                held = k
            else:
                chosen.append(k)
            p = total - 1
            if p <= eps:
                held = -1
            elif p >= 1 - eps:
                chosen.append(held)
                held = -1
    return chosen, held, p


SAMPLE_SCHEMA = "key string, cell int, h bigint, p double, chosen boolean"


def _rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pivotal rounds over rows sorted by (cell, salt, h); one group at a time is held."""
    pending: list[pd.DataFrame] = []

    def settle(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        chosen, held, p = pivotal(pdf["p"].tolist(), [int(x) & 0xFFFFFFFFFFFFFFFF for x in pdf["h"].tolist()])
        out = pdf.iloc[chosen + ([held] if held >= 0 else [])][["key", "cell", "h"]].copy()
        out["p"] = [1.0] * len(chosen) + ([p] if held >= 0 else [])
        out["chosen"] = [True] * len(chosen) + ([False] if held >= 0 else [])
        return out

    now = None
    for pdf in batches:
        for group, part in pdf.groupby(["cell", "salt"], sort=False):
            if group != now and pending:
                yield settle(pending)
                pending = []
            now = group
            pending.append(part)
    if pending:
        yield settle(pending)


def _last_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        pdf = pd.concat(parts, ignore_index=True).sort_values(["cell", "h", "key"], ignore_index=True)
        chosen, held, p = pivotal(pdf["p"].tolist(), [int(x) & 0xFFFFFFFFFFFFFFFF for x in pdf["h"].tolist()])
        if held >= 0 and _uniform(int(pdf["h"][held]) & 0xFFFFFFFFFFFFFFFF) < p:
            chosen.append(held)
        out = pdf.iloc[chosen][["key", "cell", "h"]].copy()
        out["p"], out["chosen"] = 1.0, True
        yield out


class QuotaSample:
    """The sample of ``rows`` (key, updated, one column per dimension) for ``targets``."""

    def __init__(self, rows: DataFrame, key: str, at: str, dimensions: list[str], targets: DataFrame, seed: int = 7) -> None:
        spark = rows.sparkSession
        wanted = targets.collect()  # the table of targets is fixed in size
        values = {d: sorted({t["category"] for t in wanted if t["dimension"] == d} | {
            part
            for t in wanted
            if "|" in t["dimension"] and d in t["dimension"].split("|")
            for part in [t["category"].split("|")[t["dimension"].split("|").index(d)]]
        }) for d in dimensions}
        clean = latest(
            rows, key, at, [F.lower(F.trim(d)).alias(d) for d in dimensions]
        )
        code = F.lit(0)
        for d in dimensions:
            place = F.array_position(F.array(*[F.lit(v) for v in values[d]]), F.coalesce(F.col(d), F.lit(OTHER))) if values[d] else F.lit(0)
            code = code * (len(values[d]) + 1) + F.coalesce(place, F.lit(0)).cast("int")
        self.rows = materialize(clean.select(F.col(key).alias("key"), code.cast("int").alias("cell")), "quota")
        combos = list(itertools.product(*[[OTHER, *values[d]] for d in dimensions]))
        counted = {r["cell"]: r["n"] for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        counts = np.array([counted.get(c, 0) for c in range(len(combos))], float)
        n = int(counts.sum())
        self.targets: list[Target] = []
        member = []
        for t in wanted:
            dims, cats = t["dimension"].split("|"), t["category"].split("|")
            inside = np.array([
                all(d in dimensions and combo[dimensions.index(d)] == c for d, c in zip(dims, cats)) for combo in combos
            ])
            quota = quota_of(t["target_share"], t["min_rows"], t["sample_fraction"], n)
            member.append(inside)
            self.targets.append(Target(t["dimension"], t["category"], t["target_share"], quota, int(counts[inside].sum())))
        self.member = np.array(member, float).reshape(len(wanted), len(combos))
        goals = np.array([min(t.quota, t.available) for t in self.targets], float)
        size = max([math.floor(round(t["sample_fraction"] * n, 6)) for t in wanted], default=0)
        # One row above the floor: rounding inside a cell may take one away per cell.
        floors = np.array([min(t["min_rows"] + self.member[k].sum(), goals[k]) for k, t in enumerate(wanted)])
        slack = np.array([1.0 if "|" not in t.dimension else 20.0 for t in self.targets])
        short = np.array([t.available < t.quota for t in self.targets], bool)
        whole = (self.member[short] > 0).any(axis=0) if short.any() else np.zeros(len(combos), bool)
        self.probabilities, self.multipliers = calibrate(combos, counts, self.member, goals, floors, slack, size, whole=whole)
        self.seed = seed
        self.spark = spark
        self.counts = counts
        self._drawn: DataFrame | None = None

    def sample(self) -> DataFrame:
        """(key, cell) of the rows drawn."""
        if self._drawn is None:
            table = self.spark.createDataFrame(
                [(c, float(p), int(max(1, math.ceil(self.counts[c] / GROUP_ROWS)))) for c, p in enumerate(self.probabilities)],
                "cell int, p double, salts int",
            )
            salted = (
                self.rows.join(F.broadcast(table), "cell")
                .where(F.col("p") > 0)
                .withColumn("h", F.xxhash64("key", F.lit(self.seed)))
                .withColumn("salt", F.pmod("h", F.col("salts")).cast("int"))
            )
            first = materialize(
                salted.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "h", "key").mapInPandas(_rounds, SAMPLE_SCHEMA),
                "pivotal",
            )
            # One undecided row of GROUP_ROWS at most: only these rows go to one task.
            rest = first.where("not chosen").repartition(1).mapInPandas(_last_round, SAMPLE_SCHEMA)
            self._drawn = materialize(first.where("chosen").unionByName(rest).select("key", "cell"), "sample")
        return self._drawn

    def report(self) -> DataFrame:
        """One row per target; ``reachable`` is false where too few rows exist, and then all of
        them are in the sample. ``against`` names, for a target that could be met alone but has a
        gap, the targets it contradicts: those of common rows whose multiplier pulls the other way."""
        drawn = {r["cell"]: r["n"] for r in self.sample().groupBy("cell").agg(F.count("*").alias("n")).collect()}
        taken = self.member @ np.array([drawn.get(c, 0) for c in range(self.member.shape[1])], float)
        names = [f"{t.dimension}={t.category}" for t in self.targets]
        out = []
        for at, (t, k) in enumerate(zip(self.targets, taken)):
            gap, reachable, against = max(0, t.quota - int(k)), t.available >= t.quota, []
            if gap and reachable:
                common = (self.member * self.member[at] * self.counts).sum(axis=1) > 0
                against = [names[j] for j in np.flatnonzero(common & (self.multipliers * self.multipliers[at] < 0)) if j != at]
            out.append((t.dimension, t.category, float(t.share), t.quota, t.available, int(k), gap, reachable, against))
        return self.spark.createDataFrame(out, REPORT_SCHEMA)
