"""Checks, counts and joins over records of a run: filters, leaks of fields, agreement, gates.

Functions that promise a whole match raise :class:`NoMatch` and name how many rows have none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalar import safe_divide, stable_key


class NoMatch(ValueError):
    """Rows that had to match do not, or a key is not unique."""


def record_filter(df: DataFrame, equal: dict[str, list[str]] | None = None, contains: dict[str, str] | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """Rows whose columns are among the given values, hold a text (ignoring case), or lie
    within bounds; a null column meets no condition."""
    for column, values in (equal or {}).items():
        df = df.where(F.col(column).isin(*values))
    for column, text in (contains or {}).items():
        df = df.where(F.lower(column).contains(text.lower()))
    for column, bound in (least or {}).items():
        df = df.where(F.col(column) >= bound)
    for column, bound in (most or {}).items():
        df = df.where(F.col(column) <= bound)
    return df


def blocked_paths(df: DataFrame, key: str, text: str, blocked: list[str]) -> DataFrame:
    """(key, path): where a JSON text has fields of forbidden names, at any depth; list places
    are numbered from 0. Null and unreadable texts have none."""
    kind = dict(df.dtypes)[key]
    names = frozenset(blocked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, source in zip(pdf["k"], pdf["t"]):
                try:
                    todo = [("", json.loads(source))] if source is not None else []
                except ValueError:
                    continue
                while todo:
                    path, value = todo.pop()
                    if isinstance(value, dict):
                        for name, inner in value.items():
                            below = f"{path}.{name}" if path else name
                            if name in names:
                                out.append((k, below))
                            todo.append((below, inner))
                    elif isinstance(value, list):
                        todo += [(f"{path}[{n}]", inner) for n, inner in enumerate(value)]
            yield pd.DataFrame(out, columns=["k", "path"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, path string").withColumnRenamed("k", key)


def excluded(train: DataFrame, listed: DataFrame, key: str, same: list[str]) -> DataFrame:
    """``train`` without the listed keys. A listed key that train does not have, or whose
    columns ``same`` differ there, is an error."""
    names = [F.col(c).alias(f"_{c}") for c in same]
    held = listed.select(key, *names).join(train.select(key, *same), key, "left")
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = held.join(train.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").where(F.col("_in").isNull() | changed).count()
    if wrong:
        raise NoMatch(f"{wrong} listed rows are absent from train or differ there")
    return train.join(listed.select(key).distinct(), key, "left_anti")


def whole_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables with the same unique keys; a repeated or unmatched key is an error."""
    sides = left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    bad = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 1 or b <> 1").count()
    if bad:
        raise NoMatch(f"{bad} keys are repeated or stand in one table only")
    return left.join(right, key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sorted distinct keys of ``left`` that ``right`` does not have."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti").orderBy(key)


def expanded(prototypes: DataFrame, records: DataFrame, key: str, modes: list[str], out: str) -> DataFrame:
    """Prototypes with their record (a null key stays, without one), once for each mode."""
    return prototypes.join(records, key, "left").withColumn(out, F.explode(F.array(*map(F.lit, modes))))


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, value, n): how often each value of each column occurs, in one pass; null is a value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("x")).groupBy(F.col("x.counter").alias("counter"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def tie_rate(df: DataFrame, pool: list[str], score: str) -> DataFrame:
    """(pools, tied, rate): pools of more than one row whose best score is shared."""
    best = df.where(F.col(score).isNotNull()).groupBy(*pool, score).agg(F.count("*").alias("_n")).groupBy(*pool).agg(
        F.max(F.struct(F.col(score).alias("s"), F.col("_n").alias("n"))).alias("b"), F.sum("_n").alias("_all")
    ).where("_all > 1")
    return best.agg(F.count("*").alias("pools"), F.count_if(F.col("b.n") > 1).alias("tied")).withColumn("rate", safe_divide(F.col("tied").cast("double"), F.col("pools")))


def spread_of(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, least, mean, greatest) of a value; nulls do not count."""
    return df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))


def findings(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, severity, value, bound, rule): rules that measured values break.

    ``metrics`` has (metric, value), ``rules`` (metric, least, most, severity) with null bounds
    open; a metric that was not measured breaks its rule as ``missing``."""
    both = rules.join(metrics, "metric", "left")
    broken = F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("least"), "below").when(F.col("value") > F.col("most"), "above")
    bound = F.when(F.col("rule") == "below", F.col("least")).when(F.col("rule") == "above", F.col("most"))
    return both.withColumn("rule", broken).where(F.col("rule").isNotNull()).select("metric", "severity", "value", bound.alias("bound"), "rule")


def is_high_confidence(confidence: Column) -> Column:
    """A number of 0.75 or more, or one of the words high, strong, certain."""
    number = F.trim(confidence.cast("string")).try_cast("double")
    return F.coalesce(number >= 0.75, F.lower(F.trim(confidence)).isin("high", "strong", "certain"), F.lit(False))


def agreement(labels: DataFrame, packets: DataFrame, branches: DataFrame) -> DataFrame:
    """One row of rates: how often the selected branch, the model's best and one of its best
    two agree with the label, and how often the label's branch scores at least as high as others.

    ``labels`` has (item, chosen, acceptable array, confidence), ``packets`` (item, selected),
    ``branches`` (item, branch_id, score). Labels without a packet or choice do not count.
    """
    usable = labels.where("chosen is not null and chosen <> ''").join(packets, "item")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc_nulls_last("score"), "branch_id"))
    ranked = branches.withColumn("_p", place)
    top = ranked.where("_p <= 2").groupBy("item").agg(F.max(F.when(F.col("_p") == 1, F.col("branch_id"))).alias("first"), F.collect_set("branch_id").alias("two"))
    seen = usable.join(top, "item", "left")
    fine = F.array_union(F.coalesce("acceptable", F.array().cast("array<string>")), F.array("chosen"))
    hit = lambda c: F.coalesce(c, F.lit(False))
    agree, first = hit(F.col("selected") == F.col("chosen")), hit(F.col("first") == F.col("chosen"))
    rates = seen.agg(
        F.count("*").alias("labels"), F.avg(agree.cast("double")).alias("selected_top1"), F.avg(first.cast("double")).alias("model_top1"),
        F.avg(hit(F.arrays_overlap("two", fine)).cast("double")).alias("model_top2"),
        F.count_if(is_high_confidence(F.col("confidence")) & ~(agree & first)).alias("sure_disagreements"),
    )
    own = usable.select("item", "chosen").join(branches.select("item", F.col("branch_id").alias("chosen"), F.col("score").alias("own")), ["item", "chosen"])
    pairs = own.join(branches, "item").where("branch_id <> chosen").agg(
        F.count("*").alias("comparisons"), F.avg((F.coalesce("own", F.lit(0.0)) >= F.coalesce("score", F.lit(0.0))).cast("double")).alias("pairwise")
    )
    return rates.crossJoin(F.broadcast(pairs))  # one row each


def record_scores(rows: DataFrame, fields: dict[str, str], ambiguous: str) -> DataFrame:
    """(record_id, family, valid_json, mapping_exact, exact_record, defer_correct) of generated answers.

    ``rows`` has (record_id, family, expected, predicted), both JSON texts. The family's field
    must be equal in value and type; records are equal if all fields are; answers of the family
    ``ambiguous`` must defer. Nulls and texts that are no object are not valid.
    """
    field = F.lit(None).cast("string")
    for family, name in fields.items():
        field = F.when(F.col("family") == family, F.lit(name)).otherwise(field)

    @F.pandas_udf("valid_json boolean, mapping_exact boolean, exact_record boolean, defer_correct boolean")
    def compare(expected: pd.Series, predicted: pd.Series, name: pd.Series, family: pd.Series) -> pd.DataFrame:
        out = []
        for want, said, key, kind in zip(expected, predicted, name, family):
            wanted = json.loads(want) if want is not None else {}
            try:
                got = json.loads(said) if said is not None else None
            except ValueError:
                got = None
            got = got if isinstance(got, dict) else None
            same = got is not None and type(got.get(key)) is type(wanted.get(key)) and got.get(key) == wanted.get(key)
            defers = got is not None and got.get("action") == "defer" and got.get("status") == "ambiguous"
            out.append((got is not None, same, got == wanted, kind != ambiguous or defers))
        return pd.DataFrame(out, columns=["valid_json", "mapping_exact", "exact_record", "defer_correct"])

    return rows.withColumn("_s", compare("expected", "predicted", field, "family")).select("record_id", "family", "_s.*")


def review_packets(branches: DataFrame, pool: list[str], selected: str, most: int) -> DataFrame:
    """(pool, branch_id, place): the selected branch, then the best others by score, ``most`` in all."""
    order = Window.partitionBy(*pool).orderBy(F.desc(F.coalesce(F.col("branch_id") == F.col(selected), F.lit(False))), F.desc_nulls_last("score"), "branch_id")
    return branches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*pool, "branch_id", "place")


def split_cube(df: DataFrame, split: str, dimensions: list[str]) -> DataFrame:
    """(split, dimension, value, n): counts per split alone and by each dimension, in one pass."""
    cells = [F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    long = df.select(F.col(split).alias("split"), F.explode(F.array(*cells)).alias("x"))
    return long.groupBy("split", F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def epoch_plan(df: DataFrame, key: str, epochs: int, batch: int, most_steps: int | None = None) -> DataFrame:
    """(epoch, position, key, padding, step): the rows in the order they are consumed. Every
    epoch has its own hash order and is padded with its first rows to whole batches; the plan
    ends after ``most_steps`` steps if given.

    Positions come from counts of hash ranges, so no epoch is sorted in one task."""
    n = df.count()
    padded = -(-n // batch) * batch
    each = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    hashed = each.withColumn("h", stable_key(F.col("epoch"), F.col(key))).withColumn("bucket", F.substring("h", 1, 2))
    sizes = hashed.groupBy("epoch", "bucket").agg(F.count("*").alias("m"))  # at most 256 rows an epoch
    before = Window.partitionBy("epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("epoch", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("epoch", "bucket").orderBy("h", key)) - 1
    placed = hashed.withColumn("inside", inside).join(starts, ["epoch", "bucket"]).select("epoch", (F.col("start") + F.col("inside")).alias("position"), key)
    again = placed.where(F.col("position") < padded - n).select("epoch", (F.col("position") + n).alias("position"), key, F.lit(True).alias("padding"))
    plan = placed.withColumn("padding", F.lit(False)).unionByName(again)
    plan = plan.withColumn("step", F.floor((F.col("epoch") * padded + F.col("position")) / batch))
    return plan if most_steps is None else plan.where(F.col("step") < most_steps)


def exposure(plan: DataFrame, key: str) -> DataFrame:
    """(key, uses, first_step, last_step): how often each row was consumed."""
    return plan.groupBy(key).agg(F.count("*").alias("uses"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def worker_ranges(n: Column, workers: int) -> Column:
    """Array of (worker, first, size): contiguous ranges of ``n`` rows; the first n mod workers get one more."""
    base, extra = F.floor(n / workers), n % workers
    return F.transform(
        F.sequence(F.lit(0), F.lit(workers - 1)),
        lambda w: F.struct(w.alias("worker"), (w * base + F.least(w.cast("bigint"), extra)).alias("first"), (base + F.when(w < extra, 1).otherwise(0)).alias("size")),
    )


def load_check(df: DataFrame, texts: list[str], most_chars: int) -> DataFrame:
    """(check, n): rows, blank texts and texts longer than a bound, by column."""
    out = [F.struct(F.lit("rows").alias("check"), F.count("*").alias("n"))]
    for c in texts:
        out.append(F.struct(F.lit(f"{c}_blank").alias("check"), F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias("n")))
        out.append(F.struct(F.lit(f"{c}_long").alias("check"), F.count_if(F.length(c) > most_chars).alias("n")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def public_rows(df: DataFrame, private: list[str]) -> DataFrame:
    """The table without its private columns; one of them also inside a kept struct is an error."""
    kept = df.drop(*private)
    names = set(private)

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            if f.name in names:
                raise NoMatch(f"private field {path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        inner = getattr(kind, "elementType", None)
        if inner is not None:
            walk(inner, path)

    walk(kept.schema, "")
    return kept


def answer_key(df: DataFrame, key: str, private: list[str]) -> DataFrame:
    """The private half of a table, by key."""
    return df.select(key, *private)


def flat_texts(df: DataFrame) -> DataFrame:
    """Every column as text: scalars as they are, nested ones as JSON."""
    nested = ("array", "struct", "map")
    return df.select(*[(F.to_json(c) if t.startswith(nested) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])
