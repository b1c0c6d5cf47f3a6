"""Mixing sources to target weights.

Method: a time-varying curriculum. Every source has a weight schedule over training time
t in [0, 1] whose mean is its share: share * (1 + tilt * (2 t - 1)). Its integral is the
cumulative token demand share * (t + tilt * (t^2 - t)); inverting it gives the time at
which a document's tokens are due, and documents are range-sorted by that time. A source
that is too small is repeated, up to ``max_repeats`` times; what is still missing is
reported. Sizes are tokens of a public tokenizer, whose file is a parameter.

Running token sums never gather a source in one task: documents are hashed into buckets of
bounded size, bucket sums give each bucket's offset, and only buckets are scanned in order.

Input conventions: sources are trimmed and in lower case; a null or blank source is no
source and its tokens do not count; a null text has no tokens and stays out of the mix; of
repeated doc_ids the latest row counts; a target without documents is reported with size 0;
an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import materialize

#: Rank file of a public byte-level tokenizer, and the public pattern that splits text before its merges (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Documents of one bucket of the running sum, about.
BUCKET_ROWS = 20_000
#: Texts are handed to the tokenizer in pieces of at least this many characters, cut only
#: where the pattern must end a token: at a single space between two marks that are none.
PIECE = 100_000
CUT = re.compile(r"(?<=\S) (?=\S)")


def token_counter(path: str):
    """Arrow-batched function from texts to numbers of tokens."""

    def load():
        import base64

        import tiktoken

        with open(path, "rb") as ranks:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks if line.strip())}
        return tiktoken.Encoding("loom", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def pieces(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = CUT.search(text, at + PIECE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load()
        for texts in batches:
            yield pd.Series(
                [0 if t is None else sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) for t in texts], dtype="int64"
            )

    return count


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of all documents with a source, one row per doc_id."""
    sized = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id",
        F.col("ingested_at").alias("at"),
        F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"),
        token_counter(tokenizer)(F.col("text")).alias("tokens"),
    )
    one = sized.groupBy("doc_id").agg(F.max(F.struct("at", "source", "tokens")).alias("r"))
    return one.select("doc_id", "r.source", "r.tokens").where(F.col("source") != "")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, size, total, wanted, taken, share, met): one row per target.

    ``taken`` tokens come from the source: its wanted share of the total, or all it can give.
    """
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
    total = per_source.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    rows = (
        F.broadcast(targets)  # fixed in size: one row per source to mix
        .join(per_source, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "source",
            "target_weight",
            "max_repeats",
            F.coalesce("size", F.lit(0)).alias("size"),
            "total",
            (F.col("target_weight") * F.col("total")).alias("wanted"),
        )
        .withColumn("most", F.col("max_repeats") * F.col("size"))
        .withColumn("taken", F.least(F.col("wanted"), F.col("most").cast("double")))
        .withColumn("met", F.col("most") >= F.col("wanted"))
    )
    mixed = rows.agg(F.sum("taken").alias("mixed"))
    return rows.crossJoin(F.broadcast(mixed)).select(
        "source", "target_weight", "max_repeats", "size", "total", "wanted", "taken",
        F.try_divide("taken", "mixed").alias("share"), "met",
    )


def with_tilts(plan_rows: DataFrame, tilts: dict[str, float] | None) -> DataFrame:
    """The plan with the slope of each source's schedule; by default light sources come
    early and heavy ones late, in even steps from -0.5 to 0.5."""
    if tilts is not None:
        pairs = [F.lit(x) for kv in tilts.items() for x in kv]
        slope = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
        return plan_rows.withColumn("tilt", slope.cast("double"))
    order = Window.partitionBy(F.lit(1)).orderBy("target_weight", "source")  # one row per target
    return plan_rows.withColumn("tilt", F.percent_rank().over(order) - 0.5)


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, size, wanted, taken, n_rows, share, met): what the
    emitted rows of :func:`mixture` give, one row per target. ``taken`` are their tokens and
    ``share`` their part of the whole mix; where sources fall short, the others' shares exceed
    their weights."""
    sizes = materialize(sizes, "sizes")
    emitted = placed(sizes, targets).groupBy("source").agg(F.sum("tokens").alias("taken"), F.count("*").alias("n_rows"))
    emitted = materialize(emitted, "emitted")  # one row per target
    whole = emitted.agg(F.sum("taken").alias("whole"))
    return (
        plan(sizes, targets).drop("taken", "share", "total").join(F.broadcast(emitted), "source", "left").crossJoin(F.broadcast(whole))
        .select(
            "source", "target_weight", "max_repeats", "size", "wanted", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
            F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce(F.try_divide("taken", "whole"), F.lit(0.0)).alias("share"), "met",
        )
    )


def mixture(sizes: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """The rows of :func:`placed` in training order."""
    return placed(sizes, targets, tilts, seed).orderBy("position", "source", "doc_id", "repeat_no")


def placed(sizes: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, repeat_no, tokens, position): every document as often as it is used.

    Position is the training time in [0, 1] at which the document is due.
    """
    sizes = materialize(sizes, "sizes")
    planned = with_tilts(plan(sizes, targets), tilts).where(F.col("taken") > 0)
    planned = F.broadcast(materialize(planned.select("source", "size", "taken", "tilt"), "plan"))
    rows = sizes.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    placed = (
        sizes.join(planned, "source")
        .withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    )
    # Sums per (source, bucket): at most targets * buckets rows, each standing for BUCKET_ROWS documents.
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, ["source", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inside"))
    )
    # A document is used in every pass over its source that starts it before `taken` is reached.
    passes = F.ceil((F.col("taken") - F.col("start")) / F.col("size")).cast("int")
    repeated = started.where(F.col("start") < F.col("taken")).select(
        "doc_id", "source", "tokens", "size", "taken", "tilt", "start",
        F.explode(F.sequence(F.lit(0), passes - 1)).alias("repeat_no"),
    )
    u = (F.col("start") + F.col("repeat_no") * F.col("size")) / F.col("taken")
    b = 1 - F.col("tilt")
    time = F.when(F.abs("tilt") < 1e-9, u).otherwise((F.sqrt(b * b + 4 * F.col("tilt") * u) - b) / (2 * F.col("tilt")))
    return repeated.select("doc_id", "source", "repeat_no", "tokens", (time + 0.0).alias("position"))
