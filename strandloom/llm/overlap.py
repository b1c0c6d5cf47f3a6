"""Same or near-same records across splits.

Method: the evaluation records become texts (their set items as symbols in one fixed
order) in bounded shards, each with a full-text index (suffix array and Burrows-Wheeler
transform with rank by binary search). Training records are streamed through backward
search; runs found in an evaluation record are merged into maximal spans, their symbols
counted, and the pairs whose exact Jaccard similarity reaches the threshold are kept.

No qualifying pair is lost: with at least o shared and at most u unshared symbols the
longest common run has ceil(o / (u + 1)) symbols or more, which is the run length searched
for; and each pair shares a symbol in the first n - ceil(t n) + 1 symbols of both records
(prefix filter), by which both sides are routed to shards. A shard that would exceed its
bound is split: the evaluation side into sub-shards, the training side into chunks, every
chunk meeting every sub-shard. Exact copies are matched by class and never enter the index.

Input conventions: a null or empty set matches nothing, a null id neither; a null or
unknown split is neither training nor evaluation; repeats of a record count once (the
latest row); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import genesets as gs
from strandloom.runtime import materialize, shuffle_width

#: Symbols of one shard of the evaluation index, and of one chunk of training text.
SHARD_SYMBOLS = 400_000
CHUNK_SYMBOLS = 800_000

#: Spellings of the splits (fixed values).
SPLITS = {"train": "train", "val": "val", "validation": "val", "test": "test"}


def clean_records(records: DataFrame) -> DataFrame:
    """(record_no, split, source, idkey, items, cls), one row per record_no."""
    split = F.lower(F.trim("split"))
    mapped = F.coalesce(*[F.when(split == k, F.lit(v)) for k, v in SPLITS.items()])
    ident = F.regexp_replace(F.lower(F.regexp_replace("complex_record_id", r"^\s+|\s+$", "")), r"(?<![0-9])0+(?=[0-9])", "")
    rows = gs.latest(
        records,
        "record_no",
        "updated_at",
        [
            mapped.alias("split"),
            F.lower(F.trim("source")).alias("source"),
            F.when(ident != "", ident).alias("idkey"),
            gs.clean_set(F.col("gene_ids")).alias("items"),
        ],
    )
    return rows.withColumn("cls", F.when(F.size("items") > 0, gs.set_class(F.col("items"))))


def run_length(size: int, threshold: float) -> int:
    """The run of symbols that a record of ``size`` symbols shares with every partner."""
    least = size
    for other in range(math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9) + 1):
        shared = math.ceil(threshold / (1 + threshold) * (size + other) - 1e-9)
        if shared <= min(size, other):
            least = min(least, math.ceil(shared / (size + other - 2 * shared + 1)))
    return max(1, least)


class TextIndex:
    """Full-text index of integer texts; symbol 0 separates them."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.alphabet = np.unique(np.concatenate(texts))
        starts = np.cumsum(sizes + 1) - sizes
        self.length = int(sizes.sum() + len(texts) + 1)
        body = np.zeros(self.length, np.int64)
        self.owner = np.full(self.length, -1, np.int64)
        self.offset = np.zeros(self.length, np.int64)
        where = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        body[where] = np.searchsorted(self.alphabet, np.concatenate(texts)) + 1
        self.owner[where] = np.repeat(np.arange(len(texts)), sizes)
        self.offset[where] = where - np.repeat(starts, sizes)
        self.suffixes = self._suffix_array(body, int(sizes.max()))
        last = body[self.suffixes - 1]  # the Burrows-Wheeler transform
        # (symbol, row) in order: one binary search gives C[symbol] + rank(symbol, row).
        self.rank_keys = np.sort(last * (self.length + 1) + np.arange(self.length))

    @staticmethod
    def _suffix_array(body: np.ndarray, longest: int) -> np.ndarray:
        n = len(body)
        rank = np.unique(body, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank, kind="stable")
        width = 1
        while width <= longest:  # suffixes that agree up to a separator need no order
            second = np.full(n, 0, np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, (ordered[1:] != ordered[:-1]).astype(np.int64)])
            width *= 2
        return order

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Symbols of the index, -1 where a value is not in it."""
        at = np.searchsorted(self.alphabet, values)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == values, at + 1, -1)

    def step(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """One step of backward search for many suffix rows at once."""
        return np.searchsorted(self.rank_keys, code * (self.length + 1) + row)


def _search(evals: pd.DataFrame, trains: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of one shard and one chunk."""
    index = TextIndex([np.asarray(s, np.int64) for s in evals["syms"]])
    eval_sizes = np.array([len(s) for s in evals["syms"]], np.int64)
    eval_cls = evals["cls"].to_numpy()
    held_keys = np.sort(np.repeat(np.arange(len(evals)), eval_sizes) * (len(index.alphabet) + 1) + index.codes(np.concatenate([np.asarray(s, np.int64) for s in evals["syms"]])))
    train_cls = trains["cls"].to_numpy()
    lists = [np.asarray(s, np.int64) for s in trains["syms"]]
    sizes = np.array([len(s) for s in lists], np.int64)
    need = {int(n): run_length(int(n), threshold) for n in np.unique(sizes)}
    needs = np.array([need[int(n)] for n in sizes], np.int64)
    step = max(1, int(100_000 // max(1.0, sizes.mean())))
    for lo in range(0, len(lists), step):
        hi = min(len(lists), lo + step)
        size, want = sizes[lo:hi], needs[lo:hi]
        code = index.codes(np.concatenate(lists[lo:hi]))
        owner = np.repeat(np.arange(lo, hi), size)
        first = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(code))
        length = np.repeat(want, size)
        # All runs of the needed length, by their last symbol, extended to the left.
        live = np.flatnonzero((code > 0) & (place - first + 1 >= length))
        top = np.zeros(len(live), np.int64)
        end = np.full(len(live), index.length, np.int64)
        done = np.zeros(len(live), np.int64)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            symbol = code[live - done]
            ok = symbol > 0
            live, top, end, done, symbol = live[ok], top[ok], end[ok], done[ok], symbol[ok]
            top, end = index.step(symbol, top), index.step(symbol, end)
            done = done + 1
            ok = end > top
            live, top, end, done = live[ok], top[ok], end[ok], done[ok]
            full = done >= length[live]
            if full.any():
                hits.append((live[full], top[full], end[full]))
                live, top, end, done = live[~full], top[~full], end[~full], done[~full]
        if not hits:
            continue
        last = np.concatenate([h[0] for h in hits])
        top = np.concatenate([h[1] for h in hits])
        count = np.concatenate([h[2] for h in hits]) - top
        # Locate the occurrences in slices, so that frequent runs never fill the memory.
        bounds = np.r_[0, np.cumsum(count)]
        at = 0
        found = []
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2_000_000, side="right")) - 1)
            n = count[at:to]
            rows = np.repeat(top[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            spot = index.suffixes[rows]
            which = np.repeat(last[at:to], n)
            e, t = index.owner[spot], owner[which]
            ok = (eval_sizes[e] >= threshold * sizes[t] - 1e-9) & (sizes[t] >= threshold * eval_sizes[e] - 1e-9)
            e, t, which, spot = e[ok], t[ok], which[ok], spot[ok]
            # Runs on one diagonal of one pair merge into maximal spans.
            diagonal = (which - first[which]) - (index.offset[spot] + length[which] - 1)
            found.append(np.unique(np.stack([t, e, diagonal]), axis=1))
            at = to
        spans = np.unique(np.concatenate(found, axis=1), axis=1)
        pairs, n_spans = np.unique(spans[:2], axis=1, return_counts=True)
        if not pairs.shape[1]:
            continue
        t, e = pairs
        m = sizes[t]
        tokens = np.concatenate([code[first_of : first_of + k] for first_of, k in zip((np.cumsum(size) - size)[t - lo], m)])
        key = np.repeat(e, m) * (len(index.alphabet) + 1) + tokens
        near = np.searchsorted(held_keys, key)
        near[near == len(held_keys)] = 0
        shared = np.add.reduceat(((held_keys[near] == key) & (tokens > 0)).astype(np.int64), np.cumsum(m) - m)
        total = m + eval_sizes[e] - shared
        ok = shared >= threshold * total - 1e-9
        yield pd.DataFrame(
            {
                "cls_a": train_cls[t[ok]],
                "cls_b": eval_cls[e[ok]],
                "shared": shared[ok],
                "spans": n_spans[ok],
                "jaccard": shared[ok] / total[ok],
            }
        )


PAIR_SCHEMA = "cls_a string, cls_b string, shared bigint, spans bigint, jaccard double"


def near_classes(
    sets: DataFrame, threshold: float, shard_symbols: int = SHARD_SYMBOLS, chunk_symbols: int = CHUNK_SYMBOLS
) -> DataFrame:
    """Pairs (training class, evaluation class) of different sets with at least ``threshold``.

    ``sets`` has (cls, items, is_train, is_eval), one row per distinct non-empty set.
    """
    spark = sets.sparkSession
    # Shards by volume: of the symbols of either side each shard holds a fraction of its bound.
    volume = sets.agg(*[F.sum(F.when(F.col(f), F.size("items")).otherwise(0)) for f in ("is_eval", "is_train")]).first()
    n_shards = 4 * max(shuffle_width(spark), math.ceil((volume[0] or 0) / shard_symbols), math.ceil((volume[1] or 0) / chunk_symbols))
    texts = sets.select("cls", gs.symbols(F.col("items")).alias("syms"), "is_train", "is_eval")
    keep = (F.size("syms") - F.ceil(F.lit(threshold) * F.size("syms") - 1e-9) + 1).cast("int")
    routed = materialize(
        texts.select(
            "cls",
            "syms",
            "is_train",
            "is_eval",
            F.explode(F.array_distinct(F.transform(F.slice("syms", 1, keep), lambda x: F.pmod(x, F.lit(n_shards))))).alias("shard"),
        ),
        "routed",
    )
    weight = lambda flag: F.sum(F.when(F.col(flag), F.size("syms") + 1).otherwise(0))
    # At most n_shards rows: small enough to broadcast by construction.
    plan = F.broadcast(
        routed.groupBy("shard")
        .agg(weight("is_eval").alias("e"), weight("is_train").alias("t"))
        .where((F.col("e") > 0) & (F.col("t") > 0))
        .select(
            "shard",
            F.ceil(F.col("e") / shard_symbols).cast("int").alias("subs"),
            F.ceil(F.col("t") / chunk_symbols).cast("int").alias("chunks"),
        )
    )
    placed = routed.join(plan, "shard")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    evals = placed.where("is_eval").select("shard", own("subs").alias("sub"), every("chunks").alias("chunk"), "cls", "syms")
    trains = placed.where("is_train").select("shard", every("subs").alias("sub"), own("chunks").alias("chunk"), "cls", "syms")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["cls_a", "cls_b", "shared", "spans", "jaccard"])
        out = list(_search(left, right, threshold))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["cls_a", "cls_b", "shared", "spans", "jaccard"])

    keys = ["shard", "sub", "chunk"]
    evals = evals.toDF(*keys, "cls", "syms")  # new attributes: both sides stem from one table
    trains = trains.toDF("t_shard", "t_sub", "t_chunk", "cls", "syms")
    pairs = evals.groupBy(*keys).cogroup(trains.groupBy("t_shard", "t_sub", "t_chunk")).applyInPandas(match, PAIR_SCHEMA)
    return pairs.where(F.col("cls_a") != F.col("cls_b")).dropDuplicates(["cls_a", "cls_b"])


def cross_split_overlaps(records: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(train_no, eval_no, by_id, jaccard) for all pairs of a training and an evaluation
    record with equal ids or similar sets; ``jaccard`` is null where only the ids agree."""
    rows = materialize(clean_records(records).where("split is not null"), "records")
    flagged = rows.select(
        "cls", "items", (F.col("split") == "train").alias("is_train"), (F.col("split") != "train").alias("is_eval")
    )
    sets = materialize(gs.classes(flagged, ["is_train", "is_eval"]), "classes")
    same = sets.where("is_train and is_eval").select(
        F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("jaccard")
    )
    linked = near_classes(sets, threshold).select("cls_a", "cls_b", "jaccard").unionByName(same)
    train = rows.where("split = 'train'")
    held = rows.where("split != 'train'")
    by_set = (
        linked.join(train.select(F.col("cls").alias("cls_a"), F.col("record_no").alias("train_no")), "cls_a")
        .join(held.select(F.col("cls").alias("cls_b"), F.col("record_no").alias("eval_no")), "cls_b")
        .select("train_no", "eval_no", F.lit(False).alias("by_id"), "jaccard")
    )
    by_id = (
        train.where("idkey is not null")
        .select("idkey", F.col("record_no").alias("train_no"))
        .join(held.select("idkey", F.col("record_no").alias("eval_no")), "idkey")
        .select("train_no", "eval_no", F.lit(True).alias("by_id"), F.lit(None).cast("double").alias("jaccard"))
    )
    return (
        by_set.unionByName(by_id)
        .groupBy("train_no", "eval_no")
        .agg(F.max("by_id").alias("by_id"), F.max("jaccard").alias("jaccard"))
    )


def overlap_report(records: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(split, source, n_records, n_leaked, n_pairs) for the evaluation records: how many
    stand in training too. A null source is a group of its own."""
    pairs = cross_split_overlaps(records, threshold).groupBy(F.col("eval_no").alias("record_no")).agg(F.count("*").alias("n"))
    held = clean_records(records).where("split in ('val', 'test')").select("record_no", "split", "source")
    return (
        held.join(pairs, "record_no", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("n_records"),
            F.count("n").alias("n_leaked"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
        )
    )
