"""All similar pairs between set-valued records.

Method: multi-index binary sketches. Every distinct set gets a packed code of minhashes,
:data:`DIGIT` bits of each, which is cut into m segments of k minhashes; each segment is an
index of its own, and sets are joined on (segment number, segment bits). By the pigeonhole
principle a pair whose codes differ in fewer than m minhashes agrees on a segment and cannot
be missed. At the threshold itself a pair differs in more minhashes than any number of
segments long enough to select could cover, so there m is calibrated: it is the number of
segments at which such a pair agrees on one with probability ``recall``; more similar pairs
are found more surely. k follows the number of sets (2 ^ (DIGIT * k) of the order of that
number, so chance matches grow no faster than the table). Several bits of a minhash select
far better than one: unlike sets agree on one bit in half of all cases, on four in a
sixteenth, and like ones nearly as often. Matches outside a Hamming radius of a word of
one-bit minhashes (calibrated to lose one pair in ten thousand) are dropped, the rest are
verified on the original sets.

Segments are joined by one shuffle and one sort, in passes that bound what lies on disk. A
segment value of more than :data:`BLOCK` sets is set aside and joined in blocks of that
size, every block meeting every other, so that no task holds more than two blocks.

Records with equal sets form one class: copies never meet in the join. :func:`similar_pairs`
expands them into record pairs, :func:`similar_records` states one row per record with its
class and number of links.

Input conventions: null or empty sets match nothing; nulls, blanks, repeats and version
suffixes inside a set do not count; repeats of a record count once (the latest row); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import genesets as gs
from strandloom.runtime import materialize, release, task_count

WORD_BITS = 64
#: Bits of each minhash in a segment.
DIGIT = 4
#: Segment rows of one pass, and segments of a pass if there are so many sets that it holds more rows.
PASS_ROWS, PASS_SEGMENTS = 60_000_000, 12
#: Sets of one segment value that one task joins with each other.
BLOCK = 4_096


def segment_plan(n_sets: int, threshold: float, recall: float) -> tuple[int, int]:
    """(minhashes per segment, number of segments)."""
    digits = min(10, max(3, math.ceil(math.log2(max(2, n_sets)) / DIGIT)))
    hit = (threshold + (1 - threshold) / 2**DIGIT) ** digits
    return digits, math.ceil(math.log(1 - recall) / math.log1p(-hit))


def hamming_radius(threshold: float, loss: float = 1e-4) -> int:
    """The smallest radius of one word that a pair at the threshold exceeds with probability ``loss``."""
    p, tail, r = (1 - threshold) / 2, 1.0, -1
    while tail > loss and r < WORD_BITS:
        r += 1
        tail -= math.comb(WORD_BITS, r) * p**r * (1 - p) ** (WORD_BITS - r)
    return r


class Sketcher:
    """Packed codes of sets of mixed 32-bit symbols: bit j is a bit of the smallest of all
    symbols under hash function j. A part of the code, from one bit on, can be made alone."""

    def __init__(self, first_bit: int, n_bits: int, seed: int) -> None:
        # A stream of its own for every word of the code, so that any part of it can be made alone.
        words = range(first_bit // WORD_BITS, -(-(first_bit + n_bits) // WORD_BITS))
        drawn = [np.random.default_rng([seed, w]).integers(1, 2**32, (2, WORD_BITS), dtype=np.uint32) for w in words]
        at = first_bit - words[0] * WORD_BITS
        held = np.concatenate(drawn, axis=1)[:, at : at + n_bits]
        self.mult, self.add = np.ascontiguousarray(held[0] | np.uint32(1)), np.ascontiguousarray(held[1])

    def bits(self, syms: np.ndarray) -> np.ndarray:
        return self.digits(syms, np.zeros(1, np.int64), 1)[0]

    def digits(self, syms: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """(sets, minhashes): ``width`` bits of each minhash of many sets, whose symbols begin at ``starts``."""
        out = np.empty((len(starts), len(self.mult)), np.uint8)
        room = np.empty(len(syms), np.uint32)
        for k, (mult, add) in enumerate(zip(self.mult, self.add)):
            np.multiply(syms, mult, out=room)
            np.add(room, add, out=room)
            least = np.minimum.reduceat(room, starts)
            least ^= least >> np.uint32(15)
            least *= np.uint32(0x2C1B3C6D)
            least ^= least >> np.uint32(12)
            least *= np.uint32(0x297A2D39)
            out[:, k] = least >> np.uint32(32 - width)
        return out


#: Sets that are sketched together; their symbols stay in the processor's cache.
CHUNK = 1_000


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, symbols, starts) of pieces of batches with ``syms``."""
    for whole in batches:
        for lo in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(lo, CHUNK)
            lists = batch.column("syms")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            yield batch, (values ^ values >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes) - sizes


def _codes(seed: int):
    """Arrow function: (cls_no, syms) with a word of one-bit minhashes and the size of each set."""
    word = Sketcher(0, WORD_BITS, seed)
    place = np.uint64(1) << np.arange(WORD_BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, syms, starts in _sketched(batches):
            code = (word.digits(syms, starts, 1).astype(np.uint64) * place).sum(axis=1, dtype=np.uint64)
            sizes = np.diff(np.r_[starts, len(syms)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls_no"), batch.column("syms"), pa.array(code.view(np.int64)), pa.array(sizes)], names=["cls_no", "syms", "code", "n"]
            )

    return run


SEGMENT_SCHEMA = "seg bigint, cls_no bigint, code bigint, n int"


def _segments(digits: int, first: int, segments: int, seed: int):
    """Arrow function: (cls_no, syms, code, n) -> one row (segment value, cls_no, code, size)
    for each of the segments from ``first`` on."""
    own = Sketcher(first * digits, segments * digits, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, syms, starts in _sketched(batches):
            rows = own.digits(syms, starts, DIGIT).reshape(len(starts), segments, digits)
            keys = np.zeros((len(starts), segments), np.uint64)
            for k in range(digits):
                keys = keys << np.uint64(DIGIT) | rows[:, :, k]
            keys = keys * np.uint64(segments) + np.arange(segments, dtype=np.uint64)
            held = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), segments) for c in ("cls_no", "code", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, held)], names=["seg", "cls_no", "code", "n"])

    return run


def close_pairs(i: np.ndarray, j: np.ndarray, cls_no: np.ndarray, code: np.ndarray, n: np.ndarray, threshold: float, radius: int):
    """Of the row pairs (i, j) those of sizes and codes near enough: (smaller class, greater class)."""
    ok = (n[j] >= threshold * n[i] - 1e-9) & (n[i] >= threshold * n[j] - 1e-9)
    i, j = i[ok], j[ok]
    ok = (np.bitwise_count(code[i] ^ code[j]) <= radius) & (cls_no[i] != cls_no[j])
    a, b = cls_no[i[ok]], cls_no[j[ok]]
    return np.minimum(a, b), np.maximum(a, b)


PAIR_SCHEMA = "a bigint, b bigint, seg bigint, code bigint, n int"


def _join(threshold: float, radius: int, block: int):
    """Arrow function over rows sorted by ``seg``: pairs (a, b) within each segment value, and
    the rows of values with more than ``block`` sets as they came, b then null."""

    def as_batch(a, b, seg=None, code=None, n=None) -> pa.RecordBatch:
        none = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), none(b, pa.int64()), none(seg, pa.int64()), none(code, pa.int64()), none(n, pa.int32())], names=["a", "b", "seg", "code", "n"]
        )

    def pairs_of(seg, cls_no, code, n) -> Iterator[pa.RecordBatch]:
        """Of whole segment values of bounded size."""
        wide = code.view(np.uint64)
        at, step, found = np.flatnonzero(seg[1:] == seg[:-1]), 1, []
        while len(at):
            found.append(close_pairs(at, at + step, cls_no, wide, n, threshold, radius))
            step += 1
            at = at[at + step < len(seg)]
            at = at[seg[at + step] == seg[at]]
        if found:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if len(a):
                yield as_batch(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        hot = None  # the segment value whose rows are set aside
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "cls_no", "code", "n")]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            seg = now[0]
            if hot is not None:
                end = int(np.searchsorted(seg, hot, side="right"))
                if end:
                    yield as_batch(now[1][:end], None, seg[:end], now[2][:end], now[3][:end])
                    now = [x[end:] for x in now]
                    seg = now[0]
                held = now
                if not len(seg):
                    continue
                hot = None
            last = int(np.searchsorted(seg, seg[-1], side="left"))
            whole, held = [x[:last] for x in now], [x[last:] for x in now]
            yield from settle(*whole)
            if len(held[0]) > block:
                hot = held[0][0]
                yield as_batch(held[1], None, held[0], held[2], held[3])
                held = [x[:0] for x in held]
        if held is not None and len(held[0]):
            yield from settle(*held)

    def settle(seg, cls_no, code, n) -> Iterator[pa.RecordBatch]:
        if len(seg) < 2:
            return
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, len(seg)])
        big = np.repeat(size > block, size)
        if big.any():
            yield as_batch(cls_no[big], None, seg[big], code[big], n[big])
        few = np.repeat((size > 1) & (size <= block), size)
        yield from pairs_of(seg[few], cls_no[few], code[few], n[few])

    return run


def _block_join(hot: DataFrame, threshold: float, radius: int, block: int) -> DataFrame:
    """Pairs (a, b) of the rows set aside (a, seg, code, n): every row goes to the pairs of
    blocks that its own block is part of, and each pair of blocks is one group."""
    blocks = hot.groupBy("seg").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = hot.join(blocks, "seg").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("own")).alias("low"), F.greatest(x, F.col("own")).alias("high")),
    )
    rows = rows.select("seg", "a", "code", "n", "own", F.explode(met).alias("m")).select("seg", "m.low", "m.high", "a", "code", "n", "own")

    def match(group: pa.Table) -> pa.Table:
        cls_no, own = group.column("a").to_numpy(), group.column("own").to_numpy()
        code, n = group.column("code").to_numpy().view(np.uint64), group.column("n").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, i in enumerate(left):
            j = right[right > i] if low == high else right
            out.append(close_pairs(np.full(len(j), i), j, cls_no, code, n, threshold, radius))
        return pa.table({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})

    return rows.groupBy("seg", "low", "high").applyInArrow(match, "a bigint, b bigint")


def similar_classes(sets: DataFrame, threshold: float, recall: float, seed: int = 20_231, block: int = BLOCK) -> DataFrame:
    """Pairs (cls_a, cls_b, jaccard) of different sets, each once.

    ``sets`` has (cls string, cls_no bigint, items, wanted boolean): one row per distinct
    set; a pair is of use if it is wanted on either side.
    """
    spark = sets.sparkSession
    n = sets.count()
    digits, segments = segment_plan(n, threshold, recall)
    radius = hamming_radius(threshold)
    width = min(segments, max(PASS_SEGMENTS, PASS_ROWS // max(1, n)))
    # Mixed symbols: the multiply-add minhashes need well-spread input.
    mixed = sets.select("cls_no", F.transform("items", lambda x: F.xxhash64(x)).alias("syms"))
    symbols = materialize(mixed.mapInArrow(_codes(seed), "cls_no bigint, syms array<bigint>, code bigint, n int"), "symbols")
    found: list[DataFrame] = []
    for first in range(0, segments, width):
        own = min(width, segments - first)
        joined = materialize(
            symbols.repartition(task_count(spark, n * own, 4_000_000))
            .mapInArrow(_segments(digits, first, own, seed), SEGMENT_SCHEMA)
            .repartition(task_count(spark, n * own, 1_000_000), "seg")
            .sortWithinPartitions("seg")
            .mapInArrow(_join(threshold, radius, block), PAIR_SCHEMA),
            "joined",
        )
        found.append(joined)
    release(symbols)
    joined = found[0]
    for more in found[1:]:
        joined = joined.unionByName(more)
    # Segment values of different passes are told apart by the pass.
    hot = [f.where("b is null").select("a", (F.col("seg") * len(found) + k).alias("seg"), "code", "n") for k, f in enumerate(found)]
    aside = hot[0]
    for more in hot[1:]:
        aside = aside.unionByName(more)
    near = joined.where("b is not null").select("a", "b").unionByName(_block_join(aside, threshold, radius, block)).distinct()
    left = sets.select(F.col("cls_no").alias("a"), F.col("cls").alias("cls_a"), F.col("items").alias("items_a"), F.col("wanted").alias("wanted_a"))
    right = sets.select(F.col("cls_no").alias("b"), F.col("cls").alias("cls_b"), F.col("items").alias("items_b"), F.col("wanted").alias("wanted_b"))
    links = materialize(
        near.join(left, "a")
        .join(right, "b")
        .where(F.col("wanted_a") | F.col("wanted_b"))
        .withColumn("jaccard", gs.jaccard(F.col("items_a"), F.col("items_b")))
        .where(F.col("jaccard") >= threshold - 1e-12)
        .select("cls_a", "cls_b", "jaccard"),
        "links",
    )
    for part in found:
        release(part)
    return links


def members_of(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(set_no, wanted, cls, items): the clean sets of both tables; groups are wanted."""
    of_groups = gs.latest(groups, "group_no", "created_at", [gs.clean_set(F.col("gene_ids")).alias("items")]).select(
        F.col("group_no").alias("set_no"), F.lit(True).alias("wanted"), "items"
    )
    of_records = gs.latest(records, "record_no", "updated_at", [gs.clean_set(F.col("gene_ids")).alias("items")]).select(
        F.col("record_no").alias("set_no"), F.lit(False).alias("wanted"), "items"
    )
    return of_groups.unionByName(of_records).where(F.size("items") > 0).withColumn("cls", gs.set_class(F.col("items")))


def linked(groups: DataFrame, records: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The members (set_no, wanted, cls) and the links (cls_a, cls_b, jaccard) of their classes."""
    members = materialize(members_of(groups, records), "members")
    sets = materialize(gs.classes(members, ["wanted"]).select("items", "wanted", "cls", F.xxhash64("cls").alias("cls_no")), "classes")
    links = similar_classes(sets, threshold, recall)
    release(sets)
    return members.select("set_no", "wanted", "cls"), links


def similar_pairs(groups: DataFrame, records: DataFrame, threshold: float = 0.6, recall: float = 0.9999) -> DataFrame:
    """(set_no_a, set_no_b, jaccard), a < b: all pairs with at least one group."""
    who, links = linked(groups, records, threshold, recall)
    a = who.select(F.col("cls").alias("cls_a"), F.col("set_no").alias("no_a"), F.col("wanted").alias("wanted_a"))
    b = who.select(F.col("cls").alias("cls_b"), F.col("set_no").alias("no_b"), F.col("wanted").alias("wanted_b"))
    across = links.join(a, "cls_a").join(b, "cls_b").select("no_a", "no_b", "wanted_a", "wanted_b", "jaccard")
    within = (
        a.join(b, F.col("cls_a") == F.col("cls_b"))
        .where(F.col("no_a") < F.col("no_b"))
        .select("no_a", "no_b", "wanted_a", "wanted_b", F.lit(1.0).alias("jaccard"))
    )
    return (
        across.unionByName(within)
        .where(F.col("wanted_a") | F.col("wanted_b"))
        .select(F.least("no_a", "no_b").alias("set_no_a"), F.greatest("no_a", "no_b").alias("set_no_b"), "jaccard")
    )


def similar_records(groups: DataFrame, records: DataFrame, threshold: float = 0.6, recall: float = 0.9999) -> DataFrame:
    """(set_no, class_no, copies, links): one row per record with a set; ``class_no`` is the
    smallest number of the records with the same set, ``copies`` how many they are, ``links``
    the number of different similar sets (of a pair at least one is a group's)."""
    who, links = linked(groups, records, threshold, recall)
    ends = links.select(F.col("cls_a").alias("cls")).unionByName(links.select(F.col("cls_b").alias("cls")))
    counted = ends.groupBy("cls").agg(F.count("*").alias("links"))
    classes = who.groupBy("cls").agg(F.min("set_no").alias("class_no"), F.count("*").alias("copies"))
    return (
        who.join(classes.join(counted, "cls", "left"), "cls")
        .select("set_no", "class_no", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
