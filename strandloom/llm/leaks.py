"""Evaluation texts leaking into training text.

Method: q-gram lemma filtering. Texts become words (maximal runs of a-z and 0-9 after
lower-casing) joined by single spaces. All character q-grams of the items are held in one
sorted table; each document's q-grams are looked up in it, and the shared ones counted in
overlapping diagonal bands of (document position - item position). A passage of at least
``w`` characters with at most ``e`` edits shares no fewer than w - q + 1 - q e q-grams
within a band as wide as e allows, so bands below that count are dropped without loss. What
remains is verified by an alignment confined to the band.

The items are a fixed table. They are held in tables of up to :data:`MAX_ITEM_CHARS`
characters, which are broadcast together, so the documents are scanned once, where they lie,
without a shuffle.

Input conventions: a null or empty text holds nothing and leaks nothing; items shorter than
the passage length leak nothing; texts of any length are processed whole; equal items are
all reported; repeated ids are reported once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import spread

#: Characters of items in one broadcast table (its arrays take about 24 bytes each).
MAX_ITEM_CHARS = 2_000_000
MIN_WORDS = 15

SCHEMA = "item_id bigint, doc_id bigint, words int, edits int, doc_word int, item_word int"


def plain(text) -> DataFrame:
    """Words of a text joined by single spaces, as a column."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def qgram_keys(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key of the q-gram at every position of a byte array."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys = np.zeros(n, np.uint64)
    wide = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n] + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    return keys


class ItemTable:
    """Sorted q-grams of all items, with item and position of each.

    ``need[k]`` is the q-gram lemma's bound for item k: its shortest passage of
    ``min_words`` words has w characters, and each of ``max_edits`` word edits spoils at
    most q + L q-grams, L being the item's longest word. q is set so that the bound is
    about half of the shortest passage of all.
    """

    def __init__(self, ids: list[int], texts: list[str], min_words: int, max_edits: int) -> None:
        self.ids, self.texts = np.array(ids, np.int64), texts
        self.words = [t.split(" ") for t in texts]
        shortest = np.array([self._shortest(w, min_words) for w in self.words], np.int64)
        longest = np.array([max(map(len, w)) for w in self.words], np.int64)
        usable = shortest > 0
        least = int(shortest[usable].min()) if usable.any() else 2 * min_words - 1
        q = max(4, least // (2 if not max_edits else 3 * (max_edits + 1)))
        self.q = q
        self.need = np.maximum(1, shortest - q + 1 - max_edits * (q + longest))
        self.need[~usable] = np.iinfo(np.int64).max
        self.width = 1 if not max_edits else 2 * max_edits * (int(longest.max(initial=1)) + 1)
        keys, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, text in enumerate(texts):
            if usable[k]:
                own = qgram_keys(np.frombuffer(text.encode(), np.uint8), q)
                keys.append(own)
                owner.append(np.full(len(own), k, np.int64))
                place.append(np.arange(len(own), dtype=np.int64))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.distinct, self.start = np.unique(keys[order], return_index=True)
        self.count = np.diff(np.r_[self.start, len(keys)])
        # A bit per hash value answers most lookups of q-grams that no item has.
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.distinct & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _shortest(words: list[str], min_words: int) -> int:
        """Characters of the shortest passage of ``min_words`` words; 0 if there is none."""
        if len(words) < min_words:
            return 0
        ends = np.cumsum([len(w) + 1 for w in words])
        return int((ends[min_words - 1 :] - np.r_[0, ends[:-min_words]]).min()) - 1


def banded_runs(doc: np.ndarray, item: np.ndarray, band: range, max_edits: int) -> tuple[int, int, int, int]:
    """The longest common passage of two lists of word numbers within the diagonals of ``band``
    (document word - item word), with at most ``max_edits`` words changed, left out or put in.

    Returns (words matched, edits, start in doc, start in item). Alignment by rows of the
    document: for every number of edits the words matched by the best passage that ends at each
    cell of the row, and where it began; a passage begins with a match.
    """
    best = (0, 0, 0, 0)
    m = len(item)
    first, last = max(0, band.start), min(len(doc), m + band.stop - 1)
    places = np.arange(m)
    # one guard cell on the left: cell j + 1 is item word j
    count = np.zeros((max_edits + 1, m + 1), np.int64)
    begun = np.full((max_edits + 1, m + 1), -1, np.int64)  # doc start * m + item start
    for i in range(first, last):
        inside = (i - places >= band.start) & (i - places < band.stop)
        same = (item == doc[i]) & inside
        fresh_count, fresh_begun = np.zeros_like(count), np.full_like(begun, -1)
        for e in range(max_edits + 1):
            n = np.where(same, count[e, :-1] + 1, 0)
            at = np.where(same, np.where(count[e, :-1] > 0, begun[e, :-1], i * m + places), -1)
            if e:
                # a word changed, one of the document put in, one of the item left out
                for other, start in ((count[e - 1, :-1], begun[e - 1, :-1]), (count[e - 1, 1:], begun[e - 1, 1:]), (fresh_count[e - 1, :-1], fresh_begun[e - 1, :-1])):
                    better = (other > n) & inside
                    n, at = np.where(better, other, n), np.where(better, start, at)
            fresh_count[e, 1:], fresh_begun[e, 1:] = n, at
            top = int(n.argmax())
            if (int(n[top]), -e) > (best[0], -best[1]):
                best = (int(n[top]), e, *divmod(int(at[top]), m))
        count, begun = fresh_count, fresh_begun
    return best


def _bands(table: ItemTable, doc: np.ndarray, owner: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Columns (doc, item, first diagonal) of the overlapping bands with enough shared q-grams."""
    found = []
    for shift in {0, table.width // 2}:
        band = (diagonal + shift) // table.width
        low = band.min()
        key = ((doc << 22 | owner) << 33) | (band - low)
        groups, count = np.unique(key, return_counts=True)
        item = groups >> 33 & ((1 << 22) - 1)
        ok = count >= table.need[item]
        groups, item = groups[ok], item[ok]
        found.append(np.stack([groups >> 55, item, ((groups & ((1 << 33) - 1)) + low) * table.width - shift]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _scan(shared, min_words: int, max_edits: int):
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: list[ItemTable] = shared.value
        for pdf in batches:
            out: list[tuple] = []
            raw = [t.encode() for t in pdf["plain"]]
            ids = pdf["doc_id"].tolist()
            sizes = np.array([len(t) for t in raw], np.int64)
            lo = 0
            while lo < len(raw):
                total = np.cumsum(sizes[lo : lo + 250])
                hi = lo + max(1, int(np.searchsorted(total, 1_000_000, side="right")))
                for table in tables:
                    out += _scan_some(table, ids[lo:hi], raw[lo:hi], min_words, max_edits)
                lo = hi
            yield pd.DataFrame(out, columns=columns)

    return run


def _scan_some(table: ItemTable, ids: list[int], raw: list[bytes], min_words: int, max_edits: int) -> list[tuple]:
    """Leaks of a few documents whose q-grams are looked up together."""
    sizes = np.array([len(t) for t in raw], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    keys = qgram_keys(np.frombuffer(b"\n".join(raw), np.uint8), table.q)
    at = np.flatnonzero(table.sieve[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)])
    if not len(at) or not len(table.distinct):
        return []
    near = np.searchsorted(table.distinct, keys[at])
    near[near == len(table.distinct)] = 0
    hit = table.distinct[near] == keys[at]
    at, near = at[hit], near[hit]
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, side="right") - 1
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    per_doc = np.add.reduceat(table.count[near], first)
    bounds = np.r_[first, len(doc)]
    found = []
    for a, b in _slices(per_doc, 3_000_000):
        cut = slice(bounds[a], bounds[b])
        n = table.count[near[cut]]
        rows = np.repeat(table.start[near[cut]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where = np.repeat(doc[cut], n)
        found.append(_bands(table, where, table.owner[rows], np.repeat(at[cut], n) - starts[where] - table.place[rows]))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    words: dict[int, list[str]] = {}
    for d, k, low in np.concatenate(found, axis=1).T.tolist():
        if d not in words:
            words[d] = raw[d].decode().split(" ")
        got = _verify(words[d], table.words[k], low, table.width, max_edits)
        if got[0] + got[1] >= min_words and got > best.get((d, k), (0, 0, 0, 0)):
            best[d, k] = got
    return [(int(table.ids[k]), ids[d], *got) for (d, k), got in best.items()]


def _slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive entries whose counts sum to about ``most``."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield at, to
        at = to


def _verify(words: list[str], item: list[str], low: int, width: int, max_edits: int) -> tuple[int, int, int, int]:
    """The best passage whose word diagonals come from the characters' band."""
    doc_at = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    item_at = np.cumsum([0] + [len(w) + 1 for w in item[:-1]])
    diagonals: set[int] = set()
    spans = np.searchsorted(doc_at, np.stack([item_at + low, item_at + low + width]))
    for j, (a, b) in enumerate(spans.T.tolist()):
        for i in range(a, b):
            if words[i] == item[j]:
                diagonals.add(i - j)
    if not diagonals:
        return (0, 0, 0, 0)
    if max_edits == 0:
        return max(_exact_run(words, item, d) for d in diagonals)
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64) for ws in (words, item)]
    return banded_runs(*coded, range(min(diagonals) - max_edits, max(diagonals) + max_edits + 1), max_edits)


def _exact_run(doc: list[str], item: list[str], diagonal: int) -> tuple[int, int, int, int]:
    """The longest run of equal words on one diagonal, as :func:`banded_runs` gives it."""
    best = (0, 0, 0, 0)
    i, j, run = max(0, diagonal), max(0, -diagonal), 0
    while i < len(doc) and j < len(item):
        run = run + 1 if doc[i] == item[j] else 0
        i, j = i + 1, j + 1
        if run > best[0]:
            best = (run, 0, i - run, j - run)
    return best


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = 0) -> DataFrame:
    """(item_id, doc_id, words, edits, doc_word, item_word): every document that holds at
    least ``min_words`` words of an item with at most ``max_edits`` word edits, with the
    longest such passage. With no edits the words are consecutive and equal."""
    spark = documents.sparkSession
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", plain(F.col("text")).alias("plain"))
    texts = spread(texts.where(F.length("plain") >= 2 * min_words - 1))
    held = items.where(F.col("item_id").isNotNull()).select("item_id", plain(F.col("text")).alias("plain")).where(F.col("plain") != "")
    rows = held.dropDuplicates(["item_id"]).toLocalIterator()  # the items are a fixed table
    tables, ids, words, chars = [], [], [], 0
    for r in rows:
        ids.append(r["item_id"])
        words.append(r["plain"])
        chars += len(r["plain"])
        if chars > MAX_ITEM_CHARS:
            tables.append((ids, words))
            ids, words, chars = [], [], 0
    if ids or not tables:
        tables.append((ids, words))
    shared = spark.sparkContext.broadcast([ItemTable(ids, words, min_words, max_edits) for ids, words in tables])
    return texts.mapInPandas(_scan(shared, min_words, max_edits), SCHEMA).dropDuplicates(["item_id", "doc_id"])


def leak_report(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, n_docs, longest): one row per item that leaked."""
    return (
        leaked_passages(documents, items, min_words)
        .groupBy("item_id")
        .agg(F.count("*").alias("n_docs"), F.max("words").alias("longest"))
    )
