"""Garbled text from wrong character encoding.

Method: smoothed character n-gram models are trained on the clean segments of all
documents; then every candidate encode-decode chain is applied to every segment with
non-ASCII characters, each candidate is scored with the model, and the likeliest is
accepted if it beats the text as it stands by more than a margin. The margin is validated
on all clean segments, as they are and garbled on purpose by each chain. Chains are applied
again to their own result, which undoes double garbling.

A segment is a sentence or line. A segment is clean for training if no chain to UTF-8
changes it and it has no replacement character. A replacement character marks a segment as
affected whose text cannot be restored in full. Escapes (HTML, backslash) are ASCII and
left alone.

The n-gram counts live in a hashed table of fixed size (:data:`TABLE`), counted over all
documents in Spark; only that table goes to the driver and back.

Input conventions: a null or empty text is not affected; texts are processed whole; of
repeated doc_ids one row is returned; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import spread

#: Buckets of the hashed bigram and trigram counts.
TABLE = 1 << 20
#: Margins to choose from.
GRID = np.arange(2.0, 30.0, 0.5)
LOST = "�"

#: Single-byte encodings in which UTF-8 may have been read (fixed values).
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15")
#: Those whose UTF-8 sequences are ordinary letters of another script: no sign of garbling by themselves.
LETTERS = ("cp866", "koi8_r", "cp1251")
#: Pairs (read as, written in) of single-byte encodings.
SWAPS = (
    ("cp1252", "cp1251"), ("latin_1", "cp1251"), ("cp1252", "koi8_r"), ("latin_1", "koi8_r"), ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"), ("cp1252", "cp1250"), ("latin_1", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp1252"),
    ("cp1251", "cp1250"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1252", "cp866"), ("cp866", "cp1251"), ("cp1252", "iso8859_2"), ("latin_1", "iso8859_2"), ("iso8859_2", "cp1252"),
    ("cp1251", "cp866"), ("cp1252", "cp850"), ("cp1252", "cp437"),
)
#: Pairs (read as, written in) in which one side uses several bytes a character.
WIDE = (
    ("gb18030", "utf_8"), ("big5", "utf_8"), ("cp932", "utf_8"), ("cp1252", "gb18030"), ("latin_1", "gb18030"),
    ("cp1252", "big5"), ("latin_1", "big5"), ("cp1252", "cp932"), ("cp1251", "gb18030"), ("cp437", "gb18030"),
)

#: Whether a character is not ASCII.
NON_ASCII = "\x7f".__lt__

SEGMENT = re.compile(r"((?<=[.!?。])[ \t]+|[\r\n]+)")


def byte_chars(encoding: str) -> list[str]:
    """Character of each byte; a byte without one stands for itself, as lenient readers have it."""
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


class Utf8Reader:
    """Undoes UTF-8 read as a single-byte encoding, wherever the bytes make a character."""

    def __init__(self, encoding: str) -> None:
        chars = byte_chars(encoding)
        self.byte = {c: b for b, c in reversed(list(enumerate(chars)))}
        group = lambda a, b: "[" + "".join(re.escape(chars[x]) for x in range(a, b + 1)) + "]"
        more = group(0x80, 0xBF)
        self.pattern = re.compile(f"{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xF0, 0xF4)}{more}{{3}}")

        self.lead, self.more = set(chars[0xC2:0xF5]), set(chars[0x80:0xC0])

    def may_change(self, marks: set[str]) -> bool:
        """Whether a text of these non-ASCII characters can hold a sequence at all."""
        return not (self.lead.isdisjoint(marks) or self.more.isdisjoint(marks))

    def _one(self, match: re.Match) -> str:
        try:
            return bytes(self.byte[c] for c in match.group()).decode("utf-8")
        except ValueError:
            return match.group()

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self._one, text)


class Swap:
    """Undoes one single-byte encoding read as another."""

    def __init__(self, read_as: str, written: str) -> None:
        source, target = byte_chars(read_as), byte_chars(written)
        self.table = {ord(source[b]): target[b] for b in range(128, 256) if source[b] != target[b]}
        self.changed = set(map(chr, self.table))

    def may_change(self, marks: set[str]) -> bool:
        return not self.changed.isdisjoint(marks)

    def __call__(self, text: str) -> str:
        return text.translate(self.table)


class Wide:
    """Undoes a chain with several bytes a character, word by word; words it does not fit stay."""

    def __init__(self, read_as: str, written: str) -> None:
        self.written = written
        self.read_as = read_as
        single = read_as in READ_AS
        self.byte = {c: bytes([b]) for b, c in reversed(list(enumerate(byte_chars(read_as))))} if single else None

    def may_change(self, marks: set[str]) -> bool:
        return self.byte is None or any(c in self.byte for c in marks)

    def _word(self, word: str) -> str:
        if word.isascii():
            return word
        try:
            raw = b"".join(self.byte[c] for c in word) if self.byte else word.encode(self.read_as)
            return raw.decode(self.written)
        except (KeyError, ValueError):
            return word

    def __call__(self, text: str) -> str:
        return " ".join(map(self._word, text.split(" ")))


def to_utf8() -> dict:
    return {("utf_8", e): Utf8Reader(e) for e in READ_AS}


def tell_tale(segment: str, readers: list) -> bool:
    """Whether a segment shows by its characters alone that it is garbled."""
    return LOST in segment or any(r.pattern.search(segment) for r in readers)


def sure_readers() -> list:
    return [r for (_, read_as), r in to_utf8().items() if read_as not in LETTERS]


def chains() -> dict:
    return to_utf8() | {(w, r): Swap(r, w) for r, w in SWAPS} | {(w, r): Wide(r, w) for r, w in WIDE}


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a newline, with digits and capitals folded; and the starts."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((codes >= 48) & (codes <= 57), 48, np.where((codes >= 65) & (codes <= 90), 65, codes))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return codes, np.cumsum(sizes) - sizes


def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of the bigram and trigram that start at each character, and whether the
    trigram has a non-ASCII character."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    two = ((a * 1_000_003) ^ (b * 998_244_353)) * 2_654_435_761
    three = (two ^ (c * 1_000_000_007)) * 2_654_435_761
    return (two >> 13) & (TABLE - 1), (three >> 17) & (TABLE - 1), (a > 127) | (b > 127) | (c > 127)


def segments_of(text: str) -> list[str]:
    """Segments (even places) and what separates them (odd places)."""
    return SEGMENT.split(text)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashed counts of the clean segments: places from 0 are bigrams, from TABLE on trigrams."""
    readers = sure_readers()
    counts = np.zeros(2 * TABLE, np.int64)
    for pdf in batches:
        clean = []
        for text in pdf["text"]:
            for part in segments_of(text)[::2]:
                if part and not part.isascii() and not tell_tale(part, readers):
                    clean.append(part)
        for lo in range(0, len(clean), 20_000):
            codes = folded(clean[lo : lo + 20_000])[0]
            two, three, wide = windows(codes)
            counts[:TABLE] += np.bincount(two[wide], minlength=TABLE)
            counts[TABLE:] += np.bincount(three[wide], minlength=TABLE)
    held = np.flatnonzero(counts)
    for lo in range(0, len(held), 50_000):
        yield pd.DataFrame({"place": held[lo : lo + 50_000].astype(np.int32), "n": counts[held[lo : lo + 50_000]]})


class Model:
    """Smoothed log-probabilities of bigrams and trigrams, and the margin to accept a repair."""

    def __init__(self, places: np.ndarray, counts: np.ndarray) -> None:
        table = np.zeros(2 * TABLE, np.float64)
        table[places] = counts
        self.logs = np.empty(2 * TABLE, np.float32)
        for half in (slice(0, TABLE), slice(TABLE, 2 * TABLE)):
            total = table[half].sum()
            self.logs[half] = np.log((table[half] + 0.02) / (total + 0.02 * TABLE))
        #: By kind of chain: to UTF-8, where the bytes must fit, and all others.
        self.margins = {True: 8.0, False: 8.0}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text over its windows with non-ASCII characters."""
        codes, starts = folded(texts)
        two, three, wide = windows(codes)
        value = np.where(wide, (self.logs[two] + self.logs[TABLE + three]) / 2, 0.0)
        return np.add.reduceat(np.append(value, 0.0), starts)

    def repair(self, segments: list[str], ways: dict) -> tuple[list[str], list[tuple]]:
        """Best text of each segment, and the chains applied: one on top of the other as long as
        one brings more than the margin."""
        texts = list(segments)
        used: list[tuple] = [()] * len(texts)
        open_ = list(range(len(texts)))
        while open_:
            tried: list[str] = []
            whose: list[int] = []
            by: list[tuple] = []
            for k in open_:
                seen = {texts[k]}
                marks = set(filter(NON_ASCII, texts[k]))
                for name, way in ways.items():
                    if not way.may_change(marks):
                        continue
                    other = way(texts[k])
                    if other in seen:
                        continue
                    seen.add(other)
                    tried.append(other)
                    whose.append(k)
                    by.append(name)
            if not tried:
                break
            now = dict(zip(open_, self.scores([texts[k] for k in open_])))
            best: dict[int, tuple] = {}
            for k, other, name, score in zip(whose, tried, by, self.scores(tried).tolist()):
                gain = score - now[k]
                if gain > self.margins[name[0] == "utf_8"] and gain > best.get(k, (0.0,))[0]:
                    best[k] = (gain, other, name)
            for k, (_, other, name) in best.items():
                texts[k], used[k] = other, (*used[k], name)
            open_ = list(best)
        return texts, used

    def gains(self, segments: list[str], ways: dict) -> np.ndarray:
        """The largest gain that any of ``ways`` brings to each segment; 0 if none does."""
        out = np.zeros(len(segments))
        now = self.scores(segments) if segments else out
        tried = [(k, way(s)) for k, s in enumerate(segments) for marks in [set(filter(NON_ASCII, s))] for way in ways.values() if way.may_change(marks)]
        tried = [(k, t) for k, t in tried if t != segments[k]]
        if tried:
            at = np.array([k for k, _ in tried])
            np.maximum.at(out, at, self.scores([t for _, t in tried]) - now[at])
        return out


def garbled(segments: list[str], written: str, read_as: str) -> list[tuple[int, str]]:
    """(place, text) of the segments that change when they are read in the wrong encoding."""
    chars = byte_chars(read_as) if read_as in READ_AS else None
    out = []
    for k, text in enumerate(segments):
        try:
            raw = text.encode(written)
            other = "".join(chars[b] for b in raw) if chars else raw.decode(read_as)
        except ValueError:
            continue
        if other != text:
            out.append((k, other))
    return out


def _gained(shared):
    """Counts of clean segments, as they are and garbled by each chain (``bad``), by the
    number of margins that the largest gain exceeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        readers = sure_readers()
        counts = np.zeros((2, 2, len(GRID) + 1), np.int64)

        def add(kind: bool, bad: bool, gains: np.ndarray, n: np.ndarray) -> None:
            counts[int(kind), int(bad)] += np.bincount(np.searchsorted(GRID, gains), n, len(GRID) + 1).astype(np.int64)

        for pdf in batches:
            held = Counter(s for t in pdf["text"] for s in segments_of(t)[::2] if s and not s.isascii() and not tell_tale(s, readers))
            every, often = list(held), np.array(list(held.values()))
            for lo in range(0, len(every), 2_000):
                clean, n = every[lo : lo + 2_000], often[lo : lo + 2_000]
                score = model.scores(clean)
                for kind in (True, False):
                    ways = {w: f for w, f in chains().items() if (w[0] == "utf_8") == kind}
                    add(kind, False, model.gains(clean, ways), n)
                    for name, way in ways.items():
                        made = garbled(clean, *name)
                        if not made:
                            continue
                        at, texts = np.array([k for k, _ in made]), [t for _, t in made]
                        gains = score[at] - model.scores(texts)
                        back = np.array([way(t) == clean[k] for k, t in made])
                        # A gain over every margin is enough; else another chain may bring more.
                        open_ = np.flatnonzero(~back | (gains <= GRID[-1]))
                        gains[open_] = model.gains([texts[k] for k in open_], ways)
                        add(kind, True, gains, n[at])
        kind, bad, over = np.nonzero(counts)
        yield pd.DataFrame({"kind": kind > 0, "bad": bad > 0, "over": over.astype(np.int32), "n": counts[kind, bad, over]})

    return run


def validated_margins(rows: list[tuple]) -> dict[bool, float]:
    """For each kind of chain the margin with the fewest errors on clean segments and on
    the same segments garbled by every chain of the kind; the middle of equally good ones.
    ``rows`` are (kind, bad, margins exceeded, segments)."""
    out = {}
    for kind in (True, False):
        plain, found = np.zeros(len(GRID) + 1), np.zeros(len(GRID) + 1)
        for k, bad, over, n in rows:
            if k == kind:
                (found if bad else plain)[over] += n
        if not found.sum():
            out[kind] = 8.0
            continue
        at_most = np.cumsum(found)[:-1] / found.sum()
        above = 1 - np.cumsum(plain)[:-1] / plain.sum()
        # A clean segment taken for garbled is the worse error: most segments are clean.
        errors = 4 * above + at_most
        out[kind] = float(np.median(GRID[errors <= errors.min() + 0.002]))
    return out


def train(documents: DataFrame) -> Model:
    """The model of all documents with its validated margin."""
    texts = _suspects(documents)
    rows = texts.select("text").mapInPandas(_count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    held = rows.toPandas()  # at most 2 * TABLE rows
    model = Model(held["place"].to_numpy(np.int64), held["n"].to_numpy(np.float64))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    gained = texts.select("text").mapInPandas(_gained(shared), "kind boolean, bad boolean, over int, n bigint")
    model.margins = validated_margins([tuple(r) for r in gained.groupBy("kind", "bad", "over").agg(F.sum("n")).collect()])  # at most 4 rows a margin
    return model


def _suspects(documents: DataFrame) -> DataFrame:
    """Documents with a non-ASCII character: only they can be garbled."""
    return spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text"))


SCHEMA = "doc_id bigint, n_segments int, lossless boolean, chains string, restored string"


def _restore(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        ways = chains()
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                ids = pdf["doc_id"].iloc[lo : lo + 500].tolist()
                parts = [segments_of(t) for t in pdf["text"].iloc[lo : lo + 500]]
                where = [(d, k) for d, p in enumerate(parts) for k in range(0, len(p), 2) if p[k] and not p[k].isascii()]
                texts, used = model.repair([parts[d][k] for d, k in where], ways)
                touched: dict[int, list] = {}
                for (d, k), text, chain in zip(where, texts, used):
                    lost = LOST in text
                    if chain or lost:
                        parts[d][k] = text
                        n, whole, names = touched.get(d, (0, True, set()))
                        names = names | {"+".join(f"{w}<{r}" for w, r in chain)} if chain else names
                        touched[d] = (n + 1, whole and not lost, names)
                yield pd.DataFrame(
                    [(ids[d], n, whole, ",".join(sorted(names)), "".join(parts[d])) for d, (n, whole, names) in touched.items()],
                    columns=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return run


def restored(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per affected document: how many segments were garbled, whether nothing was
    lost, the chains undone, and the text with all that could be restored."""
    model = model or train(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return _suspects(documents).mapInPandas(_restore(shared), SCHEMA).dropDuplicates(["doc_id"])
