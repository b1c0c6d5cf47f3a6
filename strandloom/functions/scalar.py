"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a bar: the order that replaces seeded shuffles."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def fact_id(text: Column) -> Column:
    """Content-addressed id of a canonical text."""
    return F.concat(F.lit("fact_"), F.substring(F.sha2(text, 256), 1, 24))


def small_bin(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n == 3, "3").when(n <= 5, "4-5").otherwise("6+")


def module_bin(n: Column) -> Column:
    return F.when(n.between(5, 10), "small").when(n.between(11, 15), "medium").when(n.between(16, 30), "large")


def drop_count(n: Column, difficulty: Column) -> Column:
    """Items to drop: 1, a fifth or a third of n (rounded half to even), at most n - 2."""
    wanted = (
        F.when(difficulty == "easy", F.lit(1))
        .when(difficulty == "medium", F.greatest(F.lit(1), F.bround(n * 0.2)))
        .otherwise(F.greatest(F.lit(2), F.bround(n * 0.33)))
    )
    return F.least(wanted, F.greatest(F.lit(1), n - 2)).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the 95% score interval of a rate, within [0, 1]; both 0 without trials."""
    p = F.try_divide(hits, n)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = clamp01((mid - half) / scale), clamp01((mid + half) / scale)
    return F.when(n < 1, 0.0).otherwise(low), F.when(n < 1, 0.0).otherwise(high)


#: Words that do not count in answer scoring (fixed values).
STOP_WORDS = [
    "it", "its", "they", "their", "that", "this", "which", "is", "are", "were", "be", "to",
    "a", "an", "the", "some", "as", "and", "also",
]
#: ASCII punctuation (fixed values).
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
#: Characters of a thought beyond which it counts as overlong (fixed value).
LONGEST_THOUGHT = 4000


def tagged(text: Column, tag: str) -> Column:
    """What the first pair of a tag encloses, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def answer_words(text: Column) -> Column:
    """Distinct lower-case words without ASCII punctuation and stop words."""
    words = F.split(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"(?U)\s+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: w != "")), F.array(*map(F.lit, STOP_WORDS)))


def word_overlap(answer: Column, target: Column) -> Column:
    """Share of the target's words that the answer has; 0 without target words. The answer is
    what its answer tags enclose, or the whole text."""
    said = tagged(answer, "answer")
    a, t = answer_words(F.when(said != "", said).otherwise(answer)), answer_words(target)
    return safe_divide(F.size(F.array_intersect(a, t)).cast("double"), F.size(t))


def format_score(text: Column) -> Column:
    """Shape of a tagged answer: 0.4 a pair of each tag; and if there is exactly one of each
    0.2 for that, 0.2 thought first, 0.1 neither empty, 0.1 nothing before and after but some
    text between, -0.2 for an overlong thought; within [-1, 1]."""
    pairs = lambda t: F.regexp_count(text, F.lit(rf"(?s)<{t}>.*?</{t}>"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    inside = lambda t: F.regexp_extract(text, rf"(?s)<{t}>(.*?)</{t}>", 1)
    single = (pairs("think") == 1) & (pairs("answer") == 1)
    # offsets of the first pairs: what stands before the thought, up to the answer, and after it
    before_think = F.length(F.regexp_extract(text, r"(?s)^(.*?)<think>.*?</think>", 1))
    before_answer = F.length(F.regexp_extract(text, r"(?s)^(.*?)<answer>.*?</answer>", 1))
    think_end = before_think + F.length(inside("think")) + len("<think></think>")
    answer_end = before_answer + F.length(inside("answer")) + len("<answer></answer>")
    part = lambda start, length: bare(F.substring(text, start + 1, F.greatest(length, F.lit(0))))
    framed = (part(F.lit(0), before_think) == "") & (part(answer_end, F.length(text)) == "") & (part(think_end, before_answer - think_end) != "")
    points = lambda ok, p: F.when(ok, p).otherwise(0.0)
    score = (
        points((pairs("think") > 0) & (pairs("answer") > 0), 0.4) + points(single & (before_think < before_answer), 0.2) + points(single, 0.2)
        + points(single & (bare(inside("think")) != "") & (bare(inside("answer")) != ""), 0.1) + points(single & framed, 0.1)
        - points(single & (F.length(inside("think")) > LONGEST_THOUGHT), 0.2)
    )
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))


def add_count(n: Column, difficulty: Column) -> Column:
    """Items to add as noise: 1, a fifth or a third of n (rounded half to even), at least 1 (2 when hard)."""
    return (
        F.when(difficulty == "easy", F.lit(1))
        .when(difficulty == "medium", F.greatest(F.lit(1), F.bround(n * 0.2)))
        .otherwise(F.greatest(F.lit(2), F.bround(n * 0.33)))
    ).cast("int")


def audit_bin(n: Column) -> Column:
    """Size bins of reports: small 5 to 10, medium 11 to 15, large from 16, else other; unknown for null."""
    return F.when(n.isNull(), "unknown").when(n.between(5, 10), "small").when(n.between(11, 15), "medium").when(n >= 16, "large").otherwise("other")


def canonical_json(fields: dict[str, Column]) -> Column:
    """One object with its keys in order and no blanks: equal fields give equal texts."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def list_field(text: Column, sep: str = ";") -> Column:
    """Parts of a separated text, trimmed, blanks left out; empty for null."""
    return F.coalesce(F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def aligned(parts: Column, n: Column) -> Column:
    """An array cut or padded with nulls to ``n`` entries."""
    padded = F.concat(parts, F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size(parts), F.lit(0))))
    return F.slice(padded, 1, n)
