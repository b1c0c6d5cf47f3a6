"""Broken prompt and response pairs.

Method: for every defect several noisy labelling functions vote (yes, no, no opinion) on
each reply. The votes are counted by pattern over all replies, and an expectation-
maximization label model per defect learns how reliable each function is and how frequent
the defect; its posterior is attached to every reply. A defect is kept when its posterior
exceeds a cutoff validated on labelled replies: all sound replies, broken on purpose in each
way, beside the same replies as they were; their votes are counted by pattern. For refusals,
which cannot be made, the labels are replies that make a tool call (sound) and replies on
which functions of different evidence agree (refusals). A reply may keep several labels;
:func:`defects` returns the likeliest one. ``truncated`` has two models, one for answers
that break off and one for JSON that is never closed.

Two functions are learnt from the replies themselves, with counts over all of them in
hashed tables of fixed size: a character-trigram naive Bayes over eight languages, trained
on the texts whose function words name a language; and the wording of refusals, word
n-grams of an answer (not of its prompt) that go without a tool call far more often than
answers do. The model sees pattern counts only: at most 3 ** (number of functions) rows per
defect.

Input conventions: a null text is a text without words; of repeated candidate_ids the
latest ``received_at`` counts (ties: the greatest texts); a null candidate_id is left out;
texts are processed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.genesets import latest
from strandloom.runtime import materialize, release, shuffle_width

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Models by defect: the two ways to be truncated are learnt apart.
MODELS = {"empty": "empty", "copy": "copy", "refusal": "refusal", "language": "language", "cut_text": "truncated", "cut_json": "truncated"}

# ---- fixed values: words the labelling functions look for ----
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "nan", "undefined", "tbd", "todo", "empty", "no answer", "placeholder", "..."}
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as be this on by from at are was which it not but if so an or has have would can will after".split(),
    "de": "der die das und zu in ist von den mit dem nicht auf für ein eine wir als auch wird sich aus bei nach um weil gibt es nur zur".split(),
    "fr": "le la les de des et un une est que pour dans qui par sur au du ce il nous avec pas à où été mais quel quels cite afin".split(),
    "es": "el la los las de que y en un una es por con para se su lo como al del no más sólo según desde qué cita porque sitúa".split(),
    "pt": "o a os as de que e em um uma é por com para se não do da no na ao mais só pois já após caiu está seu".split(),
    "pl": "w z na do nie i się jest to że ze co po jak przez tylko więc ponieważ za oraz krok lecz jest dla tym".split(),
}
LETTERS = {"de": "äöüß", "fr": "àâçèêëîïôùûœ", "es": "ñ¿¡áíóú", "pt": "ãõâ", "pl": "ąćęłńśźż"}
#: A refusal in English: the writer (or the rules) will not do, and what is not done is to answer.
UNWILLING = r"(?:can(?:no|['’])t|can not|won['’]t|will not|would not|must not|could not|do(?:es)? not|don['’]t|doesn['’]t|am not|['’]m not|are not|unable|decline[ds]?|refuse[ds]?|declining|refusing|rather not|not (?:able|allowed|permitted|willing|comfortable|authori[sz]ed|going)|no (?:answer|permission|way))"
SPEAKING = r"(?:help|assist|answer|respond|repl(?:y|ies)|discuss|comment|compl(?:y|ete|ies)|provide|give|offer|advise|advice|engage|fulfil+|support|share|speak|talk|proceed|take part|participate|continue|assistance|guidance|propos(?:e|ing)|permission|topics?|requests?|questions?|inquir(?:y|ies)|subjects?|enquir(?:y|ies))"
SELF = r"(?:\bi\b|\bi['’]|\bme\b|\bmy\b|\bwe\b|\bus\b|\bour\b|\brequests?\b|\bquestions?\b|\banswer\b|\bassistant\b|\bmodel\b)"
RULES = r"\b(?:polic(?:y|ies)|guidelines?|instructed|told|allowed|permitted|permission|misuse[ds]?|harm(?:ful)?|unsafe|sensitive|appropriate|professional|specialist|expert|elsewhere)\b"
TONE = r"\b(?:sorry|apolog(?:y|ies|i[sz]e)|regret(?:fully)?|unfortunately|afraid|thank(?:s| you)|appreciate|language model|as an ai)\b"
#: What a refusal is not about: adding, dropping, ruling out, separating or removing things.
TASK_VERBS = r"\b(?:add|drop|keep|rule|separate|remove|exclude|merge|rank|query|resolve|distinguish|confirm|decide|tell|reach|see|find|show|support(?:s|ed)?)\b"
ERRORS_CUT = ("unterminated string", "finish_reason_length")
ERRORS_EMPTY = ("reasoning_and_tool_action_blank", "request_failed")
QUOTED_PREFIX = r"^\s*[\"'“”«]*\s*(?:you asked|the question was|question|prompt|query|user)\s*[:：]\s*"

INVISIBLE = re.compile("[​‌‍﻿­]")
THINK = re.compile(r"</?think>|</?answer>", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
PREFIX_RE = re.compile(QUOTED_PREFIX, re.I)
UNWILLING_RE, SPEAKING_RE, SELF_RE = (re.compile(rf"\b{p}" if p is not SELF else p, re.I) for p in (UNWILLING, SPEAKING, SELF))
RULES_RE, TONE_RE, TASK_RE = (re.compile(p, re.I) for p in (RULES, TONE, TASK_VERBS))
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|#|[.!?。！？\n]")
ENDS = set(".!?。！？\n")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")
#: Codes and names of tools: ASCII words with a digit, an underscore or in capitals, also next to letters of other scripts.
CODES = re.compile(
    r"(?<![A-Za-z0-9_À-ɏ])(?:[A-Za-z_]*[0-9][A-Za-z0-9_]*|[A-Za-z0-9]+_[A-Za-z0-9_]+|[A-Z]{2,})(?![A-Za-z0-9_À-ɏ])"
)
REASONING = re.compile(
    r"\"(?:reasoning\w*|answer|thought)\"\s*:\s*\"(.*?)(?:\"\s*,\s*\"(?:tool\w*|action\w*)\"|\"\s*,?\s*\}\s*[`\s]*$|$)", re.S
)
KEYED = re.compile(r"\{\s*(?:\"|\}|$)")
DECODER = json.JSONDecoder(strict=False)


def wordy(text: str | None) -> str:
    """The text without marks and placeholders; empty if no words are left."""
    if text is None:
        return ""
    bare = THINK.sub(" ", INVISIBLE.sub("", text)).strip()
    if bare.strip(" .\"'`*-–—").lower() in PLACEHOLDERS or bare.lower() in PLACEHOLDERS:
        return ""
    return bare if WORD.search(bare) else ""


def unclosed(text: str) -> bool:
    """Whether JSON was begun in the text and never closed."""
    at = text.find("{")
    if at < 0:
        return False
    depth, plain, inside, skip = 0, 0, False, False
    for c in text[at:]:
        plain += (c == "{") - (c == "}")
        if skip:
            skip = False
        elif c == "\\":
            skip = inside
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c == "{") - (c == "}")
    return plain > 0 and (depth > 0 or inside)


def read_raw(raw: str | None) -> tuple[str, bool, bool, bool, bool]:
    """(reasoning, has a tool call, begun but unclosed JSON, is JSON, decoding met the end) of a raw reply.

    JSON begins at the first brace that a key, a closing brace or the end follows."""
    if raw is None or not raw.strip():
        return "", False, False, False, False
    text = raw.strip()
    begun = KEYED.search(text)
    if begun is None:
        return wordy(text.strip("` \n")), False, False, False, False
    body = text[begun.start() :]
    value, ended = None, False
    for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        try:
            value = DECODER.raw_decode(attempt)[0]
            break
        except ValueError as error:
            ended = error.msg.startswith("Unterminated") or error.pos >= len(attempt.rstrip()) - 1
    if isinstance(value, dict):
        said = next((v for k, v in value.items() if isinstance(v, str) and re.match(r"reasoning|answer|thought", k)), "")
        call = value.get("tool_action", value.get("tool_call"))
        return wordy(said), bool(call) and call != "null", False, True, False  # parsed to its end: closed
    match = REASONING.search(body)
    said = match.group(1) if match else ""
    said = said.replace('\\"', '"').replace("\\n", "\n")
    return wordy(said), bool(re.search(r"\"tool_name\"\s*:\s*\"\w", body)), unclosed(body), True, ended


def named_language(bare: str) -> tuple[str | None, int]:
    """The language that script and function words of a text without codes name, and by how many words."""
    if not bare.isascii():
        letters = sum(map(str.isalpha, bare))
        if len(CYRILLIC.findall(bare)) > letters / 2:
            return "ru", 9
        if len(HAN.findall(bare)) > letters / 4:
            return "zh", 9
    hits = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in [w for w in LETTER_RUN.findall(bare) if w in WORD_LANGUAGES]:
        for language in WORD_LANGUAGES[word]:
            hits[language] += 1
    second, first = sorted(hits.values())[-2:]
    return (max(hits, key=hits.get), first - second) if first > second else (None, 0)


CYRILLIC, HAN, LETTER_RUN = re.compile("[Ѐ-ӿ]"), re.compile("[一-鿿]"), re.compile(r"[^\W\d_]+")
WORD_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words:
        WORD_LANGUAGES[_word] = (*WORD_LANGUAGES.get(_word, ()), _language)
LANGUAGES = (*FUNCTION_WORDS, "ru", "zh")
#: Places of the hashed trigrams of languages and n-grams of wording.
GRAMS, WORDING = 1 << 15, 1 << 17


def uncoded(text: str) -> str:
    """The text in lower case without codes and names of tools."""
    return CODES.sub(" ", text).lower()


def lettered_language(low: str) -> str | None:
    """The language whose own letters appear in an uncoded text most."""
    if low.isascii():
        return None
    if CYRILLIC.search(low):
        return "ru"
    if HAN.search(low):
        return "zh"
    hits = {k: sum(low.count(c) for c in s) for k, s in LETTERS.items()}
    best = max(hits, key=lambda k: hits[k])
    rest = sorted(hits.values())[-2]
    return best if hits[best] >= 2 and hits[best] > rest else None


def grams(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words of many uncoded texts, and where each text's begin."""
    runs = [" " + " ".join(LETTER_RUN.findall(low)) + " " for low in lows]
    sizes = np.array([max(0, len(r) - 2) for r in runs], np.int64)
    starts = np.cumsum(sizes) - sizes
    c = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), starts
    lengths = np.array([len(r) for r in runs], np.int64)
    ends = np.cumsum(lengths)
    inside = np.ones(len(c), bool)
    inside[ends - 1] = inside[np.maximum(ends - 2, 0)] = False  # a trigram does not reach into the next text
    mixed = ((c[:-2] * 1_000_003) ^ (c[1:-1] * 8_191) ^ (c[2:] * 131)) * 2_654_435_761
    return ((mixed >> 9) & (GRAMS - 1))[inside[:-2]], starts


def masked(text: str) -> str:
    """The text with a mark for every code or name of a tool."""
    return CODES.sub("#", text)


class WordCodes(dict):
    """Code of each word; 0 for an end of a sentence."""

    def __missing__(self, word: str) -> int:
        code = self[word] = 0 if word in ENDS else zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1
        return code


class Phrases:
    """Hashed pairs and triples of words of many answers (masked texts), without those pairs
    that stand in the answer's prompt; ``sentence`` and ``reply`` say whose each is. Codes
    stand for each other; no n-gram reaches over the end of a sentence."""

    def __init__(self, answers: list[str], queries: list[str]) -> None:
        known = WordCodes()

        def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            codes: list[int] = []
            sizes: list[int] = []
            for text in texts:
                words = TOKEN.findall(text.lower())
                codes.extend(map(known.__getitem__, words))
                codes.append(0)
                sizes.append(len(words) + 1)
            return np.array(codes, np.int64), np.repeat(np.arange(len(texts)), sizes)

        code, reply = tokens(answers)
        two = code[:-1] * 1_000_003 ^ code[1:]
        inside = (code[:-1] > 0) & (code[1:] > 0)
        q_code, q_reply = tokens(queries)
        q_two = (q_code[:-1] * 1_000_003 ^ q_code[1:])[(q_code[:-1] > 0) & (q_code[1:] > 0)]
        q_own = q_reply[:-1][(q_code[:-1] > 0) & (q_code[1:] > 0)]
        key = lambda h, r: h * 2_654_435_761 + r
        new = inside & ~np.isin(key(two, reply[:-1]), key(q_two, q_own))
        three = two[:-1] * 998_244_353 ^ code[2:]
        whole = inside[:-1] & inside[1:] & (new[:-1] | new[1:])
        sentence = np.cumsum(code == 0) if len(code) else code
        hashed = np.concatenate([two[new], three[whole] + 1])
        self.place = (hashed ^ hashed >> 29) % WORDING
        self.sentence = np.concatenate([sentence[:-1][new], sentence[:-2][whole]])
        self.reply = np.concatenate([reply[:-1][new], reply[:-2][whole]])


READ_SCHEMA = (
    "candidate_id bigint, query string, answer string, told string, has_tool boolean, unclosed boolean, is_json boolean, "
    "ended boolean, closes boolean, blank boolean, notes string, asked_in string, asked_lead int, told_in string, told_lead int"
)


def read_reply(query: str | None, reasoning: str | None, raw: str | None, errors) -> tuple:
    """One reply as the labelling functions need it (:data:`READ_SCHEMA` without the id)."""
    query = query or ""
    said, has_tool, cut, is_json, ended = read_raw(raw)
    answer = wordy(reasoning) or said
    notes = " ".join(str(e).lower() for e in errors) if errors is not None else ""
    closes = not is_json or (raw or "").rstrip("` \r\n\t").endswith("}")
    blank = not WORD.search(THINK.sub("", (reasoning or "") + (raw or "")))
    told = unquoted(query, answer)
    return query, answer, told, has_tool, cut, is_json, ended, closes, blank, notes, *named_language(uncoded(query)), *named_language(uncoded(told))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    for pdf in batches:
        columns = zip(pdf["candidate_id"], pdf["query_text"], pdf["reasoning_text"], pdf["raw_text"], pdf["generator_errors"])
        yield pd.DataFrame([(i, *read_reply(*rest)) for i, *rest in columns], columns=names)


COUNT_SCHEMA = "kind int, place int, n bigint"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts over replies: kinds from 0 are languages (trigrams), -1 and -2 the wording with
    and without a tool call."""
    counts = np.zeros((len(LANGUAGES), GRAMS), np.int64)
    wording = np.zeros((2, WORDING), np.int64)
    for pdf in batches:
        for lo in range(0, len(pdf), 2_000):
            part = pdf.iloc[lo : lo + 2_000]
            query, told = [masked(t) for t in part["query"]], [masked(t) for t in part["told"]]
            named = [*zip(query, part["asked_in"], part["asked_lead"]), *zip(told, part["told_in"], part["told_lead"])]
            for language in {n for _, n, lead in named if n and lead >= 3}:
                places = grams([t.replace("#", " ").lower() for t, n, lead in named if n == language and lead >= 3])[0]
                counts[LANGUAGES.index(language)] += np.bincount(places, minlength=GRAMS)
            found = Phrases(told, query)
            once = np.unique(found.reply * WORDING + found.place)
            of_tool = part["has_tool"].to_numpy(bool)[once // WORDING]
            wording[0] += np.bincount(once[of_tool] % WORDING, minlength=WORDING)
            wording[1] += np.bincount(once[~of_tool] % WORDING, minlength=WORDING)
    for kind, table in [*enumerate(counts), (-1, wording[0]), (-2, wording[1])]:
        held = np.flatnonzero(table)
        yield pd.DataFrame({"kind": np.full(len(held), kind, np.int32), "place": held.astype(np.int32), "n": table[held]})


class LanguageModel:
    """Naive Bayes over hashed trigrams."""

    def __init__(self, rows: pd.DataFrame) -> None:
        counts = np.full((len(LANGUAGES), GRAMS), 0.1)
        rows = rows[rows["kind"] >= 0]
        counts[rows["kind"].to_numpy(), rows["place"].to_numpy()] += rows["n"].to_numpy()
        self.known = counts.sum(axis=1) > GRAMS * 0.1 + 200
        self.logs = np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T)

    def __call__(self, lows: list[str]) -> list[str | None]:
        if not lows or not self.known.any():
            return [None] * len(lows)
        found, starts = grams(lows)
        sizes = np.diff(np.r_[starts, len(found)])
        scores = np.zeros((len(lows), len(LANGUAGES)), np.float32)
        held = np.flatnonzero(sizes > 0)
        if len(held):
            scores[held] = np.add.reduceat(self.logs[found], starts[held], axis=0)
        scores[:, ~self.known] = -np.inf
        ranked = np.sort(scores, axis=1)
        sure = (sizes >= 12) & (ranked[:, -1] - ranked[:, -2] > 4)
        return [LANGUAGES[k] if ok else None for k, ok in zip(scores.argmax(axis=1).tolist(), sure.tolist())]


class WordingModel:
    """How often a wording goes without a tool call: the share of its replies that make none,
    drawn towards the share of all replies by ``weight`` replies."""

    def __init__(self, rows: pd.DataFrame, weight: float = 10.0) -> None:
        with_, without = np.zeros(WORDING), np.zeros(WORDING)
        for kind, table in ((-1, with_), (-2, without)):
            own = rows[rows["kind"] == kind]
            table[own["place"].to_numpy()] = own["n"].to_numpy()
        total = with_.sum() + without.sum()
        base = without.sum() / total if total else 1.0
        self.base = base
        self.share = ((without + weight * base) / (with_ + without + weight)).astype(np.float32)

    def __call__(self, answers: list[str], queries: list[str]) -> np.ndarray:
        """For each masked answer the largest mean share of any sentence of three n-grams or
        more, as a part of the way from the base to 1; 0 where nothing but the prompt is said."""
        out = np.zeros(len(answers))
        if self.base > 0.9 or not answers:
            return out
        found = Phrases(answers, queries)
        if not len(found.place):
            return out
        ids, at = np.unique(found.sentence, return_inverse=True)
        size = np.bincount(at)
        mean = np.where(size >= 3, np.bincount(at, self.share[found.place]) / size, 0.0)
        whose = np.zeros(len(ids), np.int64)
        whose[at] = found.reply
        np.maximum.at(out, whose, (mean - self.base) / (1 - self.base))
        return out


def unquoted(query: str, answer: str) -> str:
    """The answer without the prompt it begins with, if it restates it."""
    bare = PREFIX_RE.sub("", answer).lstrip("\"'“”« ")
    if query and bare[: len(query)].lower() == query.lower():
        return bare[len(query) :].strip(" \"'“”»")
    return answer


def refuses(sentence: str) -> bool:
    """Whether an English sentence says that its writer, or a rule, will not answer."""
    if not UNWILLING_RE.search(sentence) or TASK_RE.search(sentence):
        return False
    return bool(SELF_RE.search(sentence)) and bool(SPEAKING_RE.search(sentence) or RULES_RE.search(sentence))


def ends_well(answer: str) -> bool:
    end = answer.rstrip().rstrip("\"'”’»*`)] ").rstrip()
    return end[-1:] in ".!?。！？…" and not re.search(r"(?:^|[\s(])0\.$", end)


def yes(ok, otherwise: int = -1) -> int:
    return 1 if ok else otherwise


def votes(reply: tuple, languages: tuple, odd: float, marked: str) -> dict[str, tuple[int, ...]]:
    """Votes of all labelling functions on one reply: 1 yes, -1 no, 0 no opinion.

    ``languages`` are (of the query, of the answer) by each of the three language functions,
    ``odd`` says how much its wording goes without a tool call, ``marked`` is the masked answer."""
    query, answer, told, has_tool, cut, is_json, ended, closes, blank, notes = reply[:10]
    cut_note = any(e in notes for e in ERRORS_CUT)
    out = {
        "empty": (
            yes(not answer and not has_tool and not cut),
            -1 if answer or has_tool else yes(any(e in notes for e in ERRORS_EMPTY), 0),
            yes(blank, 0) if not has_tool else -1,
        ),
        "cut_json": (
            yes(is_json and cut),
            yes(is_json and ended),
            yes(is_json and not closes),
            yes(cut_note, 0) if is_json else -1,
        ),
    }
    if not answer:
        return out | {"copy": (-1, -1, -1), "refusal": (-1, -1, -1, -1, -1), "language": (-1, -1, -1), "cut_text": (-1, -1, -1)}
    a = [w.lower() for w in WORD.findall(PREFIX_RE.sub("", answer))]
    q = [w.lower() for w in WORD.findall(query)]
    in_q = set(q)
    fresh = sum(w not in in_q for w in a) / max(1, len(a))
    if fresh < 0.6 and q:
        in_a = set(a)
        covered = sum(w in in_a for w in q) / len(q)
        triples = {tuple(a[k : k + 3]) for k in range(len(a) - 2)}
        shared = len(triples & {tuple(q[k : k + 3]) for k in range(len(q) - 2)}) / max(1, len(triples))
        like = 0.0
        if fresh <= 0.45:
            like = max(SequenceMatcher(None, a, q, False).ratio(), SequenceMatcher(None, a, q + q, False).ratio())
        out["copy"] = (yes(fresh <= 0.3 and covered >= 0.65), yes(shared >= 0.5, -1 if shared < 0.3 else 0), yes(like >= 0.75, -1 if like < 0.6 else 0))
    else:
        out["copy"] = (-1, -1, -1)
    copied = out["copy"][0] == 1
    sentences = [s for s in SENTENCE.split(marked) if s.strip()]
    said_no = bool(UNWILLING_RE.search(marked)) and any(map(refuses, sentences))
    odd = 0.0 if copied else odd
    coded = sum("#" in s for s in sentences)
    out["refusal"] = (
        yes(said_no),
        yes(odd >= 0.75, -1 if odd < 0.4 else 0),
        yes(bool(RULES_RE.search(told)) or bool(TONE_RE.search(told)), 0) if not has_tool else 0,
        yes(coded == 0, -1 if coded == len(sentences) and coded > 1 else 0),
        -1 if has_tool else 0,
    )
    first = languages[0][0] or languages[2][0]
    out["language"] = tuple(0 if b is None or (k or first) is None else yes(b != (k or first)) for k, b in languages)
    stops = ends_well(answer)
    end = answer.rstrip().rstrip("\"'”’»*`)] ").rstrip()
    out["cut_text"] = (
        0 if copied else yes(not stops),
        yes(cut_note, 0),
        0 if stops or copied else yes(bool(re.search(r"(?:[\w,;:]|(?:^|[\s(])0\.)$", end)), 0),
    )
    return out


def votes_of(replies: list[tuple], model: LanguageModel, wording: WordingModel) -> list[dict]:
    """Votes on many replies, whose languages are found together."""
    query, told = [masked(r[0]) for r in replies], [masked(r[2]) for r in replies]
    query_low, told_low = [t.replace("#", " ").lower() for t in query], [t.replace("#", " ").lower() for t in told]
    by_model = model(query_low + told_low)
    odd = wording(told, query).tolist()
    out = []
    for k, reply in enumerate(replies):
        languages = (
            (reply[10], reply[12]),
            (lettered_language(query_low[k]), lettered_language(told_low[k])),
            (by_model[k], by_model[len(replies) + k]),
        )
        out.append(votes(reply, languages, odd[k], told[k]))
    return out


#: Prior belief in each function: (yes on a defect, yes otherwise), as counts out of 100.
PRIOR = {
    "empty": ((98, 0.5), (60, 1), (60, 0.5)),
    "copy": ((95, 0.5), (90, 0.5), (90, 0.5)),
    "refusal": ((85, 0.5), (70, 0.5), (60, 3), (60, 3), (1, 1)),
    "language": ((92, 0.5), (60, 1), (92, 0.5)),
    "cut_text": ((95, 0.5), (50, 2), (80, 0.5)),
    "cut_json": ((95, 0.5), (85, 0.5), (90, 1), (40, 2)),
}


class LabelModel:
    """Two classes with one vote table per function, fitted by expectation-maximization to
    the counts of the vote patterns; ``weight`` replies of prior counts keep the class
    "defect" what the functions mean by it."""

    def __init__(self, patterns: list[tuple[int, ...]], counts: np.ndarray, prior, weight: float = 200.0, rounds: int = 100) -> None:
        m = len(prior)
        votes_ = np.array(patterns, np.int64).reshape(len(patterns), m) + 1
        base = np.empty((2, m, 3))
        for k, (good, bad) in enumerate(prior):
            for c, p in ((1, good / 100), (0, bad / 100)):
                base[c, k] = ((1 - p) * (0.3 if c else 0.6), (1 - p) * (0.7 if c else 0.4), p)
        self.tables, self.share = base.copy(), 0.02
        for _ in range(rounds):
            post = self._posterior(votes_)
            tables = np.stack([
                np.stack([((votes_ == v) * (p * counts)[:, None]).sum(axis=0) for v in range(3)], axis=1) for p in (1 - post, post)
            ])
            tables = tables + weight * base
            self.tables = tables / tables.sum(axis=2, keepdims=True)
            share = (post @ counts + 2) / (counts.sum() + 100)
            if abs(share - self.share) < 1e-9:
                break
            self.share = share

    def _posterior(self, votes_: np.ndarray) -> np.ndarray:
        log = np.log(self.tables)[:, np.arange(votes_.shape[1]), votes_].sum(axis=2) + np.log([[1 - self.share], [self.share]])
        log -= log.max(axis=0)
        return np.exp(log[1]) / np.exp(log).sum(axis=0)

    def posterior(self, patterns: list[tuple[int, ...]]) -> np.ndarray:
        return self._posterior(np.array(patterns, np.int64).reshape(len(patterns), -1) + 1)


def validated_cutoff(bad: np.ndarray, good: np.ndarray, share: float, n_bad: np.ndarray | None = None, n_good: np.ndarray | None = None) -> float:
    """The cutoff with the fewest expected errors: defects (posteriors ``bad``) not kept and
    sound replies (``good``) kept, weighted by the share of the defect; the middle of the best.
    ``n_bad`` and ``n_good`` say for how many replies each posterior stands (one by default)."""
    n_bad = np.ones(len(bad)) if n_bad is None else n_bad
    n_good = np.ones(len(good)) if n_good is None else n_good
    if not n_bad.sum() or not n_good.sum():
        return 0.5
    grid = np.linspace(0.02, 0.98, 97)
    share = min(max(share, 0.01), 0.5)
    errors = np.array([share * n_bad[bad <= c].sum() / n_bad.sum() + (1 - share) * n_good[good > c].sum() / n_good.sum() for c in grid])
    return float(np.median(grid[errors <= errors.min() + 1e-12]))


def broken(sound: list[tuple], seed: int = 5) -> dict[str, list[tuple]]:
    """Replies (query, reasoning, raw, errors) broken on purpose, by model. ``sound`` are
    (query, answer) pairs."""
    rng = random.Random(seed)
    wrap = lambda text: json.dumps({"reasoning_text": text, "tool_action": None}, ensure_ascii=False)
    out: dict[str, list[tuple]] = {"empty": [], "copy": [], "language": [], "cut_text": [], "cut_json": []}
    spoken: dict[str, list[str]] = {}
    for q, a in sound:
        name, lead = named_language(uncoded(a))
        if name and lead >= 3:
            spoken.setdefault(name, []).append(a)
    for q, a in sound:
        blank = rng.choice(["", " ", "N/A", "none"])
        out["empty"].append((q, blank, rng.choice([wrap(blank), "", "{}"]), None))
        words = q.split(" ")
        if len(words) > 5:
            words[rng.randrange(len(words))] = "this"
            out["copy"].append((q, " ".join(words), None, None))
        at = rng.randrange(len(a) // 4, max(len(a) // 4 + 1, len(a) - 2))
        if re.search(r"[^\W_][^\W_]$", a[:at]) and re.match(r"[^\W_]", a[at:]):
            out["cut_text"].append((q, a[:at], wrap(a[:at]), None))
        raw = wrap(a)
        out["cut_json"].append((q, a, raw[: rng.randrange(len(raw) // 2, len(raw) - 1)], None))
        asked = named_language(uncoded(q))[0]
        others = [n for n in spoken if n != asked]
        if asked and others:
            out["language"].append((q, rng.choice(spoken[rng.choice(sorted(others))]), None, None))
    return out


CHECK_SCHEMA = "model string, pattern string, bad boolean, n bigint"


def _check(shared) -> Callable:
    """Counts of the vote patterns of labelled replies, by model: all sound replies as they are
    (not bad) and broken on purpose (bad). Rows are replies with their votes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language, wording, posterior = shared.value
        counts: Counter = Counter()
        for pdf in batches:
            sound = np.ones(len(pdf), bool)
            for m in MODELS:
                sound &= pdf[m].map(posterior[m]).to_numpy() < 0.02
            sound &= (pdf["answer"] != "").to_numpy()
            for m in MODELS:
                if m == "refusal":
                    # Labels by evidence other than the vote in question: a tool call, or what is said and how it is worded.
                    tool = pdf["has_tool"].to_numpy(bool)
                    agreed = ~tool & pdf[m].str.startswith("1,1,").to_numpy()
                    for label, rows in ((False, tool), (True, agreed)):
                        counts.update((m, p, label) for p in pdf[m][rows])
                else:
                    counts.update((m, p, False) for p in pdf[m][sound])
            own = pdf[sound]
            for lo in range(0, len(own), 2_000):
                part = own.iloc[lo : lo + 2_000]
                for m, replies in broken(list(zip(part["query"], part["answer"]))).items():
                    for v in votes_of([read_reply(*r) for r in replies], language, wording):
                        counts[m, ",".join(map(str, v[m])), True] += 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["model", "pattern", "bad", "n"])

    return run


def cutoffs(models: dict[str, LabelModel], checked: list[tuple]) -> dict[str, float]:
    """The validated cutoff of each model; ``checked`` has (model, pattern, bad, replies)."""
    out = {}
    for m, model in models.items():
        sides = []
        for bad in (True, False):
            own = [(tuple(map(int, p.split(","))), n) for name, p, b, n in checked if name == m and b == bad]
            sides.append((model.posterior([p for p, _ in own]) if own else np.zeros(0), np.array([n for _, n in own], float)))
        (bad, n_bad), (good, n_good) = sides
        out[m] = validated_cutoff(bad, good, model.share, n_bad, n_good)
    return out


def _vote(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language, wording = shared.value
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")][1:]
        for pdf in batches:
            for lo in range(0, len(pdf), 2_000):
                part = pdf.iloc[lo : lo + 2_000]
                found = votes_of(list(zip(*[part[n].tolist() for n in names])), language, wording)
                yield pd.DataFrame(
                    {"candidate_id": part["candidate_id"].to_numpy()} | {m: [",".join(map(str, v[m])) for v in found] for m in MODELS}
                )

    return run


def posteriors(candidates: DataFrame) -> DataFrame:
    """(candidate_id, defect, posterior, kept): one row per reply and defect that some
    function voted for."""
    spark = candidates.sparkSession
    rows = latest(
        candidates,
        "candidate_id",
        "received_at",
        [F.col(c) for c in ("query_text", "reasoning_text", "raw_text", "generator_errors")],
    )
    replies = materialize(rows.mapInPandas(_read, READ_SCHEMA), "replies")
    counted = replies.select("query", "told", "has_tool", "asked_in", "asked_lead", "told_in", "told_lead").mapInPandas(_count, COUNT_SCHEMA).groupBy("kind", "place").agg(F.sum("n").alias("n"))
    held = counted.toPandas()  # at most languages * GRAMS + 2 * WORDING rows
    language, wording = LanguageModel(held), WordingModel(held)
    schema = "candidate_id bigint, " + ", ".join(f"{m} string" for m in MODELS)
    voted = materialize(replies.mapInPandas(_vote(spark.sparkContext.broadcast((language, wording))), schema), "votes")
    long = voted.select(
        "candidate_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pattern")) for m in MODELS])).alias("v")
    ).select("candidate_id", "v.*")
    seen = long.groupBy("model", "pattern").agg(F.count("*").alias("n")).collect()  # at most the vote patterns
    patterns = {m: [(tuple(map(int, r["pattern"].split(","))), r["n"], r["pattern"]) for r in seen if r["model"] == m] for m in MODELS}
    models = {m: LabelModel([p[0] for p in held], np.array([p[1] for p in held], float), PRIOR[m]) for m, held in patterns.items() if held}
    known = {m: dict(zip([p[2] for p in patterns[m]], model.posterior([p[0] for p in patterns[m]]).tolist())) for m, model in models.items()}
    labelled = replies.select("candidate_id", "query", "answer", "has_tool").join(voted, "candidate_id")
    # Replies are broken by chance in their order: the same in every run.
    labelled = labelled.repartition(shuffle_width(spark), "candidate_id").sortWithinPartitions("candidate_id")
    checked = labelled.mapInPandas(_check(spark.sparkContext.broadcast((language, wording, known))), CHECK_SCHEMA)
    checked = checked.groupBy("model", "pattern", "bad").agg(F.sum("n")).collect() if models else []  # at most the vote patterns
    limits = cutoffs(models, [tuple(r) for r in checked])
    release(replies)
    table = []
    for m, model in models.items():
        for (pattern, _, text), p in zip(patterns[m], model.posterior([x[0] for x in patterns[m]])):
            table.append((m, MODELS[m], text, float(p), bool(p > limits[m] and 1 in pattern)))
    known = spark.createDataFrame(table, "model string, defect string, pattern string, posterior double, kept boolean")
    return (
        long.where(F.col("pattern").rlike(r"(^|,)1"))
        .join(F.broadcast(known), ["model", "pattern"])
        .groupBy("candidate_id", "defect")
        .agg(F.max("posterior").alias("posterior"), F.max("kept").alias("kept"))
    )


def defects(candidates: DataFrame) -> DataFrame:
    """(candidate_id, defect): the likeliest kept defect of every defective reply. Of those
    almost equally likely the first of :data:`DEFECTS` counts: a copy without its last mark
    also looks cut off, but not the other way round."""
    place = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    best = F.max(F.struct(F.round("posterior", 1).alias("p"), (-place).alias("o"), "defect")).alias("b")
    return posteriors(candidates).where("kept").groupBy("candidate_id").agg(best).select("candidate_id", "b.defect")
