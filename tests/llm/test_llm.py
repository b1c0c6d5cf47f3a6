import json
import random
import re
from datetime import datetime as t

import pytest

from strandloom.llm import garble, leaks, mixing, overlap, quota, replies, setjoin

RECORD = (
    "record_no bigint, complex_record_id string, split string, source string, gene_ids array<string>, updated_at timestamp, items int"
)


def random_sets(seed, n=400, universe=150):
    rng = random.Random(seed)
    base = [rng.sample(range(universe), rng.choice([2, 3, 4, 5, 8, 15, 40])) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if s and rng.random() < 0.5:
                s.pop(rng.randrange(len(s)))
            else:
                s.append(rng.randrange(universe))
        out.append({f"E{x}" for x in s})
    return out


def untidy(rng, s):
    items = [rng.choice(["{}", " {} ", "{}.4", "\t{}"]).format(x if rng.random() < 0.5 else x.lower()) for x in s]
    return items + rng.choice([[], [None], ["", " "], items[:1]])


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bounds", [(400_000, 800_000), (120, 200)])
def test_overlap_matches_brute_force(spark, bounds):
    rng = random.Random(3)
    sets = random_sets(5)
    splits = ["train", " Train", "TRAIN", "val", "Validation", "test ", None, "other"]
    rows, clean = [], {}
    for k, s in enumerate(sets):
        split = rng.choice(splits)
        ident = f"c_{rng.randrange(900):0{rng.choice([3, 5])}d}" if rng.random() < 0.9 else None
        rows.append((k, ident, split, None, untidy(rng, s) if rng.random() < 0.97 else None, t(2024, 1, 1), 0))
        kind = (split or "").strip().lower().replace("validation", "val")
        clean[k] = (kind, int(ident[2:]) if ident else None, s if rows[-1][4] else set())
    rows += rows[:30]
    want = set()
    for a in clean:
        for b in clean:
            if clean[a][0] == "train" and clean[b][0] in ("val", "test"):
                same_id = clean[a][1] is not None and clean[a][1] == clean[b][1]
                if same_id or (clean[a][2] and clean[b][2] and jac(clean[a][2], clean[b][2]) >= 0.8):
                    want.add((a, b))
    df = spark.createDataFrame(rows, RECORD)
    saved = overlap.near_classes.__defaults__
    overlap.near_classes.__defaults__ = bounds
    try:
        got = overlap.cross_split_overlaps(df).collect()
    finally:
        overlap.near_classes.__defaults__ = saved
    assert {(r.train_no, r.eval_no) for r in got} == want and len(got) == len(want)


def test_overlap_empty(spark):
    df = spark.createDataFrame([], RECORD)
    assert overlap.cross_split_overlaps(df).collect() == [] and overlap.overlap_report(df).collect() == []


def test_run_length_is_a_bound():
    rng = random.Random(1)
    for _ in range(300):
        a = set(rng.sample(range(60), rng.randint(1, 30)))
        b = set(a)
        for x in list(a):
            if rng.random() < 0.08:
                b.discard(x)
        b |= set(rng.sample(range(60), rng.randint(0, 3)))
        if not b or jac(a, b) < 0.8:
            continue
        text_a, text_b = sorted(a), sorted(b)
        longest = 0
        for i in range(len(text_a)):
            for j in range(len(text_b)):
                k = 0
                while i + k < len(text_a) and j + k < len(text_b) and text_a[i + k] == text_b[j + k]:
                    k += 1
                longest = max(longest, k)
        assert longest >= overlap.run_length(len(a), 0.8)


GROUP = "group_no bigint, gene_ids array<string>, created_at timestamp, wanted string"


def test_set_join_recall(spark):
    rng = random.Random(9)
    sets = random_sets(11, 600)
    groups = [(1000 + k, untidy(rng, s), t(2024, 1, 1), "x") for k, s in enumerate(sets[:300])]
    records = [(k, None, None, None, untidy(rng, s), t(2024, 1, 1), 0) for k, s in enumerate(sets[300:])]
    clean = {1000 + k: s for k, s in enumerate(sets[:300])} | {k: s for k, s in enumerate(sets[300:])}
    want = {
        (a, b) for a in clean for b in clean if a < b and b >= 1000 and clean[a] and clean[b] and jac(clean[a], clean[b]) >= 0.6
    }
    groups += [*groups[:20], (5000, None, t(2024, 1, 1), ""), (5001, [], None, ""), (None, ["A"], None, "")]
    out = setjoin.similar_pairs(spark.createDataFrame(groups, GROUP), spark.createDataFrame(records, RECORD)).collect()
    got = {(r.set_no_a, r.set_no_b) for r in out}
    assert len(got) == len(out) and not got - want
    assert len(got) >= 0.99 * len(want)
    assert setjoin.similar_pairs(spark.createDataFrame([], GROUP), spark.createDataFrame([], RECORD)).collect() == []


def test_code_parts_and_blocks_agree(spark):
    """Any part of the code is made alike alone; pairs of one crowded segment are all found in blocks."""
    import numpy as np

    syms = np.arange(1, 9, dtype=np.uint32) * np.uint32(2_654_435_761)
    with np.errstate(over="ignore"):
        whole, part = setjoin.Sketcher(0, 500, 3).bits(syms), setjoin.Sketcher(130, 200, 3).bits(syms)
    assert (whole[130:330] == part).all() and 0.3 < whole.mean() < 0.7
    rng = random.Random(2)
    core = [f"C{k}" for k in range(30)]
    rows = [(k, core + rng.sample([f"X{m}" for m in range(40)], 3), t(2024, 1, 1), "") for k in range(120)]
    groups, records = spark.createDataFrame(rows, GROUP), spark.createDataFrame([], RECORD)
    sizes = setjoin.similar_classes.__defaults__
    found = []
    for block in (setjoin.BLOCK, 16):
        setjoin.similar_classes.__defaults__ = (*sizes[:-1], block)
        try:
            found.append({(r.set_no_a, r.set_no_b) for r in setjoin.similar_pairs(groups, records).collect()})
        finally:
            setjoin.similar_classes.__defaults__ = sizes
    assert found[0] == found[1] == {(a, b) for a in range(120) for b in range(a + 1, 120)}
    some = {r.set_no: (r.class_no, r.copies, r.links) for r in setjoin.similar_records(groups, records).collect()}
    assert len(some) == 120 and sum(c * (n + c - 1) for _, c, n in some.values()) >= 120 * 119


TARGETS = "dimension string, category string, target_share double, min_rows bigint, sample_fraction double"


def test_quota_sample(spark):
    rng = random.Random(2)
    rows = [(f"p{k}", rng.choice([" A", "a", "b", None]), rng.choice(["x", "Y "]), t(2024, 1, 1)) for k in range(3000)]
    rows += [(f"c{k}", "c", "x", t(2024, 1, 1)) for k in range(12)] + rows[:50] + [(None, "a", "x", None)]
    df = spark.createDataFrame(rows, "pair_id string, kind string, mode string, created_at timestamp")
    goals = [("kind", "a", 0.4, 5, 0.4), ("kind", "b", 0.5, 5, 0.4), ("kind", "c", 0.1, 10, 0.4), ("mode", "x", 0.5, 5, 0.4), ("mode", "y", 0.5, 5, 0.4), ("mode", "z", 0.0, 3, 0.4)]
    s = quota.QuotaSample(df, "pair_id", "created_at", ["kind", "mode"], spark.createDataFrame(goals, TARGETS))
    report = {(r.dimension, r.category): r for r in s.report().collect()}
    keys = [r.key for r in s.sample().collect()]
    assert len(keys) == len(set(keys)) and None not in keys
    assert {k for k, r in report.items() if not r.reachable} == {("kind", "c"), ("mode", "z")}
    assert report["kind", "c"].available == 12 and report["kind", "c"].sampled >= 10
    for key in (("kind", "a"), ("kind", "b"), ("mode", "x"), ("mode", "y")):
        assert abs(report[key].sampled - report[key].quota) <= 0.06 * report[key].quota + 4
    again = quota.QuotaSample(df.repartition(3), "pair_id", "created_at", ["kind", "mode"], spark.createDataFrame(goals, TARGETS))
    assert sorted(r.key for r in again.sample().collect()) == sorted(keys)
    none = quota.QuotaSample(df.limit(0), "pair_id", "created_at", ["kind", "mode"], spark.createDataFrame(goals, TARGETS))
    assert none.sample().collect() == [] and none.report().count() == 6


def test_pivotal_keeps_sizes():
    rng = random.Random(4)
    p = [0.3] * 1000
    chosen, held, left = quota.pivotal(p, [rng.getrandbits(64) for _ in p])
    assert abs(len(chosen) + left - 300) < 1e-6


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["a", "b"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 14, 15, 40])))) for k in range(40)] + [(90, None), (91, "")]
    docs = []
    for k in range(200):
        words = rng.choices(vocabulary, k=60)
        for _ in range(rng.choice([0, 1, 2])):
            source = rng.choice(items[:40])[1].split()
            n = rng.choice([10, 14, 15, 16, 40])
            at = rng.randrange(max(1, len(source) - n + 1))
            words[30:30] = source[at : at + n]
        docs.append((k, " ".join(w + rng.choice(["", ",", "! ", "\n"]) for w in words).upper(), "e"))
    docs += [(500, None, ""), (501, "", ""), (502, "x " * 200_000 + items[3][1] * 3, "")]
    words = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    runs = {}
    for i, s in items:
        w = words(s)
        for k in range(len(w) - 14):
            runs.setdefault(tuple(w[k : k + 15]), set()).add(i)
    want = set()
    for d, s, _ in docs:
        w = words(s)
        for k in range(len(w) - 14):
            want |= {(i, d) for i in runs.get(tuple(w[k : k + 15]), ())}
    D, I = "doc_id bigint, text string, item_id string", "item_id bigint, text string"  # noqa: E741
    out = leaks.leaked_passages(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()
    assert {(r.item_id, r.doc_id) for r in out} == want and len(out) == len(want)
    assert leaks.leaked_passages(spark.createDataFrame([], D), spark.createDataFrame(items, I)).collect() == []
    assert leaks.leaked_passages(spark.createDataFrame(docs, D), spark.createDataFrame([], I)).collect() == []


def test_leak_with_an_edit(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    changed = text.replace("nine", "ninth")
    D, I = "doc_id bigint, text string", "item_id bigint, text string"  # noqa: E741
    docs, items = spark.createDataFrame([(1, "x " + changed + " y")], D), spark.createDataFrame([(1, text)], I)
    assert leaks.leaked_passages(docs, items).collect() == []
    assert [r.edits for r in leaks.leaked_passages(docs, items, 15, 1).collect()] == [1]


def test_near_passages_match_brute_force(spark):
    """Every passage of 15 words with one word changed, left out or put in is found, and only such."""
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(12)]
    docs, want = [], {}
    for k in range(120):
        item, text = items[k % 12]
        n = rng.choice([12, 13, 16, 20])
        at = rng.randrange(30 - n)
        part = text.split()[at : at + n]
        kind = rng.choice(["none", "change", "drop", "add", "two"])
        mid = n // 2
        if kind == "change":
            part[mid] = "other"
        elif kind == "drop":
            del part[mid]
        elif kind == "add":
            part.insert(mid, "other")
        elif kind == "two":
            part[n // 3], part[2 * n // 3] = "other", "another"
        matched = {"none": n, "change": n - 1, "drop": n - 1, "add": n, "two": max(n - 2 - n // 3, 2 * n // 3 - 1)}[kind]
        edits = 0 if kind == "none" else 1
        if matched + edits >= 15:
            want[item, k] = (matched, edits)
        docs.append((k, " ".join(rng.choices(["x1", "x2", "x3"], k=20)) + " " + " ".join(part) + " y1 y2"))
    D, I = "doc_id bigint, text string", "item_id bigint, text string"  # noqa: E741
    out = leaks.leaked_passages(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), 15, 1).collect()
    assert {(r.item_id, r.doc_id): (r.words, r.edits) for r in out} == want


DOCS = "doc_id bigint, text string, lang string, source string, ingested_at timestamp, tokens int"


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(k, "word " * rng.randint(1, 60), "en", rng.choice([" A", "a", "B", "b", "c", None, " "]), t(2024, 1, 1), 0) for k in range(800)]
    docs += docs[:10] + [(9000, None, None, "a", None, 0), (9001, "", None, "b", None, 0)]
    goal = spark.createDataFrame([("a", 0.2, 3), ("b", 0.3, 2), ("c", 0.45, 1), ("gone", 0.05, 4)], "source string, target_weight double, max_repeats int")
    df = spark.createDataFrame(docs, DOCS)
    sizes = mixing.sized_documents(df)
    plan = {r.source: r for r in mixing.plan(sizes, goal).collect()}
    assert not plan["gone"].met and not plan["c"].met and plan["a"].met
    rows = mixing.mixture(sizes, goal).collect()
    used = {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.tokens
        assert r.repeat_no < {"a": 3, "b": 2, "c": 1}[r.source] and -1e-9 <= r.position <= 1
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    for s, n in used.items():
        assert plan[s].taken <= n <= plan[s].taken + 70
    assert mixing.mixture(mixing.sized_documents(df.limit(0)), goal).collect() == []


def test_garbled_round_trip(spark):
    rng = random.Random(12)
    words = "für größere Prüfung wäre schön süß Äpfel möglich hört".split() + "après été où déjà présent modèle naïve".split()
    russian = "после удаления оценка падает группа сравним результат этого слоя".split()
    docs, bad, text_of = [], set(), {}
    for k in range(600):
        pool = russian if k % 4 == 0 else words
        text = " ".join(rng.choices(pool, k=12)) + "."
        text_of[k] = text
        if k % 10 == 1 or k % 20 == 8:
            written, read = ("utf_8", rng.choice(["cp1252", "mac_roman", "cp437", "latin_1"])) if pool is words else ("cp1251", "latin_1")
            chars = garble.byte_chars(read)
            text = "".join(chars[b] for b in text.encode(written))
            bad.add(k)
        docs.append((k, text, None, None, None, 0))
    docs += [(700, None, None, None, None, 0), (701, "", None, None, None, 0), (702, "plain &eacute; \\u00e9 text", None, None, None, 0), (703, "fi�r �t�", None, None, None, 0), docs[1]]
    out = {r.doc_id: r for r in garble.restored(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(out) == bad | {703} and not out[703].lossless
    assert sum(out[k].restored == text_of[k] for k in bad) >= 0.97 * len(bad)
    assert garble.restored(spark.createDataFrame([], DOCS)).collect() == []


CANDIDATE = (
    "candidate_id bigint, query_text string, reasoning_text string, raw_text string, generator_errors array<string>, received_at timestamp, defect int"
)


def test_reply_defects(spark):
    q = "Explain what process links A1, B2 and C3, and cite the layers that support your view."
    good = "The walk from A1 ranks B2 at place 4, and that is enough for a first look. The score of C3 is below it."
    german = "Wir schließen A1 aus, weil die Ähnlichkeit zu B2 nicht größer ist. Die Gruppe wird auch ohne C3 vollständig."
    tool = json.dumps({"reasoning_text": "", "tool_action": {"tool_name": "rwr"}})
    rows = [(k, q, good, json.dumps({"reasoning_text": good, "tool_action": None}), [], None, 0) for k in range(100)]
    rows += [(200 + k, q, german, None, [], None, 0) for k in range(3)]
    rows += [(300, q, None, None, None, None, 0), (301, q, "N/A", "{}", [], None, 0), (302, q, " ", tool, [], None, 0), (303, q, "", f"```json\n{json.dumps({'reasoning_text': good})}\n```", ["x"], None, 0)]
    rows += [(400, q, good[:60], '{"reasoning_text":"' + good[:60], ["actor_json_parse_error: Unterminated string"], None, 0), (401, q, "The walk from A1 ranks B2 at", None, [], None, 0)]
    rows += [(500, q, q, None, [], None, 0), (501, q, "You asked: " + q.lower(), None, [], None, 0), (502, q, f"The question was: {q} {good}", None, [], None, 0)]
    rows += [(600, q, "I'm sorry, but I cannot assist with choosing genes for this task.", None, [], None, 0), (601, q, "We decline to add A1: the score of 0.5 is below that of B2. I cannot rule out that C3 is a bystander, so one more query is needed.", None, [], None, 0)]
    rows += [(402, q, "The previous call returned 9 genes;", None, [], None, 0), (403, q, "The score of C3 is 0.", None, [], None, 0)]
    rows += [(203, q, "下一步调用induce_subgraph，比较QG9B和QB9A的结果。基因XA9P在pathway_links层只有9条边。", None, [], None, 0)]
    rows += [(None, q, None, None, None, None, 0), (700, None, good, None, None, None, 0), (701, None, None, None, None, None, 0), (702, q, good * 3000, None, [], None, 0), rows[0]]
    rows += [(800, q, None, None, [], t(2024, 1, 1), 0), (800, q, good, None, [], t(2024, 1, 2), 0)]
    got = {r.candidate_id: r.defect for r in replies.defects(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {
        200: "language", 201: "language", 202: "language", 203: "language", 402: "truncated", 403: "truncated", 300: "empty", 301: "empty", 400: "truncated", 401: "truncated",
        500: "copy", 501: "copy", 600: "refusal", 701: "empty",
    }
    assert replies.defects(spark.createDataFrame([], CANDIDATE)).collect() == []


UNSEEN = [
    "I must pass on this one: it is not my place to give an answer.",
    "I will not take part in this conversation any further.",
    "We are not in a position to comment on requests like yours.",
    "My instructions do not let me respond to this kind of question.",
    "I would rather not share an opinion here; please ask a professional.",
    "Regrettably I am not authorised to reply to such inquiries.",
    "I refuse to engage with this topic.",
    "This assistant can not provide guidance of that sort.",
]
HARMLESS = [
    "The community guidelines of the layer rank B2 above C3, so we keep B2.",
    "It is not appropriate to rank A1 first, because its score of 0.2 is below that of B2.",
    "A1 falls outside of the module at a cut of 0.4, so I drop it and keep C3.",
    "I cannot rule out that C3 is a bystander, so one more query is needed.",
    "Sorry for the long list: B2 and C3 share 14 edges, which the walk from A1 confirms.",
]


def test_unseen_refusals_and_harmless_doubts(spark):
    q = "Explain what process links A1, B2 and C3, and cite the layers that support your view."
    rng = random.Random(1)
    rows = []
    for k in range(400):
        good = " ".join(rng.sample(["The walk from A1 ranks B2 at place 4, and that is enough for a first look.", "The score of C3 is below that of B2 in the layer.", "Dropping A1 would test whether the bridge of C3 depends on one source.", "I cannot separate A1 from C3 with this layer alone."], 2))
        call = {"tool_name": "rwr"} if k % 4 else None
        rows.append((k, q, good, json.dumps({"reasoning_text": good, "tool_action": call}), [], None, 0))
    rows += [(1000 + k, q, s, None, [], None, 0) for k, s in enumerate(UNSEEN)] + [(2000 + k, q, s, None, [], None, 0) for k, s in enumerate(HARMLESS)]
    rows += [(3000, q, good, json.dumps({"reasoning_text": good, "tool_action": {"tool_name": "rwr", "arguments": {"gene": "E1"}}})[:-25], [], None, 0)]
    got = {r.candidate_id: r.defect for r in replies.defects(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert not [k for k in got if k < 1000 or 2000 <= k < 3000] and got[3000] == "truncated"
    assert sum(got.get(1000 + k) == "refusal" for k in range(len(UNSEEN))) >= 7, got


def test_label_model_learns_from_agreement():
    import numpy as np

    patterns = [(-1, -1, -1), (1, 1, 1), (1, 1, -1), (-1, 1, -1)]
    model = replies.LabelModel(patterns, np.array([900.0, 60, 30, 10]), ((90, 1), (90, 1), (60, 1)))
    post = model.posterior(patterns)
    assert post[1] > 0.99 and post[2] > 0.5 and post[0] < 0.01 and post[3] < 0.5


def test_cutoff_is_validated_on_labels():
    import numpy as np

    assert 0.3 < replies.validated_cutoff(np.array([0.7, 0.8, 0.9]), np.array([0.0, 0.1, 0.3]), 0.1) < 0.7
    assert replies.validated_cutoff(np.array([0.2, 0.21]), np.array([0.0, 0.01]), 0.1) < 0.2
    made = replies.broken([("Which genes belong to the group of A1 and B2?", "The walk from A1 ranks B2 at place 4.")] * 20)
    assert all(made[m] for m in ("empty", "copy", "cut_text", "cut_json"))
    assert all(replies.read_reply(*r)[4] for r in made["cut_json"])
