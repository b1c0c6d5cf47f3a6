import datetime

from strandloom.llm import replies

SCHEMA = "candidate_id long, query_text string, reasoning_text string, raw_text string, generator_errors array<string>, received_at timestamp"


def test_every_reply_is_validated(spark, monkeypatch):
    """The cutoffs see all sound replies and each of them without an answer, however many."""
    seen = []
    keep = replies.cutoffs
    monkeypatch.setattr(replies, "cutoffs", lambda models, checked, *rest: seen.extend(checked) or keep(models, checked, *rest))
    at = datetime.datetime(2024, 1, 1)
    rows = [
        (k, f"Which genes belong to the group of A{k} and B{k}?", f"The walk from A{k} ranks B{k} at place 4 because the links to it are strong.", None, None, at)
        for k in range(4_000)
    ]
    found = replies.defects(spark.createDataFrame(rows, SCHEMA)).collect()
    assert found == []
    of = {bad: sum(r[3] for r in seen if r[0] == "empty" and r[2] == bad) for bad in (True, False)}
    assert of == {True: 4_000, False: 4_000}
