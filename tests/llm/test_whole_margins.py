from strandloom.llm import garble


def test_every_clean_segment_is_validated(spark, monkeypatch):
    """The margins see all clean segments, however many, and each of them garbled by every chain to UTF-8."""
    seen = []
    keep = garble.validated_margins
    monkeypatch.setattr(garble, "validated_margins", lambda rows, *rest: seen.extend(rows) or keep(rows, *rest))
    docs = [(k, f"Die Gruppe {k} gehört zu den Wegen über die größten Kanten.") for k in range(3_000)]
    model = garble.train(spark.createDataFrame(docs, "doc_id long, text string"))
    of = {bad: sum(r[3] for r in seen if r[0] and r[1] == bad) for bad in (True, False)}
    assert of[False] == 3_000 and of[True] >= 3_000 * len(garble.READ_AS)
    assert all(garble.GRID[0] <= m <= garble.GRID[-1] for m in model.margins.values())
