import json

from strandloom.operators import nested

STATE = {
    "predicted_groups": [{"group_id": "g1", "gene_ids": ["A", "B", "A", None]}, {"group_id": "g2", "gene_ids": "C"}],
    "evidence_log": {"evidence_id": "e1", "supporting_gene_ids": ["A"]},
    "mechanistic_labels": [{"label_name": "x", "evidence_ids": None}],
}
BRANCH = {"branch_id": "b0", "actor_step": {"tool_action": {"call_id": "c1", "tool_name": "t"}}, "local_score": {"total_score": 0.5}, "verifier_step": {"updated_state": STATE}}
WANT = {
    ("branch", "7", "b0"), ("tool_action", "b0", "c1"), ("local_score", "b0", "b0"), ("group", "b0", "g1"), ("group", "b0", "g2"),
    ("group_gene", "g1", "A"), ("group_gene", "g1", "B"), ("group_gene", "g2", "C"), ("evidence", "b0", "e1"), ("evidence_gene", "e1", "A"), ("label", "b0", "x"),
}


def keys(text):
    return {r[2:5] for r in nested.flatten_text(7, text, nested.Router(nested.Automaton(), nested.NAMED))}


def test_all_shapes_give_the_same_objects():
    encoded = json.loads(json.dumps(BRANCH))
    encoded["verifier_step"]["updated_state"] = json.dumps(STATE)
    twice = json.loads(json.dumps(BRANCH))
    twice["verifier_step"] = json.dumps({"updated_state": json.dumps(STATE)})
    keyed = {"b0": {k: v for k, v in BRANCH.items() if k != "branch_id"}}
    for shape in ([BRANCH], BRANCH, keyed, [encoded], [twice], [BRANCH, BRANCH], {"branches": [BRANCH]}, json.dumps([BRANCH])):
        assert keys(json.dumps(shape)) == WANT, shape


def test_unreadable_texts_give_nothing():
    for text in (None, "", "  ", json.dumps([BRANCH])[:-3], "[1, 2", "null", "3", "[]", "{}"):
        assert keys(text) == set()


def test_latest_row_counts_and_clashing_columns(spark):
    from datetime import datetime as t

    rows = [(7, json.dumps([{"branch_id": "old"}]), t(2024, 1, 1), "x"), (7, json.dumps([BRANCH]), t(2024, 2, 1), "y"), (None, json.dumps([BRANCH]), None, "z"), (8, None, None, "w")]
    df = spark.createDataFrame(rows, "pool_id bigint, branches string, received_at timestamp, entity string")
    flat = nested.flatten(df)
    assert {(r.entity, r.parent_key, r.item_key) for r in flat.collect()} == WANT
    scores = nested.subtype_table(flat, "local_score").collect()
    assert [(s.branch_id, s.total_score, s.schema_score) for s in scores] == [("b0", 0.5, None)]
    assert nested.flatten(df.limit(0)).collect() == []


def test_long_text(spark):
    many = [{"branch_id": f"b{k}", "actor_step": {"reasoning_text": "x" * 1000}} for k in range(3000)]
    df = spark.createDataFrame([(1, json.dumps(many), None)], "pool_id bigint, branches string, received_at timestamp")
    assert nested.flatten(df).count() == 3000


def test_routes_follow_states_alone():
    router = nested.Router(nested.Automaton(), nested.NAMED)
    texts = [json.dumps([BRANCH]), json.dumps([BRANCH | {"branch_id": "b1"}]), json.dumps({"b2": {k: v for k, v in BRANCH.items() if k != "branch_id"}})]
    rows = [r for t in texts for r in nested.flatten_text(7, t, router)]
    assert len(rows) == 3 * len(WANT) and {r[1] for r in rows} == {"b0", "b1", "b2"}
    # equal shapes share one compiled route; a state that fits no place is routed nowhere
    assert len({state for place, state in router.known if place == "group"}) == 1
    assert router.route("branch", router.automaton.read([1, "x", None])[0]) is None
    assert router.route("label", router.automaton.read({"a": 1})[0]) is None


def test_free_entries_get_typed_rows(spark):
    call = {"call_id": "c1", "tool_name": "t", "arguments": {"genes": ["A", None, "B"], "top_k": 4, "mode": "x", "gone": None}}
    branch = {"branch_id": "b0", "actor_step": {"tool_action": json.dumps(call)}, "local_score": {"score_metadata": {"schema_valid": "true", "weights": {"m": 0.5}}}}
    df = spark.createDataFrame([(1, json.dumps([branch]), None)], "pool_id bigint, branches string, received_at timestamp")
    flat = nested.flatten(df)
    got = {r.item_key: (r.parent_key, r.value, r.number, r.n_items) for r in nested.subtype_table(flat, "tool_argument").collect()}
    assert got == {"genes": ("c1", None, None, 3), "top_k": ("c1", "4", 4.0, None), "mode": ("c1", "x", None, None)}
    assert [(r.parent_key, r.item_key, r.position) for r in nested.subtype_table(flat, "tool_argument_item").collect()] == [("genes", "A", 0), ("genes", "B", 1)]
    assert [(r.item_key, r.number) for r in nested.subtype_table(flat, "score_weight").collect()] == [("m", 0.5)]
    assert [r.schema_valid for r in nested.subtype_table(flat, "local_score").collect()] == [True]
