import json

from strandloom.operators import nested


def test_states_tell_shapes_apart():
    state = nested.Automaton().state
    assert state({"a": 1}) != state({"a": "1"}) and state({"a": 1}) != state({"b": 1})
    assert state({"a": 1, "b": "x"}) == state({"b": "y", "a": 2})
    assert state([{"a": 1}]) != state([{"a": "x"}])


def test_text_scores_and_metadata_reach_the_typed_table(spark):
    scores = [{"total_score": 0.5}, {"total_score": " 0.6805 ", "score_metadata": {"w": 1}}, {"total_score": "n/a"}]
    text = json.dumps([{"branch_id": f"b{k}", "local_score": v, "verifier_step": {"updated_state": {"remaining_budget": ["3", 4.0, None][k]}}} for k, v in enumerate(scores)])
    flat = nested.flatten(spark.createDataFrame([(1, text, None)], "pool_id bigint, branches string, received_at timestamp"))
    got = {r.branch_id: r for r in nested.subtype_table(flat, "local_score").collect()}
    assert {k: r.total_score for k, r in got.items()} == {"b0": 0.5, "b1": 0.6805, "b2": None}
    assert len({r.variant for r in got.values()}) == 3
    assert {r.branch_id: r.remaining_budget for r in nested.subtype_table(flat, "branch").collect()} == {"b0": 3, "b1": 4, "b2": None}
