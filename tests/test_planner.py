import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarryframe.functions import ids
from quarryframe.operators.history import backoff_seconds
from quarryframe.plans import planner as P


def test_families():
    for text, name in {
        "what is affected by Orders": "impact", "callers of save": "caller_reference", "why does login fail": "explain_cause", "who sends OrderChanged topic": "event_trace", "GET /api/v1/customers": "route_trace",
        "which settings": "configuration_lookup", "where is update of x": "locate_change", "UserDirectory": "exact_lookup", "does not have any caller": "negative_verification",
    }.items():
        assert P.family(text) == name, text


def test_budget_limits():
    assert P.Budget().normalized() == P.Budget(250, 100, 100, 100, 3, 20)
    for bad in (P.Budget(depth=5), P.Budget(results=101), P.Budget(time_ms=-1)):
        with pytest.raises(ValueError):
            bad.normalized()


def test_requests():
    r = P.Request(text="  who consumes X ", relationship_types=(" calls ", "CALLS")).normalized()
    assert (r.intent, r.inferred, r.relationship_types) == ("consumers", True, ("CALLS",))
    assert P.plan(r).strategy == "graph"
    for bad in (P.Request(), P.Request(text="x", direction="up"), P.Request(text="x", intent="nope"), P.Request(text="x", intent="path_finding"), P.Request(text="x", intent="architecture_slice"), P.Request(text="x" * 300), P.Request(text="x", relationship_types=(" ",))):
        with pytest.raises(ValueError):
            bad.normalized()


def test_algebra_shape():
    name, root = P.algebra("topic OrderChanged")
    union = root.inputs[0].inputs[0].inputs[0]
    assert name == "event_trace" and [x.operator for x in union.inputs] == ["exact", "lexical", "traverse"]
    with pytest.raises(ValueError):
        P.Node("union", inputs=(P.Node("exact", "x"),)).validate(P.Budget().normalized())


@given(st.text(max_size=60))
def test_every_text_has_a_family_and_an_intent(text):
    assert P.family(text) and P.intent(text) in P.STAGES


def test_cursors_and_handles_are_bound():
    c = ids.write_cursor("s", "f", 20)
    assert ids.read_cursor(c, "s", "f") == 20
    with pytest.raises(ValueError):
        ids.read_cursor(c, "t", "f")


def test_search_term_and_slices():
    assert P.search_term("where is save_order, please") == "save_order"
    assert P.slice_kind("show the event flow") == "event_topic_flow" and P.slice_kind("x") is None


def test_backoff():
    assert [backoff_seconds(n) for n in (1, 2, 3, 4, 5)] == [30, 60, 120, 240, None]
