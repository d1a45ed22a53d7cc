"""Request planning: budgets, features of a question, its family and intent, and the stages that answer it. Pure Python.

Everything is told by tables: the first row of a table that applies decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# Limits: (default, most) (fixed values).
LIMITS = {"time_ms": (250, 1000), "candidates": (100, 500), "entities": (100, 500), "edges": (100, 500), "depth": (3, 4), "results": (20, 100)}
MAX_TEXT_BYTES = 256
FIELDS = ("configuration", "documentation", "logs_errors", "path", "source", "strings", "symbol")
DIRECTIONS = ("in", "out", "both")

# Words that show a feature of a question (fixed values).
TERMS = {
    "event": ("event", "topic", "queue", "kafka", "jms", "message"),
    "route": ("route", "endpoint", "http", "get ", "post ", "put ", "patch ", "delete "),
    "configuration": ("config", "configuration", "property", "properties", "environment", "env", "setting"),
    "caller": ("caller", "callers", "reference", "references", "called by"),
    "consumer": ("consumer", "consumes", "listener", "subscribes"),
    "impact": ("impact", "affected", "depend", "dependents"),
    "cause": ("cause", "why", "error", "exception", "failure", "log"),
    "update": ("where update", "where is update", "change", "update"),
}
# Words of a negation and what it is about (fixed values).
NEGATION = (("not found", "does not", "doesn't", "no caller", "no consumer", "any "), ("exist", "found", "caller", "consumer", "reference", "route"))
# Words that name a kind of slice (fixed values).
SLICE_TERMS = {
    "repository_service_overview": ("repository overview", "service overview"), "service_boundary": ("service boundary",), "contract_api_surface": ("contract surface", "api surface"), "event_topic_flow": ("event flow", "topic flow"), "http_route_client_flow": ("http flow", "route flow", "client flow"),
    "configuration_boundary": ("configuration boundary",), "dependency_boundary": ("dependency boundary",), "test_to_feature": ("test to feature", "test-to-feature"), "entity_neighbourhood": ("entity neighbourhood", "entity neighborhood"),
}
# Precedence of families (fixed values): (features of which one must hold, family, predicates to follow, direction, depth or None for the budget's).
FAMILIES: tuple[tuple[tuple[str, ...], str, tuple[str, ...] | None, str, int | None], ...] = (
    (("negative",), "negative_verification", None, "", None),
    (("impact",), "impact", (), "in", None),
    (("caller", "consumer"), "caller_reference", ("CALLS", "REFERENCES"), "in", None),
    (("cause",), "explain_cause", ("HAS_LOCAL_GUARD", "EMITS_LOG", "EMITS_ERROR", "COVERAGE_GAP"), "both", 1),
    (("event",), "event_trace", ("PUBLISHES_EVENT", "CONSUMES_EVENT", "PRODUCES_TOPIC", "CONSUMES_TOPIC", "SENDS_QUEUE", "LISTENS_QUEUE"), "both", None),
    (("route",), "route_trace", ("DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_UI_ROUTE", "INVOKES_API"), "both", None),
    (("configuration",), "configuration_lookup", ("DEFINES_CONFIGURATION", "REFERENCES_CONFIGURATION", "BINDS_CONFIGURATION"), "both", None),
    (("update",), "locate_change", None, "", None),
)
# Features to intents, the first that applies (fixed values).
INTENTS = (("negative", "negative_verification"), ("impact", "impact"), ("consumer", "consumers"), ("caller", "producers"), ("cause", "explain_cause"), ("event", "event_trace"), ("route", "route_trace"), ("configuration", "configuration_lookup"), ("update", "references"))
GRAPH_INTENTS = frozenset("relationship_traversal impact producers consumers event_trace route_trace configuration_lookup references explain_cause".split())
# Stages of an intent (fixed values): (strategy, reason).
STAGES = {
    "text_search": (("lexical", "explicit_text_search"),), "path_finding": (("path", "explicit_path_finding"),), "architecture_slice": (("exact", "resolve_slice_anchor"), ("architecture_slice", "explicit_architecture_slice")),
    "negative_verification": (("exact", "negative_verification_exact"), ("lexical", "exact_insufficient"), ("graph", "relationship_scope_requires_graph")), "lookup": (("exact", "cheapest_unique_identifier_route"), ("lexical", "exact_absent_or_ambiguous")),
    **{i: (("exact", "resolve_graph_anchor"), ("graph", "explicit_relationship_capability")) for i in GRAPH_INTENTS},
}
STRATEGIES = {"text_search": "lexical", "path_finding": "path", "architecture_slice": "architecture_slice", "negative_verification": "exact", "lookup": "exact", **{i: "graph" for i in GRAPH_INTENTS}}
PRECEDENCE = ("exact", "lexical", "graph", "structural", "path", "vector")

# What looks like an identifier and like a path (fixed values).
_NAME = re.compile(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\b", re.A)
_PATH = re.compile(r"(?:^|\s)(?:[\w.-]+/)+[\w.-]+|\B/[\w{}./-]+", re.A)


@dataclass(frozen=True)
class Budget:
    time_ms: int = 0
    candidates: int = 0
    entities: int = 0
    edges: int = 0
    depth: int = 0
    results: int = 0

    def normalized(self) -> Budget:
        """Defaults for zeros; ValueError beyond the limits."""
        values = {k: getattr(self, k) or default for k, (default, _) in LIMITS.items()}
        for k, v in values.items():
            if not 1 <= v <= LIMITS[k][1]:
                raise ValueError(f"{k} must be between 1 and {LIMITS[k][1]}")
        return Budget(**values)


def features(text: str) -> frozenset[str]:
    """What a question shows."""
    low = text.lower()
    got = {k for k, terms in TERMS.items() if any(t in low for t in terms)}
    if "/" in text:
        got.add("route")
    if all(any(t in low for t in terms) for terms in NEGATION):
        got.add("negative")
    if text.count('"') >= 2 or text.count("'") >= 2:
        got.add("quoted")
    if _PATH.search(text):
        got.add("path")
    if _NAME.search(text) and (set(text) & set("_.") or any("A" <= c <= "Z" for c in text)):
        got.add("identifier")
    return frozenset(got)


def family(text: str) -> str:
    f = features(text)
    return next((name for any_, name, *_ in FAMILIES if f & set(any_)), "exact_lookup")


def intent(text: str) -> str:
    f = features(text)
    return next((i for feature, i in INTENTS if feature in f), "lookup")


def slice_kind(text: str) -> str | None:
    low = text.lower()
    return next((k for k, terms in SLICE_TERMS.items() if any(t in low for t in terms)), None)


@dataclass(frozen=True)
class Request:
    text: str = ""
    repository: str = ""
    version: str = ""
    anchor: str = ""
    start: str = ""
    goal: str = ""
    intent: str = ""
    relationship_types: tuple[str, ...] = ()
    direction: str = ""
    inferred: bool = False

    def normalized(self) -> Request:
        """Trimmed and completed; ValueError if it can't be answered."""
        r = replace(self, **{k: getattr(self, k).strip() for k in ("text", "repository", "version", "anchor", "start", "goal")}, direction=self.direction.strip().lower(), relationship_types=tuple(sorted({t.strip().upper() for t in self.relationship_types})))
        if r.direction and r.direction not in DIRECTIONS:
            raise ValueError("direction must be in, out, or both")
        if "" in r.relationship_types:
            raise ValueError("relationship type is required")
        if len(r.text.encode()) > MAX_TEXT_BYTES:
            raise ValueError("query text is too long")
        if not r.intent:
            r = replace(r, intent=intent(r.text), inferred=True)
        if r.intent not in STAGES:
            raise ValueError(f"unsupported query intent {r.intent!r}")
        if not (r.text or r.anchor or r.start):
            raise ValueError("query text or anchor is required")
        if r.intent == "path_finding" and not (r.start and r.goal):
            raise ValueError("path_finding requires from and to entity handles")
        if r.intent == "architecture_slice" and not r.anchor:
            raise ValueError("architecture_slice requires an anchor")
        return r


@dataclass(frozen=True)
class Plan:
    intent: str
    strategy: str
    inferred: bool
    stages: tuple[tuple[str, str], ...]
    precedence: tuple[str, ...] = PRECEDENCE


def plan(request: Request) -> Plan:
    r = request.normalized()
    return Plan(r.intent, STRATEGIES[r.intent], r.inferred, STAGES[r.intent])


@dataclass(frozen=True)
class Node:
    """An operator of the retrieval algebra; it describes an answer, execution follows the plan's stages."""

    operator: str
    text: str = ""
    fields: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    direction: str = ""
    depth: int = 0
    inputs: tuple[Node, ...] = field(default_factory=tuple)

    def validate(self, budget: Budget) -> None:
        if self.operator in ("exact", "lexical", "resolve") and not self.text:
            raise ValueError(f"{self.operator} needs a text")
        if self.operator in ("union", "intersect") and len(self.inputs) < 2:
            raise ValueError(f"{self.operator} needs two inputs")
        if self.operator in ("filter", "rank", "fetch", "explain") and len(self.inputs) != 1:
            raise ValueError(f"{self.operator} needs one input")
        if self.operator == "traverse" and (self.direction not in DIRECTIONS or not 1 <= self.depth <= budget.depth):
            raise ValueError("traverse is out of bounds")
        if set(self.fields) - set(FIELDS):
            raise ValueError("unknown field")
        for x in self.inputs:
            x.validate(budget)


def algebra(text: str, budget: Budget | None = None) -> tuple[str, Node]:
    """The family of a question and its expression."""
    b = (budget or Budget()).normalized()
    name = family(text)
    sources = [Node("exact", text), Node("lexical", text, FIELDS)]
    row = next((r for r in FAMILIES if r[1] == name), None)
    if row and row[2] is not None:
        sources.append(Node("traverse", predicates=row[2], direction=row[3], depth=row[4] or b.depth))
    root = Node("explain", inputs=(Node("fetch", inputs=(Node("rank", inputs=(Node("union", inputs=tuple(sources)),)),)),))
    root.validate(b)
    return name, root


def search_term(question: str) -> str:
    """The first word that looks like code, else the whole question."""
    for w in question.split():
        w = w.strip(".,;:!?\"'()[]{}`")
        if any(c in w for c in "_./") or any("A" <= c <= "Z" for c in w[1:]):
            return w
    return question.strip()
