"""Closed vocabularies as column expressions: languages, endpoint kinds, cross-repository identities and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language (fixed values).
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python",
    ".md": "documentation", ".adoc": "documentation", ".rst": "documentation", ".txt": "documentation", ".json": "configuration", ".yaml": "configuration", ".yml": "configuration", ".properties": "configuration", ".xml": "configuration", ".toml": "configuration", ".gradle": "configuration",
}
# Languages with structure, predicates of providers and of consumers, methods, kinds of identities and of links (fixed values).
STRUCTURAL = ("java", "kotlin", "typescript", "tsx", "javascript", "jsx")
PROVIDERS = ("PUBLISHES_EVENT", "PRODUCES_TOPIC", "SENDS_QUEUE", "DEFINES_CONFIGURATION", "DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_MODULE")
CONSUMERS = ("CONSUMES_EVENT", "LISTENS_EVENT", "SUBSCRIBES_EVENT", "CONSUMES_TOPIC", "LISTENS_QUEUE", "REFERENCES_CONFIGURATION", "BINDS_CONFIGURATION", "INVOKES_API", "DEPENDENCY_DECLARATION")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
IDENTITY_KINDS = {
    "event": ("PUBLISHES_EVENT", "CONSUMES_EVENT", "LISTENS_EVENT", "SUBSCRIBES_EVENT"), "topic": ("PRODUCES_TOPIC", "CONSUMES_TOPIC"), "queue": ("SENDS_QUEUE", "LISTENS_QUEUE"), "http_endpoint": ("DECLARES_EFFECTIVE_ENDPOINT", "INVOKES_API"),
    "configuration": ("DEFINES_CONFIGURATION", "REFERENCES_CONFIGURATION", "BINDS_CONFIGURATION"), "dependency": ("DEPENDENCY_DECLARATION", "DECLARES_MODULE"), "schema": ("ALIASES_SCHEMA",),
}
LINKS = {"event": "EVENT_PRODUCER_CONSUMER", "topic": "EVENT_PRODUCER_CONSUMER", "queue": "EVENT_PRODUCER_CONSUMER", "http_endpoint": "HTTP_CLIENT_ROUTE", "configuration": "CONFIGURATION_DEFINITION_CONSUMER", "dependency": "DEPENDENCY_LOCAL_MODULE"}


def choose(key: Column, table: dict[str, str], other: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[key], F.lit(other))


def language_of(path: Column) -> Column:
    """Language by extension, 'text' for others; null for a null path."""
    return F.when(path.isNotNull(), choose(F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)), LANGUAGES, "text"))


def classification_of(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(md|adoc|txt|rst)$"), "documentation").otherwise("source")


def endpoint_kind(predicate: Column) -> Column:
    """Kind of the nodes at either end of a claim; the order of the tests matters."""
    p = F.upper(predicate)
    return (
        F.when(p.isin("DEFINES_CONFIGURATION", "REFERENCES_CONFIGURATION"), "configuration_key").when(p == "HAS_LOCAL_GUARD", "local_syntax_guard").when(p == "COVERAGE_GAP", "coverage_diagnostic")
        .when(p.contains("ROUTE") | p.contains("ENDPOINT"), "route").when(p.contains("EVENT") | p.contains("TOPIC") | p.contains("QUEUE"), "message_channel").when(p.contains("EMITS_LOG") | p.contains("EMITS_ERROR"), "emission_site").otherwise("reference")
    )


def identity_kind(predicate: Column) -> Column:
    return choose(F.upper(predicate), {p: k for k, ps in IDENTITY_KINDS.items() for p in ps}, "")


def normalized_identity(predicate: Column, label: Column) -> Column:
    """What two labels must share to be the same thing in two repositories; null if the label names none."""
    kind, t = identity_kind(predicate), F.trim(label)
    parts = F.split(t, r"\s+")
    verb, path = F.upper(parts[0]), F.try_element_at(parts, F.lit(2))
    http = F.when((F.size(parts) == 2) & verb.isin(*VERBS) & path.startswith("/"), F.concat_ws(" ", verb, F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))))
    dots = F.array_join(F.filter(F.split(F.lower(F.translate(t, "_-", "..")), r"\."), lambda x: x != ""), ".")
    out = F.when(kind.isin("event", "schema"), t).when(kind.isin("topic", "queue", "dependency"), F.lower(t)).when(kind == "http_endpoint", http).when(kind == "configuration", dots)
    return F.when(out != "", out)


def role(predicate: Column) -> Column:
    p = F.upper(predicate)
    return F.when(p.isin(*PROVIDERS), "provider").when(p.isin(*CONSUMERS), "consumer").otherwise("")


def link_predicate(kind: Column) -> Column:
    return choose(kind, LINKS, "CROSS_REPOSITORY_LINK")
