"""Graph operators over claims (edges) and entities (nodes).

Traversals are loops over frontiers of a fixed depth; each level is a join with the edges and an anti-join with what was seen,
nothing is collected. Claims with a null end are no edges; repeated claims count once; a start that isn't there reaches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import undirected

# Relation names to (predicate, direction) (fixed values).
RELATIONS = {
    "callers": ("CALLS", "in"), "callees": ("CALLS", "out"), "references": ("REFERENCES", "both"), "definitions": ("DECLARES", "in"), "implementations": ("IMPLEMENTS", "in"), "imports": ("IMPORTS", "out"), "exports": ("EXPORTS", "out"), "inheritance": ("EXTENDS", "out"), "aliases": ("ALIASES", "out"),
    "modules": ("DECLARES_MODULE", "out"), "routes": ("DECLARES_EFFECTIVE_ENDPOINT", "out"), "http_calls": ("INVOKES_API", "out"), "event_publications": ("PUBLISHES_EVENT", "out"), "event_subscriptions": ("SUBSCRIBES_EVENT", "out"), "log_emissions": ("EMITS_LOG", "out"), "error_emissions": ("EMITS_ERROR", "out"),
    "local_guards": ("HAS_LOCAL_GUARD", "out"), "configuration_consumers": ("REFERENCES_CONFIGURATION", "in"), "configuration_definitions": ("DEFINES_CONFIGURATION", "in"),
}
# Predicates that a slice follows, and its direction (fixed values).
SLICES = {
    "event_topic_flow": (("PUBLISHES_EVENT", "CONSUMES_EVENT", "PRODUCES_TOPIC", "CONSUMES_TOPIC", "SENDS_QUEUE", "LISTENS_QUEUE"), "both"), "http_route_client_flow": (("DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_ENDPOINT", "DECLARES_UI_ROUTE", "INVOKES_API"), "both"), "contract_api_surface": (("DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_ENDPOINT", "DECLARES_UI_ROUTE", "INVOKES_API"), "both"),
    "configuration_boundary": (("DEFINES_CONFIGURATION", "REFERENCES_CONFIGURATION", "BINDS_CONFIGURATION"), "both"), "dependency_boundary": (("IMPORTS", "DEPENDS_ON", "REFERENCES", "CALLS"), "both"), "test_to_feature": (("TESTS", "CALLS", "REFERENCES"), "both"), "impact": ((), "in"),
    "service_boundary": (("CALLS", "INVOKES_API", "PUBLISHES_EVENT", "CONSUMES_EVENT", "IMPORTS"), "both"), "repository_service_overview": ((), "both"), "entity_neighbourhood": ((), "both"),
}


def edges(claims: DataFrame, direction: str = "both", predicates: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, predicate, claim_id) in the direction of travel."""
    c = claims.where(F.upper("predicate").isin([p.upper() for p in predicates])) if predicates else claims
    if direction == "both":
        return undirected(c)
    a, b = ("subject_id", "object_id") if direction == "out" else ("object_id", "subject_id")
    return c.where("subject_id is not null and object_id is not null").select(F.col(a).alias("src"), F.col(b).alias("dst"), "predicate", "claim_id")


def reach(seeds: DataFrame, along: DataFrame, depth: int) -> DataFrame:
    """(node, depth): least depth at which each node is reached from the seeds (column node), the seeds at 0."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be between 1 and 4")
    pairs = along.select("src", "dst").distinct()
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen.select("node")
    for d in range(1, depth + 1):
        front = front.withColumnRenamed("node", "src").join(pairs, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def neighbours(seeds: DataFrame, along: DataFrame, fanout: int) -> DataFrame:
    """(src, dst, predicate, claim_id): the first edges of each seed in claim order, at most `fanout` each."""
    w = Window.partitionBy("src").orderBy("predicate", "dst", "claim_id")
    hit = along.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= fanout).drop("n")


def shortest_paths(starts: DataFrame, goals: DataFrame, along: DataFrame, depth: int = 3) -> DataFrame:
    """(start, goal, hops): length of the shortest path from each start to each goal it reaches within the depth."""
    pairs = along.select("src", "dst").distinct()
    seen = starts.select(F.col("node").alias("start"), F.col("node").alias("node")).distinct().withColumn("hops", F.lit(0))
    front = seen.select("start", "node")
    for d in range(1, depth + 1):
        front = front.join(pairs, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("hops", F.lit(d)))
    return seen.join(goals.select("node").distinct(), "node", "left_semi").where("hops > 0").select("start", F.col("node").alias("goal"), "hops")


def slice_of(anchors: DataFrame, claims: DataFrame, kind: str, depth: int = 2) -> DataFrame:
    """(node, depth) of an architecture slice of a kind around the anchors."""
    predicates, direction = SLICES[kind]
    return reach(anchors, edges(claims, direction, predicates), depth)


def visible(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """The claims whose both ends are among the nodes (column node)."""
    n = nodes.select("node").distinct()
    return claims.join(n.withColumnRenamed("node", "subject_id"), "subject_id", "left_semi").join(n.withColumnRenamed("node", "object_id"), "object_id", "left_semi")
