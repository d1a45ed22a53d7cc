"""Answers a request: retrievers by the plan's stages, fused, ranked, paged and told as found, not_found or unknown.

Every stage is a lazy DataFrame; the only actions are one count per stage, which decides whether the next is needed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, graph, retrieval, serving
from . import planner


@dataclass
class Knowledge:
    """The current tables that a request reads."""

    entities: DataFrame
    claims: DataFrame
    files: DataFrame
    diagnostics: DataFrame


@dataclass
class Answer:
    state: str
    rows: DataFrame
    trace: list[tuple[str, str]]


def answer(k: Knowledge, request: planner.Request, budget: planner.Budget | None = None, offset: int = 0) -> Answer:
    """Rows (entity_id, evidence_id, sources, tier, confidence, best_rank), best first; stages that weren't needed are told as skipped."""
    r, b = request.normalized(), (budget or planner.Budget()).normalized()
    p = planner.plan(r)
    entities = k.entities.where(F.col("repo_id") == r.repository) if r.repository else k.entities
    conf = retrieval.with_confidence(entities, k.claims).select("entity_id", "evidence_id", "confidence")
    parts: list[DataFrame] = []
    trace: list[tuple[str, str]] = []
    # a time budget holds only if it was asked for: a batch engine's stages take longer than an interactive default
    until = time.monotonic() + b.time_ms / 1000 if budget and budget.time_ms else None
    cut = False

    def add(name: str, rank: int, ids: DataFrame) -> int:
        nonlocal cut
        if until is not None and time.monotonic() > until:
            cut = True
            trace.append((name, "skipped_time_budget"))
            return 0
        rows = conf.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").withColumn("source", F.lit(name)).withColumn("rank", F.lit(rank))
        n = rows.limit(b.candidates + 1).count()
        trace.append((name, "selected" if n else "insufficient"))
        if n:
            parts.append(rows)
        return n

    exact = retrieval.exact(entities, k.claims, r.text)
    found = add("exact", 0, exact) if r.intent not in ("text_search", "path_finding") else 0
    if r.intent == "text_search" or (r.intent == "lookup" and found != 1):
        text = entities.select("entity_id", F.concat_ws(" ", "label", "kind", "path").alias("text"))
        found += add("lexical", 1, retrieval.bm25(text, "entity_id", "text", " ".join(planner.search_term(r.text).lower().split())))
    else:
        trace.append(("lexical", "skipped_unique_exact"))
    if p.strategy == "graph" and found:
        seeds = exact.orderBy("entity_id").select(F.col("entity_id").alias("node"))
        walked = graph.reach(seeds, graph.edges(k.claims, r.direction or "both", r.relationship_types), b.depth).where("depth > 0")
        found += add("graph", 2, walked.select(F.col("node").alias("entity_id")))
    node = lambda x: entities.where(F.col("entity_id") == x).select(F.col("entity_id").alias("node"))
    if p.strategy == "path":
        way = serving.trails(node(r.start), k.entities.where(F.col("entity_id") == r.goal).select(F.col("entity_id").alias("node")), graph.edges(k.claims), b.depth, 10)
        found += add("path", 2, way.select(F.explode(F.array("start", "goal")).alias("entity_id")))
    elif p.strategy == "architecture_slice":
        kind = planner.slice_kind(r.text) or "entity_neighbourhood"
        found += add("architecture_slice", 2, graph.slice_of(node(r.anchor), k.claims, kind, b.depth).select(F.col("node").alias("entity_id")))
    if not found and r.text and p.strategy != "path":
        found += add("structural", 3, retrieval.structural(entities, k.claims, r.text))
    rows = retrieval.fuse(_union(parts, conf))
    ranked = rows.orderBy("tier", F.desc("confidence"), "best_rank", "entity_id", "evidence_id").offset(offset).limit(b.results)
    files = k.files.withColumns(coverage.told())
    basis = coverage.basis(files.where(F.col("repo_id") == r.repository) if r.repository else files, k.diagnostics)
    complete = bool(basis.agg(F.coalesce(F.min("complete"), F.lit(False))).first()[0])
    state = ("unknown" if cut else "found") if found else "not_found" if complete and not cut else "unknown"
    return Answer(state, ranked, trace)


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like.limit(0).withColumn("source", F.lit("")).withColumn("rank", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
