"""What an answering service needs beside retrieval: fielded documents, orders and pages, bounded walks and trails, scopes, coverage,
projections and maintenance views.

Orders are total; nulls never match; empty tables give no rows; fan-outs, pages and packages are bounded because that is what
they are, and tell whether they were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..session import id_key
from .retrieval import tokens

# Fields of a document in the order of their rank (fixed values).
FIELDS = ("symbol", "path", "configuration", "documentation", "strings", "logs_errors", "source")
MATCH_RANK = {"exact_identifier": 0, "exact_path": 1, "literal": 2, "exact_protocol_config": 3}
FIELD_OF = {"exact_identifier": "symbol", "exact_path": "path", "exact_protocol_config": "configuration", "literal": "source", "lexical": "strings"}


def fielded(files: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, evidence_id, generation_id, repo_id, FIELDS): the document of each entity with evidence in a file. A file's is its
    content, any other's its excerpt; the classification decides which fields hold it, and a text that speaks of errors is a log too."""
    e = entities.select("entity_id", "kind", "label", id_key("evidence_id").alias("_v")).where("_v is not null")
    v = evidence.select(id_key("evidence_id").alias("_v"), "evidence_id", "source_id", "excerpt")
    f = files.select("source_id", "generation_id", "repo_id", "path", "classification", "content")
    # a content is needed only where a file's own entity asks for it
    rows = e.join(v, "_v").join(f, "source_id")
    text = F.coalesce(F.when(F.col("kind") == "file", F.col("content")).otherwise(F.col("excerpt")), F.lit(""))
    rows = rows.withColumn("t", text)
    cls = F.coalesce("classification", F.lit(""))
    conf = F.concat(F.when(cls == "configuration", F.col("t")).otherwise(""), F.when(F.col("kind") == "configuration_key", F.concat(F.lit(" "), "label")).otherwise(""))
    logs = F.when(cls.isin("log", "logs", "error") | F.contains(F.lower("t"), F.lit("error")), F.col("t")).otherwise("")
    return rows.select("entity_id", "evidence_id", "generation_id", "repo_id", F.col("label").alias("symbol"), "path", conf.alias("configuration"), F.when(cls == "documentation", F.col("t")).otherwise("").alias("documentation"), F.col("t").alias("strings"), logs.alias("logs_errors"), F.col("t").alias("source"))


def search_fields(documents: DataFrame, phrase: str, fields: tuple[str, ...] = FIELDS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(entity_id, evidence_id, field, fields, hits, score): documents that hold the phrase within one of the fields. Each field is a phrase
    of its own with its own rarity; the length is that of the whole document; less is better. ``field`` is the first that holds it."""
    words = [w for w in phrase.lower().split() if w]
    needle = " " + "  ".join(words) + " "
    toks = {c: tokens(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS}
    joined = {c: F.concat(F.lit(" "), F.array_join(F.col(f"t_{c}"), "  "), F.lit(" ")) for c in fields}
    rows = documents.select("entity_id", "evidence_id", *[t.alias(f"t_{c}") for c, t in toks.items()])
    hits = {c: ((F.length(j) - F.length(F.replace(j, F.lit(needle), F.lit("")))) / len(needle)).cast("long") for c, j in joined.items()}
    size = sum((F.size(f"t_{c}") for c in FIELDS[1:]), F.size(f"t_{FIELDS[0]}"))
    rows = rows.select("entity_id", "evidence_id", size.cast("double").alias("len"), *[h.alias(c) for c, h in hits.items()])
    corpus = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(c) > 0, 1)).cast("double").alias(f"df_{c}") for c in fields])

    def part(c: str) -> Column:
        f = F.col(c).cast("double")
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5)), F.lit(1e-6))
        return F.when(F.col(c) > 0, -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))).otherwise(0.0)

    score = sum((part(c) for c in fields[1:]), part(fields[0]))
    total = sum((F.col(c) for c in fields[1:]), F.col(fields[0]))
    held = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    out = rows.join(F.broadcast(corpus)).select("entity_id", "evidence_id", held.alias("h"), total.alias("hits"), F.round(score, 6).alias("score")).where("hits > 0")
    return out.select("entity_id", "evidence_id", F.col("h")[0].alias("field"), F.array_join("h", ",").alias("fields"), "hits", "score")


def retrieve_order(rows: DataFrame) -> list[Column]:
    """The order of retrieval: rank of the match, rank of the field, confidence, places."""
    match = F.coalesce(labels.choose(F.col("match_type"), {k: str(v) for k, v in MATCH_RANK.items()}, "4").cast("int"), F.lit(4))
    field = labels.choose(labels.choose(F.col("match_type"), FIELD_OF, ""), {f: str(i) for i, f in enumerate(FIELDS)}, "99").cast("int")
    return [match, field, F.desc("confidence"), F.col("repo_id"), F.col("path"), F.col("entity_id")]


def ranked_claims(along: DataFrame, fanout: int) -> DataFrame:
    """(src, dst, claim_id, key, more): the first claims of each node in the order of travel, and whether the node has more."""
    key = F.concat("predicate", "subject_id", "object_id", "claim_id")
    w = Window.partitionBy("src").orderBy("key", "dst")
    rows = along.withColumn("key", key).withColumn("n", F.row_number().over(w)).where(F.col("n") <= fanout + 1)
    rows = rows.withColumn("more", F.max("n").over(Window.partitionBy("src")) > fanout)
    return rows.where(F.col("n") <= fanout).select("src", "dst", "claim_id", "key", "more")


def walk(seeds: DataFrame, top: DataFrame, depth: int, budget: int) -> DataFrame:
    """(seed, claim_id, depth, truncated): what a walk of each seed (column node) tells, level by level, at most `budget` claims; cut if a
    node on the way had more claims than its fan-out, or the walk more than its budget."""
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen, found = front, None
    for d in range(1, depth + 1):
        step = front.join(top, F.col("node") == F.col("src")).select("seed", "dst", "claim_id", "key", "more", F.lit(d).alias("depth"))
        found = step if found is None else found.unionByName(step)
        if d < depth:
            front = step.select("seed", F.col("dst").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
            seen = seen.unionByName(front)
    per = found.groupBy("seed", "claim_id").agg(F.min(F.struct("depth", "key")).alias("v"), F.max("more").alias("more"))
    w = Window.partitionBy("seed")
    rows = per.select("seed", "claim_id", "v.depth", F.row_number().over(w.orderBy("v.depth", "v.key", "claim_id")).alias("n"), (F.max("more").over(w) | (F.count("*").over(w) > budget)).alias("truncated"))
    return rows.where(F.col("n") <= budget).select("seed", "claim_id", "depth", "truncated")


def trails(starts: DataFrame, goals: DataFrame, along: DataFrame, depth: int, most: int) -> DataFrame:
    """(start, goal, hops, trail): up to `most` paths from each start to each goal, shortest first. A node on the way is visited once for a
    start, by its least trail, so several paths of a pair differ in their last step."""
    e = along.groupBy("src", "dst").agg(F.min("claim_id").alias("claim_id"))
    target = goals.select(F.col("node").alias("goal")).distinct()
    front = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("trail", F.array().cast("array<string>"))
    seen, out = front.select("start", "node"), None
    for d in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("trail", F.array("claim_id")).alias("trail"))
        hit = step.join(target, F.col("node") == F.col("goal")).where("start <> goal").select("start", "goal", F.lit(d).alias("hops"), "trail")
        out = hit if out is None else out.unionByName(hit)
        if d < depth:
            front = step.groupBy("start", "node").agg(F.min("trail").alias("trail")).join(seen, ["start", "node"], "left_anti")
            seen = seen.unionByName(front.select("start", "node"))
    w = Window.partitionBy("start", "goal").orderBy("hops", "trail")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("start", "goal", "hops", F.array_join("trail", ">").alias("trail"))


def both_ends(claims: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """Counts of claims by the scope that both of their ends lie in."""
    side = lambda c, p: entities.select(F.col("entity_id").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in by])
    rows = claims.select("claim_id", "subject_id", "object_id").join(side("subject_id", "s"), "subject_id").join(side("object_id", "o"), "object_id")
    for x in by:
        rows = rows.where(F.col(f"s_{x}") == F.col(f"o_{x}"))
    return rows.groupBy(*[F.col(f"s_{x}").alias(x) for x in by]).agg(F.count("*").alias("claims"))


def drilldown(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(level, repo_id, path, entities, claims): repositories and their files, claims only where both ends lie in the scope."""
    per_file = entities.groupBy("repo_id", "path").agg(F.count("*").alias("entities")).join(both_ends(claims, entities, ["repo_id", "path"]), ["repo_id", "path"], "left")
    per_repo = entities.groupBy("repo_id").agg(F.count("*").alias("entities")).join(both_ends(claims, entities, ["repo_id"]), "repo_id", "left")
    n = F.coalesce("claims", F.lit(0)).alias("claims")
    return per_file.select(F.lit("file").alias("level"), "repo_id", F.coalesce("path", F.lit("")).alias("path"), "entities", n).unionByName(per_repo.select(F.lit("repository").alias("level"), "repo_id", F.lit("").alias("path"), "entities", n))


def projection_of(capability: Column) -> Column:
    """The projection that a capability reads (fixed values)."""
    return labels.choose(capability, {"exact": "lookup", "structural": "graph", "path": "graph"}, "lexical")


def completeness(state: Column, truncated: Column) -> Column:
    """How far an answer reaches."""
    return F.when(truncated, "bounded").when(state == "unknown", "unavailable").otherwise("complete")


def same_rows(a: DataFrame, b: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, equal): whether both have the same rows of each key, as often; keys of either side."""
    count = lambda df, s: df.groupBy(by, *columns).agg(F.sum(F.lit(s)).alias("n"))
    net = count(a, 1).unionByName(count(b, -1)).groupBy(by, *columns).agg(F.sum("n").alias("n"))
    return net.groupBy(by).agg((F.max(F.abs("n")) == 0).alias("equal"))


def vector_text(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, text): what is embedded of an entity: label, kind, identity and excerpt, white space collapsed."""
    v = evidence.select(id_key("evidence_id").alias("_v"), "excerpt")
    rows = entities.select("entity_id", "label", "kind", "identity", id_key("evidence_id").alias("_v")).join(v, "_v", "left")
    return rows.select("entity_id", F.trim(F.regexp_replace(F.concat_ws(" ", "label", "kind", "identity", "excerpt"), r"[ \t\r\n]+", " ")).alias("text"))


def context_order() -> list[Column]:
    """Order of relationships in a package: role, confidence, ends."""
    role = F.when(labels.role(F.col("predicate")) == "provider", 0).when(labels.role(F.col("predicate")) == "consumer", 1).otherwise(2)
    return [role, F.desc("confidence"), F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("claim_id")]
