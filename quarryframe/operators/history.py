"""Versions and incremental maintenance: fingerprints, queues, retention, lifecycles, landmarks, rollups and windows of lines.

Nulls never match; ties are broken by ids; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..session import id_key


def fingerprint(active: DataFrame) -> DataFrame:
    """One row: the digest of the sorted active generations, and how many there are (one per repository)."""
    return active.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("generation_id")), ","), 256).alias("fingerprint"), F.countDistinct("generation_id").alias("generations"))


def last_states(events: DataFrame, key: str, time: str, state: str, tie: str) -> DataFrame:
    """(key, state, at, events): the last state of each queue."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(state).alias("s"))).alias("v"), F.count("*").alias("events")).select(key, F.col("v.s").alias("state"), F.col("v.t").alias("at"), "events")


def first_events(events: DataFrame, parts: list[str], tie: str) -> DataFrame:
    """Idempotent insert: of events with the same parts the first by tie-breaker, with the event's digest."""
    return events.groupBy(*parts).agg(F.min(tie).alias(tie), F.count("*").alias("copies")).withColumn("event_digest", digest(*parts))


def debounced(events: DataFrame, key: str, time: str, quiet_s: int, longest_s: int) -> DataFrame:
    """(key, first, last, events, capped): bursts of events that are at most `quiet_s` apart; a burst longer than `longest_s` is told as capped."""
    w = Window.partitionBy(key).orderBy(time)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, us.alias("us")).withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) > quiet_s * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("burst", F.sum("new").over(w))
    out = rows.groupBy(key, "burst").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"), ((F.max("us") - F.min("us")) > longest_s * 1_000_000).alias("capped"))
    return out.drop("burst")


def backoff_seconds(attempt: int, base: int = 30, cap: int = 900, attempts: int = 5) -> int | None:
    """Seconds to wait before the next attempt; None when attempts are used up."""
    return None if attempt >= attempts else min(cap, base * 2 ** (attempt - 1))


def backoff(rows: DataFrame, attempt: str, base: int = 30, cap: int = 900, attempts: int = 5) -> DataFrame:
    a = F.col(attempt)
    return rows.withColumn("wait_s", F.when(a < attempts, F.least(F.lit(cap), (F.lit(base) * F.pow(F.lit(2.0), a - 1)).cast("int")))).withColumn("exhausted", a >= attempts)


def retained(revisions: DataFrame, keep: int = 3) -> DataFrame:
    """(repo, generation_id, position, kept): generations from the newest backwards, the first `keep` of each repository kept."""
    rows = revisions.select(id_key("repository_id").alias("repo"), F.col("revision_id").alias("generation_id"), "indexed_at").where("repo is not null")
    rows = rows.groupBy("repo", "generation_id").agg(F.max("indexed_at").alias("indexed_at"))
    w = Window.partitionBy("repo").orderBy(F.desc("indexed_at"), F.desc("generation_id"))
    return rows.withColumn("position", F.row_number().over(w)).select("repo", "generation_id", "position", (F.col("position") <= keep).alias("kept"))


def fact_lifecycle(claims: DataFrame, active: DataFrame) -> DataFrame:
    """(fact, observations, active): facts independent of generations, active while an active generation observes them."""
    fact = digest(F.coalesce("subject_id", F.lit("")), "predicate", F.coalesce("object_id", F.lit("")), "derivation")
    rows = claims.select(fact.alias("fact"), "generation_id").distinct().join(active.select("generation_id", F.lit(True).alias("a")), "generation_id", "left")
    return rows.groupBy("fact").agg(F.count("*").alias("observations"), F.coalesce(F.max("a"), F.lit(False)).alias("active"))


def landmarks(files: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(landmark_kind, repo_id, label, confidence, records): summaries, services, contracts, dependencies, boundaries and test anchors."""
    anchored = files.select("repo_id", "generation_id", "path").distinct().join(entities.where("kind = 'file' and evidence_id is not null").select("generation_id", "path", "evidence_id"), ["generation_id", "path"])
    summary = anchored.groupBy("repo_id").agg(F.countDistinct("generation_id", "path").alias("records")).select(F.lit("repository_summary").alias("landmark_kind"), "repo_id", F.col("repo_id").alias("label"), F.lit(1.0).alias("confidence"), "records")
    s = entities.select(F.col("entity_id").alias("subject_id"), "repo_id", F.col("label").alias("s_label"))
    o = entities.select(F.col("entity_id").alias("object_id"), F.col("label").alias("o_label"))
    told = claims.join(s, "subject_id")
    service = told.where(F.col("predicate").isin("DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_UI_ROUTE", "PUBLISHES_EVENT", "PRODUCES_TOPIC", "SENDS_QUEUE")).groupBy("repo_id", "s_label").agg(F.count("*").alias("records")).select(F.lit("service_summary").alias("landmark_kind"), "repo_id", F.col("s_label").alias("label"), F.lit(0.9).alias("confidence"), "records")
    kind = F.when(F.col("predicate").isin("DEPENDENCY_DECLARATION", "DECLARES_MODULE"), "dependency").when(F.contains("predicate", F.lit("CONFIGURATION")), "boundary").otherwise("contract")
    wanted = ("DEPENDENCY_DECLARATION", "DECLARES_MODULE", "DECLARES_EFFECTIVE_ENDPOINT", "DECLARES_ENDPOINT", "DECLARES_UI_ROUTE", "PUBLISHES_EVENT", "CONSUMES_EVENT", "PRODUCES_TOPIC", "CONSUMES_TOPIC", "SENDS_QUEUE", "LISTENS_QUEUE", "DEFINES_CONFIGURATION", "REFERENCES_CONFIGURATION", "BINDS_CONFIGURATION")
    contract = told.where(F.col("predicate").isin(*wanted)).join(o, "object_id").groupBy(kind.alias("landmark_kind"), "repo_id", F.concat_ws(": ", "predicate", "o_label").alias("label")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("records")).select("landmark_kind", "repo_id", "label", "confidence", "records")
    low = F.lower("path")
    test = low.like("%\\_test.go") | low.like("%.test.ts") | low.like("%.spec.ts") | low.like("%/test/%") | low.like("%/tests/%")
    tests = anchored.where(test).groupBy("repo_id", "path").agg(F.count("*").alias("records")).select(F.lit("test_anchor").alias("landmark_kind"), "repo_id", F.col("path").alias("label"), F.lit(0.9).alias("confidence"), "records")
    return summary.unionByName(service).unionByName(contract).unionByName(tests)


def changed_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, change): added, removed, changed or unchanged between two catalogs of (repo, generation_id)."""
    j = new.select("repo", F.col("generation_id").alias("n")).join(old.select("repo", F.col("generation_id").alias("o")), "repo", "full")
    return j.select("repo", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged").alias("change"))


def rollup(entities: DataFrame) -> DataFrame:
    """(level, repo_id, area, entities, files): counts of the estate, its repositories and their top directories in one pass of grouping sets."""
    area = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    g = entities.where("path is not null and path <> ''").withColumn("area", area).rollup("repo_id", "area").agg(F.count("*").alias("entities"), F.countDistinct("path").alias("files"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "area").when(F.col("g") == 1, "repository").otherwise("estate")
    return g.select(level.alias("level"), F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.coalesce("area", F.lit("")).alias("area"), "entities", "files")


def module_of(files: DataFrame, marker: str) -> DataFrame:
    """(repo_id, path, module): the deepest directory above a file that holds a marker file, else its first directory, else '.'."""
    d = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise("")
    own = files.select("repo_id", "path").where("path is not null").distinct()
    marked = own.where(F.lower("path").rlike(marker)).select("repo_id", d(F.col("path")).alias("module")).distinct()
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>")))
    hit = own.select("repo_id", "path", F.explode(above).alias("module")).join(marked, ["repo_id", "module"]).groupBy("repo_id", "path").agg(F.max_by("module", F.length("module")).alias("module"))
    first = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    return own.join(hit, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce(F.when(F.col("module") != "", F.col("module")), first).alias("module"))


def overlapping(spans: DataFrame, first: int, last: int) -> DataFrame:
    """Rows (start_line, end_line) that touch the lines from first to last."""
    return spans.where((F.col("start_line") <= last) & (F.col("end_line") >= first))


def source_lines(files: DataFrame, spans: DataFrame, before: int = 2, after: int = 2, most: int = 40) -> DataFrame:
    """Spans (generation_id, path, start_line, end_line) with the text around them: lines clamped to the file and to `most`."""
    f = files.where("content is not null").select("generation_id", "path", F.split("content", "\n").alias("ls"))
    lo = F.greatest(F.lit(1), F.col("start_line") - before)
    n = F.least(F.col("end_line") + after, F.size("ls")) - lo + 1
    return spans.join(f, ["generation_id", "path"]).where(lo <= F.size("ls")).select(*spans.columns, lo.alias("first_line"), F.least(n, F.lit(most)).alias("lines"), F.array_join(F.slice("ls", lo, F.greatest(F.lit(0), F.least(n, F.lit(most)))), "\n").alias("excerpt"))


def anchors(files: DataFrame, entities: DataFrame, claims: DataFrame, crossing: DataFrame) -> DataFrame:
    """(landmark_kind, repo_id, label, role, confidence, evidence_id): boundaries and owners of repositories (an owner isn't known unless it
    was told), paths that matter by their name, class or claims, and what links repositories. What has no evidence is dropped, but for
    links, whose evidence is theirs."""
    e = entities.where("kind = 'file'").select("generation_id", "path", id_key("evidence_id").alias("evidence_id")).where("evidence_id is not null")
    held = files.select("repo_id", "generation_id", "path", "classification").distinct().join(e, ["generation_id", "path"])
    one = lambda kind, label, role, conf: [F.lit(kind).alias("landmark_kind"), "repo_id", label.alias("label"), role.alias("role"), conf.cast("double").alias("confidence")]
    least = F.min("evidence_id").alias("evidence_id")
    repos = held.groupBy("repo_id").agg(least)
    boundary = repos.select(*one("architecture_landmark", F.concat("repo_id", F.lit(" repository boundary")), F.lit(""), F.lit(1)), "evidence_id")
    owner = repos.select(*one("ownership_fact", F.concat("repo_id", F.lit(" ownership")), F.lit("unknown"), F.lit(1)), "evidence_id")
    low = F.lower("path")
    ends = low.endswith("package.json") | low.endswith("build.gradle") | low.endswith("pom.xml") | low.endswith("settings.gradle")
    test = low.contains("/test/") | low.endswith("_test.go") | low.contains(".test.") | low.contains(".spec.")
    named = held.withColumn("role", F.when(F.col("classification") == "configuration", "configuration").when(ends, "manifest").when(test, "test")).where("role is not null").groupBy("repo_id", "path", "role").agg(least)
    named = named.select(*one("important_path", F.col("path"), F.col("role"), F.lit(0.85)), "evidence_id")
    p = F.col("predicate")
    role = F.when(p.contains("ENDPOINT") | (p == "DECLARES_UI_ROUTE"), "route_or_controller").when(p.contains("EVENT") | p.contains("TOPIC") | p.contains("QUEUE"), "listener_or_event").when(p.contains("CONFIGURATION"), "configuration").when(p.isin("DEPENDENCY_DECLARATION", "DECLARES_MODULE"), "manifest")
    s = entities.select(F.col("entity_id").alias("subject_id"), "repo_id", "path")
    told = claims.select("subject_id", "object_id", role.alias("role"), "confidence", id_key("evidence_id").alias("evidence_id")).where("role is not null and evidence_id is not null").join(s, "subject_id").where("path <> ''")
    told = told.join(entities.select(F.col("entity_id").alias("object_id")), "object_id", "left_semi").groupBy("repo_id", "path", "role").agg(F.max("confidence").alias("c"), least)
    told = told.select(*one("important_path", F.col("path"), F.col("role"), F.col("c")), "evidence_id")
    links = crossing.groupBy("subject_repo", "predicate", "object_repo").agg(F.max("confidence").alias("c")).withColumnRenamed("subject_repo", "repo_id")
    links = links.select(*one("estate_topology_fact", F.concat_ws(" ", "repo_id", "predicate", "object_repo"), F.lit(""), F.col("c")), F.lit("").alias("evidence_id"))
    return boundary.unionByName(owner).unionByName(named).unionByName(told).unionByName(links)
