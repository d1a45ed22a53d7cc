"""Queries of an answering service's views, and the SQL that says the same, written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import coverage, current, graph, history, linking, serving
from .queries_core import _ACTIVE, _BASIS, _CONF, _EXACT_OF, _FACTS, _FILES, _NODES, _PROOFS, _T, _UND, LABEL, SQL as CORE, Tables, W, _search, _search_sql
from .session import id_key

QUERIES = {}
SQL: dict[str, str] = {}
TERM = "Service"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DOCS = f"""docs as (select entity_id, evidence_id, generation_id, repo_id, label symbol, path, case when cls = 'configuration' then t else '' end || case when kind = 'configuration_key' then ' ' || label else '' end configuration,
 case when cls = 'documentation' then t else '' end documentation, t strings, case when cls in ('log', 'logs', 'error') or contains(lower(t), 'error') then t else '' end logs_errors, t source from (
 select n.entity_id, n.kind, n.label, p.evidence_id, f.generation_id, f.repo_id, f.path, coalesce(f.classification, '') cls, coalesce(case when n.kind = 'file' then f.content else p.excerpt end, '') t
 from nodes n join proofs p on nullif({_T % 'n.evidence_id'}, '') = {_T % 'p.evidence_id'} join files f on f.source_id = p.source_id))"""


def _documents(t: Tables) -> DataFrame:
    return serving.fielded(t.files, t.proofs, t.nodes)


@query(W(_NODES, _PROOFS, _FILES, _DOCS) + "select * from docs")
def fielded_document(spark, d):
    """PRJ-05, IR-03: the seven fields that full-text search reads, for each entity with evidence."""
    return _documents(Tables(spark, d))


_PARTS = ("symbol", "path", "configuration", "documentation", "strings", "logs_errors", "source")
_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_HIT = "((length(' ' || array_to_string({t}, '  ') || ' ') - length(replace(' ' || array_to_string({t}, '  ') || ' ', ' error ', ''))) / 7)::bigint"
_PART = "case when {c} > 0 then -greatest(ln((n - df_{c} + 0.5) / (df_{c} + 0.5)), 1e-6) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * len / av)) else 0 end"


@query(
    W(_NODES, _PROOFS, _FILES, _DOCS, "tk as (select entity_id, evidence_id, " + ", ".join(_TOK.format(c=c) + f" t_{c}" for c in _PARTS) + " from docs)",
      "hs as (select entity_id, evidence_id, (" + " + ".join(f"len(t_{c})" for c in _PARTS) + ")::double len, " + ", ".join(_HIT.format(t=f"t_{c}") + f" {c}" for c in _PARTS) + " from tk)",
      "co as (select count(*)::double n, avg(len) av, " + ", ".join(f"count(*) filter ({c} > 0)::double df_{c}" for c in _PARTS) + " from hs)",
      "sc as (select entity_id, evidence_id, list_filter([" + ", ".join(f"case when {c} > 0 then '{c}' end" for c in _PARTS) + "], lambda x: x is not null) h, " + " + ".join(_PARTS) + " hits, round(" + " + ".join(_PART.format(c=c) for c in _PARTS) + ", 6) score from hs, co)")
    + "select entity_id, evidence_id, h[1] field, array_to_string(h, ',') fields, hits::bigint hits, score from sc where hits > 0")
def search_fields(spark, d):
    """RET-02, RET-04: a phrase within one of seven fields, with BM25 over all documents."""
    return serving.search_fields(_documents(Tables(spark, d)), "error")


@query(W(_NODES, _FACTS, _CONF, _FILES, _EXACT_OF.replace("<text>", TERM), _search_sql(TERM)) + """select entity_id, match_type, row_number() over (order by case match_type when 'exact_identifier' then 0 when 'exact_path' then 1 when 'literal' then 2 when 'exact_protocol_config' then 3 else 4 end,
 case match_type when 'exact_identifier' then 0 when 'exact_path' then 1 when 'exact_protocol_config' then 2 when 'lexical' then 4 when 'literal' then 6 else 99 end, confidence desc, repo_id, path, entity_id)::int as "position" from rows order by 3 limit 100""")
def retrieve_order(spark, d):
    """SRT-02, RET-18: the first page of a hundred in the order of retrieval."""
    rows = _search(Tables(spark, d), TERM)
    first = rows.orderBy(*serving.retrieve_order(rows)).limit(100)  # bounded before the window gathers it
    return first.select("entity_id", "match_type", F.row_number().over(Window.orderBy(*serving.retrieve_order(rows))).alias("position"))


@query(W(_NODES, _FACTS, _CONF, _FILES, _EXACT_OF.replace("<text>", TERM), _search_sql(TERM)) + "select entity_id, kind, row_number() over (order by (kind <> 'file')::int, entity_id)::int as \"position\" from (select distinct n.entity_id, n.kind from rows r join nodes n using (entity_id)) order by 3 limit 500")
def ui_query(spark, d):
    """RET-19, SRT-08: one row an entity, files first, at most 500 (a page)."""
    t = Tables(spark, d)
    rows = t.nodes.select("entity_id", "kind").join(_search(t, TERM).select("entity_id").distinct(), "entity_id", "left_semi")
    order = [(F.col("kind") != "file").cast("int"), F.col("entity_id")]
    return rows.orderBy(*order).limit(500).select("entity_id", "kind", F.row_number().over(Window.orderBy(*order)).alias("position"))


@query(W(_PROOFS, _FILES) + "select p.evidence_id, f.classification from proofs p left join files f on f.source_id = p.source_id")
def classification_lookup(spark, d):
    """FLT-02: the classification of the file behind each piece of evidence."""
    t = Tables(spark, d)
    return t.proofs.select("evidence_id", "source_id").join(t.files.select("source_id", "classification"), "source_id", "left").select("evidence_id", "classification")


@query(W(_NODES, _PROOFS) + f"select n.entity_id, n.evidence_id, p.path, case when p.evidence_id is null then 'stale' else 'ready' end state from nodes n left join proofs p on {_T % 'p.evidence_id'} = {_T % 'n.evidence_id'} and p.generation_id = n.generation_id where nullif({_T % 'n.evidence_id'}, '') is not null")
def rehydrate(spark, d):
    """PRJ-07: references re-joined to what they stand for; those that lead nowhere any more are stale."""
    t = Tables(spark, d)
    v = t.proofs.select(id_key("evidence_id").alias("k"), "generation_id", "path", F.lit(True).alias("there"))
    n = t.nodes.select("entity_id", "evidence_id", "generation_id", id_key("evidence_id").alias("k")).where("k is not null")
    return n.join(v, ["k", "generation_id"], "left").select("entity_id", "evidence_id", "path", F.when(F.col("there"), "ready").otherwise("stale").alias("state"))


_LANDMARKS = f"lm as ({CORE['landmarks_union']})"


@query(f"with {_LANDMARKS}, o as (select *, row_number() over (order by landmark_kind, repo_id, label) n, count(*) over () total from lm) select landmark_kind, repo_id, label, n::int as \"position\", total > 60 more from o where n between 21 and 60")
def landmark_page(spark, d):
    """SRT-09, IR-11: a page of landmarks, and whether more follow."""
    t = Tables(spark, d)
    order = ["landmark_kind", "repo_id", "label"]
    first = history.landmarks(t.files, t.nodes, t.facts).orderBy(*order).limit(61).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    first = first.withColumn("more", F.max("position").over(Window.partitionBy(F.lit(1))) > 60)
    return first.where("position between 21 and 60").select("landmark_kind", "repo_id", "label", "position", "more")


@query(f"with {_LANDMARKS}, f as (select * from lm order by landmark_kind, repo_id, label limit 100) select landmark_kind, repo_id, label from f where contains(lower(label), 'bucket') or contains(lower(label), 'event')")
def landmark_candidates(spark, d):
    """RET-07: of the first hundred landmarks those whose label holds a word of the question."""
    t = Tables(spark, d)
    first = history.landmarks(t.files, t.nodes, t.facts).orderBy("landmark_kind", "repo_id", "label").limit(100)
    low = F.lower("label")
    return first.where(F.contains(low, F.lit("bucket")) | F.contains(low, F.lit("event"))).select("landmark_kind", "repo_id", "label")


@query(
    W(_NODES, _FACTS, "e as (select claim_id, subject_id, object_id, subject_id src, object_id dst, predicate || subject_id || object_id || claim_id as k from facts where subject_id is not null and object_id is not null union all select claim_id, subject_id, object_id, object_id, subject_id, predicate || subject_id || object_id || claim_id from facts where subject_id is not null and object_id is not null)",
      "r as (select *, row_number() over (partition by src order by k, dst) n, count(*) over (partition by src) > 5 as more from e), top as (select * from r where n <= 5)",
      "seeds as (select entity_id seed from nodes where kind = 'route')", "s1 as (select seed, dst, claim_id, k, more, 1 depth from seeds join top on src = seed)",
      "f1 as (select distinct seed, dst node from s1 where dst <> seed)", "s2 as (select seed, top.dst, top.claim_id, top.k, top.more, 2 depth from f1 join top on src = node)",
      "per as (select seed, claim_id, min(depth) depth, arg_min(k, (depth, k)) k, bool_or(more) more from (select * from s1 union all select * from s2) group by 1, 2)",
      "o as (select *, row_number() over (partition by seed order by depth, k, claim_id) n, bool_or(more) over (partition by seed) or count(*) over (partition by seed) > 12 truncated from per)")
    + "select seed, claim_id, depth, truncated from o where n <= 12")
def neighbors_budget(spark, d):
    """GRP-04, GRP-05, SRT-06, SRT-07: walks of two levels from every route with fan-out, budget and truncation."""
    t = Tables(spark, d)
    c = t.facts.where("subject_id is not null and object_id is not null")
    along = c.select("claim_id", "predicate", "subject_id", "object_id", F.explode(F.array(F.struct(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")), F.struct(F.col("object_id").alias("src"), F.col("subject_id").alias("dst")))).alias("x")).select("claim_id", "predicate", "subject_id", "object_id", "x.*")
    return serving.walk(t.nodes.where("kind = 'route'").select(F.col("entity_id").alias("node")), serving.ranked_claims(along, 5), 2, 12)


@query(
    W(_NODES, _FACTS, _UND, "e as (select src, dst, min(claim_id) c from und group by 1, 2)", "g as (select entity_id goal from nodes where kind = 'configuration_key')",
      "s1 as (select entity_id st, dst node, [c] trail from nodes join e on src = entity_id where kind = 'route')",
      "f1 as (select st, node, min(trail) trail from s1 where node <> st group by 1, 2)", "s2 as (select st, dst node, list_append(trail, c) trail from f1 join e on src = node)",
      "f2 as (select st, node, min(trail) trail from s2 where node <> st and not exists (select 1 from f1 where f1.st = s2.st and f1.node = s2.node) group by 1, 2)", "s3 as (select st, dst node, list_append(trail, c) trail from f2 join e on src = node)",
      "h as (select st, node goal, 1 hops, trail from s1 union all select st, node, 2, trail from s2 union all select st, node, 3, trail from s3)",
      "o as (select h.*, row_number() over (partition by st, goal order by hops, trail) n from h where goal in (select goal from g) and st <> goal)")
    + "select st as \"start\", goal, hops, array_to_string(trail, '>') trail from o where n <= 10")
def paths_max10(spark, d):
    """GRP-08: up to ten paths with their claims from every route to every configuration key it reaches within three claims."""
    t = Tables(spark, d)
    pick = lambda kind: t.nodes.where(F.col("kind") == kind).select(F.col("entity_id").alias("node"))
    return serving.trails(pick("route"), pick("configuration_key"), graph.edges(t.facts), 3, 10)


@query(f"with x as ({CORE['cross_link']}), a as (select subject_id entity_id, 'out' direction, predicate, object_id other, link_id from x union all select object_id, 'in', predicate, subject_id, link_id from x), o as (select *, row_number() over (partition by entity_id, direction order by predicate, other, link_id) n from a) select entity_id, direction, predicate, other, link_id from o where n <= 20")
def cross_adjacency(spark, d):
    """GRP-03: links into other repositories by entity and direction, at most twenty each (a fan-out)."""
    t = Tables(spark, d)
    x = linking.links(linking.memberships(t.facts, t.nodes))
    ends = F.array(*[F.struct(F.col(a).alias("entity_id"), F.lit(w).alias("direction"), F.col(b).alias("other")) for a, b, w in (("subject_id", "object_id", "out"), ("object_id", "subject_id", "in"))])
    rows = x.select("predicate", "link_id", F.explode(ends).alias("e")).select("e.*", "predicate", "link_id")
    w = Window.partitionBy("entity_id", "direction").orderBy("predicate", "other", "link_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 20").select("entity_id", "direction", "predicate", "other", "link_id")


@query(W(_NODES, _FACTS, "p as (select entity_id from nodes order by repo_id, path, entity_id limit 100 offset 100)", "c as (select claim_id, subject_id, object_id from facts order by claim_id limit 3000)") + "select 'node' item, entity_id id from p union all select 'edge', claim_id from c where subject_id in (select entity_id from p) and object_id in (select entity_id from p)")
def projection_page(spark, d):
    """GRP-13: a page of nodes and the edges with both ends on it, edges bounded before they are filtered."""
    t = Tables(spark, d)
    p = t.nodes.orderBy("repo_id", "path", "entity_id").offset(100).limit(100).select("entity_id")
    e = graph.visible(t.facts.orderBy("claim_id").limit(3000), p.withColumnRenamed("entity_id", "node"))
    return p.select(F.lit("node").alias("item"), F.col("entity_id").alias("id")).unionByName(e.select(F.lit("edge").alias("item"), F.col("claim_id").alias("id")))


@query(
    W(_NODES, _FACTS, "b as (select f.claim_id, s.repo_id r, s.path p, o.repo_id r2, o.path p2 from facts f join nodes s on s.entity_id = f.subject_id join nodes o on o.entity_id = f.object_id)")
    + "select 'file' as \"level\", n.repo_id, coalesce(n.path, '') path, count(*)::bigint entities, (select count(*) from b where b.r = n.repo_id and b.r2 = n.repo_id and b.p = n.path and b.p2 = n.path)::bigint claims from nodes n group by n.repo_id, n.path union all select 'repository', n.repo_id, '', count(*)::bigint, (select count(*) from b where b.r = n.repo_id and b.r2 = n.repo_id)::bigint from nodes n group by n.repo_id")
def cloud_drilldown(spark, d):
    """AGG-06, AGG-07, GRP-15: repositories and files with their entities, and the claims with both ends inside."""
    t = Tables(spark, d)
    return serving.drilldown(t.nodes, t.facts)


_OWNED = ("source_files", "evidence", "entities", "file_manifests", "symbols")


@query("with t as (" + " union all ".join(f"select '{n}' as \"table\", repo_id from {n}" for n in _OWNED) + ") select \"table\", count(*)::bigint as \"rows\", count(*) filter (repo_id <> 'storefront-core')::bigint kept from t group by 1")
def purge_counts(spark, d):
    """AGG-14, IR-19: rows of each table, and those that stay when a repository is purged."""
    parts = [getattr(Tables(spark, d), n).select(F.lit(n).alias("table"), "repo_id") for n in _OWNED]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("table").agg(F.count("*").alias("rows"), F.count(F.when(F.col("repo_id") != "storefront-core", 1)).alias("kept"))


@query("select event_type metric, strftime(ts, '%Y-%m-%d') as \"day\", count(*)::bigint n, round(sum(\"value\"), 4) total from events where event_type is not null and ts is not null group by 1, 2")
def metric_upsert(spark, d):
    """AGG-15: metrics accumulated by name and day."""
    return Tables(spark, d).events.where("event_type is not null and ts is not null").groupBy(F.col("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(W(_FILES, _BASIS) + "select repo_id, cap capability, case cap when 'exact' then 'lookup' when 'structural' then 'graph' when 'path' then 'graph' else 'lexical' end projection, case when cap in ('structural', 'path') then complete else not_included = 0 and diagnostics = 0 end complete from basis, (select unnest(['exact', 'lexical', 'structural', 'path']) cap)")
def capability_coverage(spark, d):
    """COV-01, COV-02: for each repository and capability the projection it reads and whether its coverage is complete."""
    t = Tables(spark, d)
    b = coverage.basis(t.files_with(**coverage.told()), t.compiler_diagnostics).withColumn("capability", F.explode(F.array(*map(F.lit, ("exact", "lexical", "structural", "path")))))
    ok = F.when(F.col("capability").isin("structural", "path"), F.col("complete")).otherwise((F.col("not_included") == 0) & (F.col("diagnostics") == 0))
    return b.select("repo_id", "capability", serving.projection_of(F.col("capability")).alias("projection"), ok.alias("complete"))


@query(W(_ACTIVE) + f"select {_T % 'repository_id'} repo from ir_repositories where nullif({_T % 'repository_id'}, '') is not null group by 1 having max(deleted_at) is null and {_T % 'repository_id'} not in (select repo from active)")
def repository_not_indexed(spark, d):
    """COV-07: known repositories without an active generation; they keep answers from being complete."""
    t = Tables(spark, d)
    known = t.ir_repositories.select(id_key("repository_id").alias("repo"), "deleted_at").where("repo is not null").groupBy("repo").agg(F.max("deleted_at").alias("gone")).where("gone is null").select("repo")
    return known.join(t.active.select("repo"), "repo", "left_anti")


_MAN = "m as (select repo_id, snapshot_no, path, arg_max(sha256, delivered_at) s from file_manifests group by 1, 2, 3), l as (select repo_id, max(snapshot_no) a from file_manifests group by 1), p as (select f.repo_id, max(f.snapshot_no) b from file_manifests f join l on l.repo_id = f.repo_id and f.snapshot_no < a group by 1)"


@query(f"with {_MAN}, x as (select m.repo_id, path, s from m join l on l.repo_id = m.repo_id and snapshot_no = a), y as (select m.repo_id, path, s from m join p on p.repo_id = m.repo_id and snapshot_no = b), k as (select repo_id from x union select repo_id from y) select repo_id, not exists (select path, s from x where x.repo_id = k.repo_id except all select path, s from y where y.repo_id = k.repo_id) and not exists (select path, s from y where y.repo_id = k.repo_id except all select path, s from x where x.repo_id = k.repo_id) as \"equal\" from k")
def coverage_equality(spark, d):
    """COV-10, IR-15: whether a repository's last two listings are the same, so that nothing needs to be indexed again."""
    t = Tables(spark, d)
    m = t.file_manifests.groupBy("repo_id", "snapshot_no", "path").agg(F.max(F.struct("delivered_at", "sha256")).getField("sha256").alias("s"))
    nos = t.file_manifests.select("repo_id", "snapshot_no").distinct().groupBy("repo_id").agg(F.sort_array(F.collect_set("snapshot_no"), asc=False).alias("x"))
    m = m.join(nos, "repo_id")
    return serving.same_rows(m.where(F.col("snapshot_no") == F.col("x")[0]), m.where((F.size("x") > 1) & (F.col("snapshot_no") == F.try_element_at("x", F.lit(2)))), "repo_id", ["path", "s"])


@query(W(_FILES, _BASIS, _NODES) + f"select b.repo_id, coalesce(h, 0)::bigint hits, case when coalesce(h, 0) > 1 then 'bounded' when coalesce(h, 0) = 0 and not b.complete then 'unavailable' else 'complete' end completeness from basis b left join (select repo_id, count(*) h from nodes where contains(lower(label), lower('{TERM}')) group by 1) using (repo_id)")
def provenance_envelope(spark, d):
    """COV-05, COV-06, COV-11: how far an answer of one row reaches in each repository."""
    t = Tables(spark, d)
    hits = t.nodes.where(F.contains(F.lower("label"), F.lit(TERM.lower()))).groupBy("repo_id").agg(F.count("*").alias("hits"))
    b = coverage.basis(t.files_with(**coverage.told()), t.compiler_diagnostics).join(hits, "repo_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return b.select("repo_id", "hits", serving.completeness(coverage.state(F.col("hits"), F.col("complete")), F.col("hits") > 1).alias("completeness"))


@query(W(_NODES, _FACTS, _PROOFS, _FILES, _ACTIVE) + """select a.repo, a.generation_id, p.projection, p.n::bigint as "rows" from active a join (select generation_id, 'lookup' projection, count(*) n from files group by 1 union all select generation_id, 'graph', count(*) from facts group by 1
 union all select generation_id, 'ui', count(*) from nodes group by 1 union all select generation_id, 'lexical', count(*) from proofs group by 1) p using (generation_id)""")
def projection_builds(spark, d):
    """IR-05, IR-08, SRC-20: rows of each projection of the active generations."""
    t = Tables(spark, d)
    parts = [df.groupBy("generation_id").agg(F.count("*").alias("rows")).withColumn("projection", F.lit(n)) for n, df in (("lookup", t.files), ("graph", t.facts), ("ui", t.nodes), ("lexical", t.proofs))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return t.active.select("repo", "generation_id").join(rows, "generation_id").select("repo", "generation_id", "projection", "rows")


@query(W(_NODES, _FILES, _ACTIVE) + "select a.repo, a.generation_id, count(distinct n.path)::bigint listed, count(distinct n.path) filter (f.path is null)::bigint missing, count(distinct n.path) > 0 and count(distinct n.path) filter (f.path is null) = 0 ready from active a left join nodes n on n.generation_id = a.generation_id and n.kind = 'file' left join (select distinct generation_id, path from files) f on f.generation_id = n.generation_id and f.path = n.path group by 1, 2")
def projection_ready(spark, d):
    """IR-07: whether the lookup of each active generation is there and whole, as every read asks."""
    t = Tables(spark, d)
    n = t.nodes.where("kind = 'file'").select("generation_id", "path").distinct()
    f = t.files.select("generation_id", "path").distinct().withColumn("there", F.lit(1))
    per = n.join(f, ["generation_id", "path"], "left").groupBy("generation_id").agg(F.count("path").alias("listed"), F.count(F.when(F.col("there").isNull(), F.col("path"))).alias("missing"))
    out = t.active.select("repo", "generation_id").join(per, "generation_id", "left").select("repo", "generation_id", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("missing", F.lit(0)).alias("missing"))
    return out.withColumn("ready", (F.col("listed") > 0) & (F.col("missing") == 0))


@query(W(_NODES, _PROOFS) + f"select n.repo_id, n.path, n.label as \"name\", substr(n.kind, 8) kind, n.identity, p.start_byte, p.end_byte, p.start_line, p.end_line, n.extractor from nodes n join proofs p on {_T % 'p.evidence_id'} = nullif({_T % 'n.evidence_id'}, '') where n.kind like 'symbol:%'")
def previous_symbols(spark, d):
    """IR-16: the symbols that were put in, read back from entities and evidence."""
    t = Tables(spark, d)
    v = t.proofs.select(id_key("evidence_id").alias("k"), "start_byte", "end_byte", "start_line", "end_line")
    n = t.nodes.where("kind like 'symbol:%'").select("repo_id", "path", F.col("label").alias("name"), F.substring("kind", 8, 1000).alias("kind"), "identity", "extractor", id_key("evidence_id").alias("k"))
    return n.join(v, "k").select("repo_id", "path", "name", "kind", "identity", "start_byte", "end_byte", "start_line", "end_line", "extractor")


@query(W(_NODES, _PROOFS, _FACTS) + f"select f.claim_id, s.label as \"source\", o.label target, f.predicate kind, p.path, p.start_line, f.confidence from facts f join nodes s on s.entity_id = f.subject_id join nodes o on o.entity_id = f.object_id join proofs p on {_T % 'p.evidence_id'} = nullif({_T % 'f.evidence_id'}, '')")
def previous_edges(spark, d):
    """IR-01, IR-16: the relationships that were put in, read back from claims, both ends and evidence."""
    t = Tables(spark, d)
    s = t.nodes.select(F.col("entity_id").alias("subject_id"), F.col("label").alias("source"))
    o = t.nodes.select(F.col("entity_id").alias("object_id"), F.col("label").alias("target"))
    v = t.proofs.select(id_key("evidence_id").alias("k"), "path", "start_line")
    return t.facts.withColumn("k", id_key("evidence_id")).join(s, "subject_id").join(o, "object_id").join(v, "k").select("claim_id", "source", "target", F.col("predicate").alias("kind"), "path", "start_line", "confidence")


@query(W(_NODES, _PROOFS) + f"select n.entity_id, trim(regexp_replace(concat_ws(' ', n.label, n.kind, n.identity, p.excerpt), '[ \\t\\r\\n]+', ' ', 'g')) as \"text\" from nodes n left join proofs p on {_T % 'p.evidence_id'} = nullif({_T % 'n.evidence_id'}, '')")
def vector_text(spark, d):
    """IR-20: the text of each entity that is embedded."""
    t = Tables(spark, d)
    return serving.vector_text(t.nodes, t.proofs)


_ROLE3 = "case when upper(predicate) in ('PUBLISHES_EVENT', 'PRODUCES_TOPIC', 'SENDS_QUEUE', 'DEFINES_CONFIGURATION', 'DECLARES_EFFECTIVE_ENDPOINT', 'DECLARES_MODULE') then 0 when upper(predicate) in ('CONSUMES_EVENT', 'LISTENS_EVENT', 'SUBSCRIBES_EVENT', 'CONSUMES_TOPIC', 'LISTENS_QUEUE', 'REFERENCES_CONFIGURATION', 'BINDS_CONFIGURATION', 'INVOKES_API', 'DEPENDENCY_DECLARATION') then 1 else 2 end"


@query(W(_NODES, _FACTS, "e as (select subject_id anchor, * from facts union all select object_id, * from facts where object_id is distinct from subject_id)", f"o as (select anchor, claim_id, row_number() over (partition by anchor order by {_ROLE3}, confidence desc, subject_id nulls first, predicate, object_id nulls first, claim_id)::int n from e where anchor in (select entity_id from nodes where kind in ('route', 'message_channel')) and upper(predicate) in ('PUBLISHES_EVENT', 'CONSUMES_EVENT', 'INVOKES_API', 'DECLARES_ENDPOINT'))") + "select anchor, claim_id, n from o where n <= 24")
def context_relationships(spark, d):
    """IR-25, SRT-16: the relationships of a package around each route and channel: allowed predicates, in order, at most 24."""
    t = Tables(spark, d)
    c = t.facts.where(F.upper("predicate").isin("PUBLISHES_EVENT", "CONSUMES_EVENT", "INVOKES_API", "DECLARES_ENDPOINT"))
    e = c.withColumn("anchor", F.explode(F.array_distinct(F.array("subject_id", "object_id")))).join(t.nodes.where("kind in ('route', 'message_channel')").select(F.col("entity_id").alias("anchor")), "anchor", "left_semi")
    w = Window.partitionBy("anchor").orderBy(*serving.context_order())
    return e.withColumn("n", F.row_number().over(w)).where("n <= 24").select("anchor", "claim_id", "n")


@query(W(_NODES, _FACTS, _PROOFS, _ACTIVE) + "select 'entities' metric, count(*)::bigint as \"value\" from nodes union all select 'claims', count(*) from facts union all select 'evidence', count(*) from proofs union all select 'active_generations', count(*) from active union all select 'claims_without_subject', count(*) from facts where subject_id is null or subject_id not in (select entity_id from nodes) union all select 'claims_without_object', count(*) from facts where object_id is null or object_id not in (select entity_id from nodes)")
def status_health(spark, d):
    """IR-28: the figures of a status page."""
    t = Tables(spark, d)
    n = t.nodes.select("entity_id")
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one("entities", n), one("claims", t.facts), one("evidence", t.proofs), one("active_generations", t.active)]
    parts += [one(f"claims_without_{c}", t.facts.select(F.col(f"{c}_id").alias("entity_id")).join(n, "entity_id", "left_anti")) for c in ("subject", "object")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


@query("select revision_id, indexed_at, row_number() over (order by indexed_at desc, revision_id desc)::int as \"position\" from (select revision_id, max(indexed_at) indexed_at from ir_source_revisions group by 1) order by 3 limit 100")
def audit_newest(spark, d):
    """SRT-12: the newest hundred revisions (a report)."""
    r = Tables(spark, d).ir_source_revisions.groupBy("revision_id").agg(F.max("indexed_at").alias("indexed_at"))
    order = [F.desc("indexed_at"), F.desc("revision_id")]
    return r.orderBy(*order).limit(100).withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query(W(_FILES, "l as (select repo_id, max(snapshot_no) a from file_manifests group by 1)", "m as (select distinct f.repo_id, f.path from file_manifests f join l on l.repo_id = f.repo_id and f.snapshot_no = a)", "i as (select distinct repo_id, path from files where repo_id in (select repo_id from l))") + "select coalesce(m.repo_id, i.repo_id) repo_id, count(*) filter (i.path is null)::bigint not_indexed, count(*) filter (m.path is null)::bigint not_listed from m full join i on i.repo_id = m.repo_id and i.path = m.path group by 1")
def wake_reconcile(spark, d):
    """STR-06: after lost events, how the last listing of each repository differs from what is indexed."""
    t = Tables(spark, d)
    last = t.file_manifests.groupBy("repo_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    m = t.file_manifests.join(last, ["repo_id", "snapshot_no"]).select("repo_id", "path").distinct().withColumn("m", F.lit(1))
    i = t.files.select("repo_id", "path").distinct().join(last.select("repo_id"), "repo_id", "left_semi").withColumn("i", F.lit(1))
    both = m.join(i, ["repo_id", "path"], "full")
    return both.groupBy("repo_id").agg(F.count(F.when(F.col("i").isNull(), 1)).alias("not_indexed"), F.count(F.when(F.col("m").isNull(), 1)).alias("not_listed"))


@query(
    W(_NODES, _FACTS, _FILES, f"x as ({CORE['cross_link']})",
      f"held as (select distinct f.repo_id, f.path, f.classification, nullif({_T % 'n.evidence_id'}, '') ev from files f join nodes n on n.generation_id = f.generation_id and n.path = f.path and n.kind = 'file' where nullif({_T % 'n.evidence_id'}, '') is not null)",
      "named as (select repo_id, path, ev, case when classification = 'configuration' then 'configuration' when regexp_matches(lower(path), '(package\\.json|build\\.gradle|pom\\.xml|settings\\.gradle)$') then 'manifest' when regexp_matches(lower(path), '/test/|_test\\.go$|\\.test\\.|\\.spec\\.') then 'test' end r from held)",
      "told as (select s.repo_id, s.path, f.confidence, " + f"nullif({_T % 'f.evidence_id'}, '') ev, " + "case when contains(predicate, 'ENDPOINT') or predicate = 'DECLARES_UI_ROUTE' then 'route_or_controller' when regexp_matches(predicate, 'EVENT|TOPIC|QUEUE') then 'listener_or_event' when contains(predicate, 'CONFIGURATION') then 'configuration' when predicate in ('DEPENDENCY_DECLARATION', 'DECLARES_MODULE') then 'manifest' end r from facts f join nodes s on s.entity_id = f.subject_id where f.object_id in (select entity_id from nodes) and s.path <> '')")
    + """select 'architecture_landmark' landmark_kind, repo_id, repo_id || ' repository boundary' as "label", '' as "role", 1.0::double confidence, min(ev) evidence_id from held group by repo_id
 union all select 'ownership_fact', repo_id, repo_id || ' ownership', 'unknown', 1.0, min(ev) from held group by repo_id union all select 'important_path', repo_id, path, r, 0.85, min(ev) from named where r is not null group by repo_id, path, r
 union all select 'important_path', repo_id, path, r, max(confidence), min(ev) from told where r is not null and ev is not null group by repo_id, path, r
 union all select 'estate_topology_fact', subject_repo, subject_repo || ' ' || predicate || ' ' || object_repo, '', max(confidence), '' from x group by subject_repo, predicate, object_repo""")  # fmt: skip
def landmark_anchors(spark, d):
    """IR-09: boundaries, owners, important paths and links between repositories, each with its least evidence."""
    t = Tables(spark, d)
    return history.anchors(t.files, t.nodes, t.facts, linking.links(linking.memberships(t.facts, t.nodes)))
