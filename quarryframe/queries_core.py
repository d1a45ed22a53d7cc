"""Queries of the repository-knowledge operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, labels
from .operators import coverage, current, discover, evaluation, extract, graph, history, linking, materialize, ranking, retrieval
from .session import WHITE_SPACE, id_key, table

QUERIES = {}
SQL: dict[str, str] = {}
# What the queries ask for; parameters, not bounds.
LABEL, NEEDLE, PHRASE, PAGED = "/V1/Bucket", "token", "bonded warehouse", "Service"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tidy(claims: DataFrame) -> DataFrame:
    return claims.withColumns({c: F.lower(F.btrim(c, F.lit(WHITE_SPACE))) for c in ("subject_id", "object_id")})


class Tables:
    """Tables of a folder, and their current rows."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @property
    def nodes(self) -> DataFrame:
        return current.present(self.entities, "entity_id")

    @property
    def facts(self) -> DataFrame:
        return _tidy(current.last_rows(self.claims, "claim_id", "ingested_at"))

    @property
    def proofs(self) -> DataFrame:
        return current.present(self.evidence, "evidence_id")

    @property
    def files(self) -> DataFrame:
        return current.last_rows(self.source_files, "source_id", "ingested_at")

    def nodes_where(self, condition: Column) -> DataFrame:
        """Current entities that meet a condition; only records that met it in some delivery are reduced."""
        return current.present(current.only(self.entities, "entity_id", condition), "entity_id").where(condition)

    def facts_about(self, nodes: DataFrame) -> DataFrame:
        """Current claims with one of the nodes (entity_id) at either end; only their records are reduced."""
        ids_ = nodes.select(F.lower("entity_id").alias("e")).distinct()
        ends = self.claims.select("claim_id", F.explode(F.array(id_key("subject_id"), id_key("object_id"))).alias("e"))
        hit = ends.join(ids_, "e", "left_semi").select("claim_id").distinct()
        return _tidy(current.last_rows(self.claims.join(hit, "claim_id", "left_semi"), "claim_id", "ingested_at"))

    def files_with(self, **derived: Column) -> DataFrame:
        """Current files with columns made from their rows before the reduction, so that content isn't shuffled for them."""
        return current.last_rows(self.source_files.withColumns(derived), "source_id", "ingested_at")

    @property
    def active(self) -> DataFrame:
        return current.active_generations(self.ir_source_revisions)


_T = f"lower(trim(%s, '{WHITE_SPACE}'))"
_NODES = "nodes as (select * exclude (rn, gone) from (select *, row_number() over (partition by entity_id order by ingested_at desc) rn, max(deleted_at) over (partition by entity_id) gone from entities) where rn = 1 and gone is null)"
_PROOFS = "proofs as (select * exclude (rn, gone) from (select *, row_number() over (partition by evidence_id order by ingested_at desc) rn, max(deleted_at) over (partition by evidence_id) gone from evidence) where rn = 1 and gone is null)"
_FACTS = f"facts as (select * exclude rn replace ({_T % 'subject_id'} as subject_id, {_T % 'object_id'} as object_id) from (select *, row_number() over (partition by claim_id order by ingested_at desc) rn from claims) where rn = 1)"
_FILES = "files as (select * exclude rn from (select *, row_number() over (partition by source_id order by ingested_at desc) rn from source_files) where rn = 1)"
_ACTIVE = f"active as (select repo, generation_id, git_commit, indexed_at from (select nullif({_T % 'repository_id'}, '') repo, revision_id generation_id, git_commit, indexed_at, row_number() over (partition by {_T % 'repository_id'} order by indexed_at desc, revision_id desc) rn from ir_source_revisions) where rn = 1 and repo is not null)"
_CONF = "conf as (select id, max(confidence) c from (select subject_id id, confidence from facts union all select object_id, confidence from facts) where id <> '' group by id)"
_UND = "und as (select subject_id src, object_id dst, predicate, claim_id from facts where subject_id is not null and object_id is not null union all select object_id, subject_id, predicate, claim_id from facts where subject_id is not null and object_id is not null)"


def W(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


_EXACT_OF = "exact as (select n.entity_id, n.repo_id, n.kind, n.label, n.path, n.evidence_id, case when lower(label) = lower('<text>') then 'exact_identifier' else 'exact_path' end match_type, coalesce(c.c, 1.0) confidence from nodes n left join conf c on c.id = lower(n.entity_id) where lower(label) = lower('<text>') or lower(path) = lower('<text>'))"
_EXACT = _EXACT_OF.replace("<text>", LABEL)


@query(W(_NODES, _FACTS, _CONF, _EXACT) + "select * from exact")
def exact_lookup(spark, d):
    """RET-01, FLT-06: label or path, without regard to case, with confidence."""
    t = Tables(spark, d)
    nodes = t.nodes_where(retrieval.named(LABEL))
    return retrieval.exact(nodes, t.facts_about(nodes), LABEL)


@query(W(_NODES, _FILES) + f"select entity_id, repo_id, kind, label, path, case when kind like 'configuration%' then 'exact_protocol_config' else 'literal' end match_type from nodes n where exists (select 1 from files f where f.generation_id = n.generation_id and f.path = n.path and contains(lower(f.content), '{NEEDLE}'))")
def literal_contains(spark, d):
    """FLT-07: entities of files that contain a text."""
    t = Tables(spark, d)
    return retrieval.literal(t.nodes, t.files_with(hit=retrieval.holds(NEEDLE)).where("hit"))


_BM = """
tok as (select {key} id, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') t from {src}),
hit as (select id, len(t)::double len, ((length(' ' || array_to_string(t, '  ') || ' ') - length(replace(' ' || array_to_string(t, '  ') || ' ', ' {needle} ', ''))) / {n})::bigint hits from tok),
cor as (select count(*)::double n, avg(len) av, count(*) filter (hits > 0)::double df from hit),
bm as (select id, hits, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * len / av)), 6) score from hit, cor where hits > 0)
"""


@query("with " + _BM.format(key="doc_id", text="text", src="documents", needle="bonded  warehouse", n=len(" bonded  warehouse ")) + "select id as doc_id, hits, score from bm")
def lexical_phrase_bm25(spark, d):
    """RET-04: phrase search with BM25 over all documents."""
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", PHRASE)


_SEARCH_OF = (
    "lit_ as (select entity_id, case when kind like 'configuration%' then 'exact_protocol_config' else 'literal' end match_type, 0.0 score from nodes n where exists (select 1 from files f where f.generation_id = n.generation_id and f.path = n.path and contains(lower(f.content), lower('<text>')))), "
    + _BM.format(key="entity_id", text="concat_ws(' ', label, kind, path)", src="nodes", needle="<words>", n="<n>").strip()
    + ", found as (select entity_id, match_type, min(score) score from (select entity_id, match_type, 0.0 score from exact union all select * from lit_ union all select id, 'lexical', score from bm) group by 1, 2), "
    "rows as (select f.entity_id, n.repo_id, n.label, n.path, coalesce(c.c, 1.0) confidence, match_type, score, case match_type when 'exact_symbol' then 0 when 'exact_identifier' then 1 when 'exact_path' then 2 when 'exact_protocol_config' then 3 when 'literal' then 4 when 'lexical' then 5 else 6 end class from found f join nodes n using (entity_id) left join conf c on c.id = lower(n.entity_id))"
)


def _search_sql(text: str) -> str:
    words = "  ".join(text.lower().split())
    return _SEARCH_OF.replace("<text>", text).replace("<words>", words).replace("<n>", str(len(words) + 2))


_SEARCH = _search_sql(LABEL)


@query(W(_NODES, _FACTS, _CONF, _FILES, _EXACT, _SEARCH) + "select entity_id, match_type, class, score, confidence from rows")
def search_union_ranked(spark, d):
    """RET-02, SET-06: exact, literal and full-text branches, least score per entity and match."""
    t = Tables(spark, d)
    return _search(t, LABEL).select("entity_id", "match_type", "class", "score", "confidence")


def _search(t: Tables, text: str) -> DataFrame:
    return retrieval.search(t.nodes, t.files_with(hit=retrieval.holds(text)).where("hit"), t.facts, text)


@query(W(_NODES, _FACTS, _CONF, _FILES, _EXACT_OF.replace("<text>", PAGED), _search_sql(PAGED)) + "select entity_id, match_type, class from rows order by class, case when match_type = 'lexical' then score end asc nulls first, confidence desc, repo_id, path, entity_id limit 20 offset 5")
def paginate_offset(spark, d):
    """SRT-01, SRT-10: one page of the search order."""
    t = Tables(spark, d)
    return retrieval.page(_search(t, PAGED), retrieval.search_order(), 5, 20).select("entity_id", "match_type", "class")


@query(W(_NODES, _FACTS, _UND) + f"select distinct n.entity_id, n.repo_id, n.kind, n.label, n.path from nodes n join und on und.src = n.entity_id join nodes m on m.entity_id = und.dst where lower(m.label) = lower('{LABEL}')")
def structural_exists(spark, d):
    """RET-05: entities with a claim whose other end has the label."""
    t = Tables(spark, d)
    named = t.nodes_where(F.lower("label") == LABEL.lower())
    near = graph.edges(t.facts_about(named)).join(named.select(F.col("entity_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("entity_id")).distinct()
    return current.present(t.entities.join(near, "entity_id", "left_semi"), "entity_id").select("entity_id", "repo_id", "kind", "label", "path")


@query(W(_NODES, _FACTS, _CONF) + "select entity_id, coalesce(c.c, 1.0) confidence from nodes n left join conf c on c.id = lower(n.entity_id)")
def confidence_coalesce(spark, d):
    """PRJ-01, AGG-01: greatest confidence at either end, 1 without claims."""
    t = Tables(spark, d)
    return retrieval.with_confidence(t.nodes, t.facts).select("entity_id", "confidence")


@query(W(_NODES, _FACTS, _CONF) + "select n.entity_id, n.repo_id, lower(n.kind) kind, lower(n.language) language from nodes n left join conf c on c.id = lower(n.entity_id) where repo_id = 'storefront-core' and lower(kind) in ('symbol:method', 'symbol:function') and lower(language) in ('java', 'kotlin', 'python') and coalesce(c.c, 1.0) >= 0.9")
def canonical_filters(spark, d):
    """FLT-01 to FLT-03: repository, kinds, languages and least confidence."""
    t = Tables(spark, d)
    hit = t.nodes.where("repo_id = 'storefront-core'").where(F.lower("kind").isin("symbol:method", "symbol:function") & F.lower("language").isin("java", "kotlin", "python"))
    return retrieval.with_confidence(hit, t.facts).where("confidence >= 0.9").select("entity_id", "repo_id", F.lower("kind").alias("kind"), F.lower("language").alias("language"))


@query(W(_ACTIVE) + "select r.revision_id, exists (select 1 from active a where a.generation_id = r.revision_id or a.git_commit = r.git_commit) as is_active from (select distinct revision_id, git_commit from ir_source_revisions) r")
def version_assert(spark, d):
    """FLT-04: which versions are active, by generation or commit."""
    t = Tables(spark, d)
    a = t.active
    known = a.select(F.col("generation_id").alias("v")).unionByName(a.select(F.col("git_commit").alias("v"))).distinct()
    rows = t.ir_source_revisions.select("revision_id", "git_commit").distinct().select("revision_id", F.explode(F.array("revision_id", "git_commit")).alias("v"))
    return rows.join(known.withColumn("hit", F.lit(True)), "v", "left").groupBy("revision_id").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("is_active"))


@query(W(_ACTIVE, _NODES) + "select a.repo, a.generation_id, count(n.entity_id)::bigint entities from active a left join nodes n using (generation_id) group by 1, 2")
def active_scan(spark, d):
    """SRC-19, JOIN-02: active generations with their entities; generations without any are kept."""
    t = Tables(spark, d)
    per = t.nodes.groupBy("generation_id").agg(F.count("*").alias("n"))
    return t.active.join(per, "generation_id", "left").select("repo", "generation_id", F.coalesce("n", F.lit(0)).alias("entities"))


_COS = "v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and vec_id is not null), q as (select vec_id query_id, e qe from v where vec_id % 50 = 0)"


@query(f"with {_COS}, c as (select query_id, vec_id, round(case when len(e) = len(qe) and list_dot_product(e, e) > 0 and list_dot_product(qe, qe) > 0 then list_cosine_similarity(e, qe) else 0 end, 6) cosine from v, q where vec_id <> query_id) select * from (select *, row_number() over (partition by query_id order by cosine desc, vec_id)::int as \"position\" from c) where \"position\" <= 20")
def vector_topk_cosine(spark, d):
    """RET-08, RET-11, SRT-04: the 20 nearest vectors (a top-k report) of every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return retrieval.top_cosine(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 20)


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_./:\\-]+')) w from documents),
h as (select doc_id, w, count(*) n, sha256(w) h from w group by 1, 2),
s as (select doc_id, ('0x' || substr(h, 1, 4))::int % 64 dim, sum(n * case when ('0x' || substr(h, 5, 2))::int % 2 = 1 then -1 else 1 end)::double s from h group by 1, 2)
select doc_id, dim, round(s / sqrt(sum(s * s) over (partition by doc_id)), 6) as "value" from s where s <> 0""")
def hash_embed(spark, d):
    """RET-09: feature-hashed, normalised embeddings of all documents."""
    return retrieval.hash_embedding(table(spark, d, "documents"), "doc_id", "text")


@query(W(_PROOFS) + "select sha256(coalesce(trim(excerpt), '') || chr(0)) text_digest, min(evidence_id) first_id, count(*)::bigint uses from proofs group by 1")
def embedding_cache_reuse(spark, d):
    """RET-12: each distinct text is embedded once; its first user and how many reuse it."""
    t = Tables(spark, d)
    return t.proofs.groupBy(ids.digest(F.coalesce(F.trim("excerpt"), F.lit(""))).alias("text_digest")).agg(F.min("evidence_id").alias("first_id"), F.count("*").alias("uses"))


_CAND = f"cand as (select entity_id, evidence_id, 'exact' source, 1 as rk, confidence from exact union all select n.entity_id, n.evidence_id, 'structural', 2, coalesce(c.c, 1.0) from nodes n left join conf c on c.id = lower(n.entity_id) where exists (select 1 from und join nodes m on m.entity_id = und.dst where und.src = n.entity_id and lower(m.label) = lower('{LABEL}')) union all select n.entity_id, n.evidence_id, 'lexical', 3, coalesce(c.c, 1.0) from nodes n left join conf c on c.id = lower(n.entity_id) where contains(lower(label), 'bucket'))"


def _candidates(t: Tables) -> DataFrame:
    conf = retrieval.with_confidence(t.nodes, t.facts).select("entity_id", "evidence_id", "label", "confidence")
    near = retrieval.structural(t.nodes, t.facts, LABEL).select("entity_id")
    e = retrieval.exact(t.nodes, t.facts, LABEL).select("entity_id", "evidence_id", F.lit("exact").alias("source"), F.lit(1).alias("rank"), "confidence")
    s = conf.join(near, "entity_id", "left_semi").select("entity_id", "evidence_id", F.lit("structural").alias("source"), F.lit(2).alias("rank"), "confidence")
    x = conf.where(F.contains(F.lower("label"), F.lit("bucket"))).select("entity_id", "evidence_id", F.lit("lexical").alias("source"), F.lit(3).alias("rank"), "confidence")
    return e.unionByName(s).unionByName(x)


_TIER = "case when list_contains(list(source), 'exact') then 0 when list_contains(list(source), 'structural') then 1 when list_contains(list(source), 'landmark') then 2 else 3 end"


@query(W(_NODES, _FACTS, _CONF, _UND, _EXACT, _CAND) + f"select entity_id, evidence_id, string_agg(distinct source, ',' order by source) sources, {_TIER} tier, max(confidence) confidence, min(rk) best_rank from cand group by 1, 2")
def fuse_rank(spark, d):
    """RET-13, RET-14: candidates of several retrievers fused by entity and evidence."""
    return retrieval.fuse(_candidates(Tables(spark, d)))


@query(W(_NODES, _FACTS, _CONF, _UND, _EXACT, _CAND) + "select * from (select entity_id, source, row_number() over (order by rk, entity_id, evidence_id) n, count(*) over () > 25 truncated from cand) where n <= 25")
def budgeted_add(spark, d):
    """RET-15: the first 25 candidates in retriever order, and whether more were cut (a budget)."""
    return retrieval.budgeted(_candidates(Tables(spark, d)), [F.col("rank"), F.col("entity_id"), F.col("evidence_id")], 25).select("entity_id", "source", "n", "truncated")


@query(W(_NODES) + "select lower(label) as label, count(distinct (repo_id, path, identity))::bigint places, case when count(distinct (repo_id, path, identity)) > 1 then 'unknown' else 'found' end state from nodes group by 1")
def resolve_ambiguity(spark, d):
    """RET-16: labels that name several places."""
    return retrieval.ambiguous(Tables(spark, d).nodes)


_BFS = "seeds as (select entity_id node from nodes where kind = 'route'), walk as (select node, 0 depth from seeds union select und.dst, depth + 1 from walk join und on und.src = walk.node where depth < {d})"


@query(W(_NODES, _FACTS, _UND, _BFS.format(d=3)) + "select node, min(depth) depth from walk group by node")
def graph_bfs_depth3(spark, d):
    """GRP-01, RET-06: what is reached from the routes of all repositories within three claims."""
    t = Tables(spark, d)
    seeds = t.nodes.where("kind = 'route'").select(F.col("entity_id").alias("node"))
    return graph.reach(seeds, graph.edges(t.facts), 3)


_NEIGH = "select src, dst, predicate, claim_id from (select e.*, row_number() over (partition by src order by predicate, dst, claim_id) n from ({e}) e where src in (select entity_id from nodes where kind in ('route', 'message_channel'))) where n <= 5"
_OUT = "select subject_id src, object_id dst, predicate, claim_id from facts where subject_id is not null and object_id is not null"
_IN = "select object_id src, subject_id dst, predicate, claim_id from facts where subject_id is not null and object_id is not null"


@query(W(_NODES, _FACTS) + _NEIGH.format(e=_OUT))
def neighbors_out(spark, d):
    """GRP-02, GRP-04: the first five outgoing claims of each route and channel (a fan-out)."""
    t = Tables(spark, d)
    return graph.neighbours(t.nodes.where("kind in ('route', 'message_channel')").select(F.col("entity_id").alias("node")), graph.edges(t.facts, "out"), 5)


@query(W(_NODES, _FACTS) + _NEIGH.format(e=_IN))
def neighbors_in_impact(spark, d):
    """GRP-05: the first five incoming claims."""
    t = Tables(spark, d)
    return graph.neighbours(t.nodes.where("kind in ('route', 'message_channel')").select(F.col("entity_id").alias("node")), graph.edges(t.facts, "in"), 5)


_REL = " union all ".join(f"select '{r}' relation, '{p}' predicate, '{w}' direction" for r, (p, w) in graph.RELATIONS.items())


@query(W(_FACTS) + f"select r.relation, r.direction, count(f.claim_id)::bigint claims from ({_REL}) r left join facts f on upper(f.predicate) = r.predicate group by 1, 2")
def references_alias(spark, d):
    """GRP-06: claims behind each named relation."""
    t = Tables(spark, d)
    rel = spark.createDataFrame([(r, p, w) for r, (p, w) in graph.RELATIONS.items()], "relation string, predicate string, direction string")
    per = t.facts.groupBy(F.upper("predicate").alias("predicate")).agg(F.count("*").alias("n"))
    return rel.join(per, "predicate", "left").select("relation", "direction", F.coalesce("n", F.lit(0)).alias("claims"))


@query(W(_NODES, _FACTS) + "select o.label, f.predicate, count(*)::bigint claims, count(distinct o.repo_id)::bigint repositories from facts f join nodes o on o.entity_id = f.object_id where regexp_matches(f.predicate, 'EVENT|TOPIC|QUEUE') group by 1, 2")
def events_by_label(spark, d):
    """GRP-07, FLT-09: event claims by the label of what they are about."""
    t = Tables(spark, d)
    o = t.nodes.select(F.col("entity_id").alias("object_id"), "label", "repo_id")
    return t.facts.where(F.col("predicate").rlike("EVENT|TOPIC|QUEUE")).join(o, "object_id").groupBy("label", "predicate").agg(F.count("*").alias("claims"), F.countDistinct("repo_id").alias("repositories"))


@query(W(_NODES, _FACTS, _UND, "s as (select entity_id node from nodes where kind = 'route'), g as (select entity_id node from nodes where kind = 'configuration_key'), walk as (select node as start, node, 0 hops from s union select walk.start, und.dst, hops + 1 from walk join und on und.src = walk.node where hops < 3)") + "select start, node as goal, min(hops) hops from walk where node in (select node from g) group by 1, 2 having min(hops) > 0")
def shortest_path_depth3(spark, d):
    """GRP-08: shortest paths from routes to configuration keys within three claims."""
    t = Tables(spark, d)
    pick = lambda c: t.nodes.where(c).select(F.col("entity_id").alias("node"))
    return graph.shortest_paths(pick("kind = 'route'"), pick("kind = 'configuration_key'"), graph.edges(t.facts), 3)


@query(W(_NODES, _FACTS, _PROOFS) + "select f.claim_id, s.label as subject, f.predicate, o.label as object, coalesce(v.path, '') as path, coalesce(v.start_line, 0) start_line from facts f join nodes s on s.entity_id = f.subject_id join nodes o on o.entity_id = f.object_id left join proofs v on v.evidence_id = f.evidence_id where s.kind = 'route' or o.kind = 'route'")
def explain_pair(spark, d):
    """GRP-09, GRP-11: claims of routes with both ends and their evidence."""
    t = Tables(spark, d)
    s = t.nodes.select(F.col("entity_id").alias("subject_id"), F.col("label").alias("subject"), F.col("kind").alias("sk"))
    o = t.nodes.select(F.col("entity_id").alias("object_id"), F.col("label").alias("object"), F.col("kind").alias("ok"))
    v = t.proofs.select("evidence_id", "path", "start_line")
    return t.facts.join(s, "subject_id").join(o, "object_id").where("sk = 'route' or ok = 'route'").join(v, "evidence_id", "left").select("claim_id", "subject", "predicate", "object", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("start_line", F.lit(0)).alias("start_line"))


_SL = graph.SLICES["event_topic_flow"][0]


@query(W(_NODES, _FACTS, "e as (select * from facts where upper(predicate) in (" + ", ".join(f"'{p}'" for p in _SL) + ") and subject_id is not null and object_id is not null), u2 as (select subject_id src, object_id dst from e union select object_id, subject_id from e), walk as (select entity_id node, 0 depth from nodes where kind = 'message_channel' union select u2.dst, depth + 1 from walk join u2 on u2.src = walk.node where depth < 2)") + "select node, min(depth) depth from walk group by node")
def slice_profile(spark, d):
    """GRP-10: the event flow around all channels, two claims deep."""
    t = Tables(spark, d)
    return graph.slice_of(t.nodes.where("kind = 'message_channel'").select(F.col("entity_id").alias("node")), t.facts, "event_topic_flow")


@query(W(_NODES, _FACTS, "v as (select entity_id from nodes where repo_id = 'storefront-core')") + "select claim_id, subject_id, object_id from facts where subject_id in (select entity_id from v) and object_id in (select entity_id from v)")
def visible_edges(spark, d):
    """JOIN-13, GRP-16: claims with both ends in a repository."""
    t = Tables(spark, d)
    return graph.visible(t.facts, t.nodes.where("repo_id = 'storefront-core'").select(F.col("entity_id").alias("node"))).select("claim_id", "subject_id", "object_id")


_KIND = "case " + " ".join(f"when upper(predicate) in ({', '.join(repr(p) for p in ps)}) then '{k}'" for k, ps in labels.IDENTITY_KINDS.items()) + " else '' end"
_DOTS = "array_to_string(list_filter(string_split(lower(translate(trim(label), '_-', '..')), '.'), lambda x: x <> ''), '.')"
_PARTS = "regexp_split_to_array(trim(label), '\\s+')"
_VERBS = ", ".join(f"'{v}'" for v in labels.VERBS)
_NORM = (
    "nullif(case when k in ('event', 'schema') then trim(label) when k in ('topic', 'queue', 'dependency') then lower(trim(label)) "
    f"when k = 'http_endpoint' then case when len({_PARTS}) = 2 and upper({_PARTS}[1]) in ({_VERBS}) and starts_with({_PARTS}[2], '/') then upper({_PARTS}[1]) || ' ' || case when {_PARTS}[2] = '/' then '/' else regexp_replace({_PARTS}[2], '/+$', '') end end "
    f"when k = 'configuration' then {_DOTS} end, '')"
)
_ROLE = f"case when upper(predicate) in ({', '.join(repr(p) for p in labels.PROVIDERS)}) then 'provider' when upper(predicate) in ({', '.join(repr(p) for p in labels.CONSUMERS)}) then 'consumer' else '' end"
_MEMBERS = f"m0 as (select {_KIND} k, n.label, f.predicate, n.repo_id, n.entity_id, f.confidence from facts f join nodes n on n.entity_id = f.object_id), members as (select k identity_kind, {_NORM} normalized, {_ROLE} as role, repo_id, entity_id, predicate, max(confidence) confidence from m0 where {_NORM} is not null group by all)"
_LINK = "case s.identity_kind " + " ".join(f"when '{k}' then '{p}'" for k, p in labels.LINKS.items()) + " else 'CROSS_REPOSITORY_LINK' end"


@query(W(_NODES, _FACTS, _MEMBERS) + "select * from members")
def identity_memberships(spark, d):
    """GRP-12: identities that claims' objects stand for, by repository and role."""
    t = Tables(spark, d)
    return linking.memberships(t.facts, t.nodes)


@query(W(_NODES, _FACTS, _MEMBERS) + f"select distinct 'x-' || sha256({_LINK} || chr(0) || s.entity_id || chr(0) || o.entity_id || chr(0)) link_id, {_LINK} predicate, s.entity_id subject_id, o.entity_id object_id, s.repo_id subject_repo, o.repo_id object_repo, least(s.confidence, o.confidence) confidence from (select identity_kind, normalized, repo_id, entity_id, max(confidence) confidence from members where role = 'provider' group by all) s join (select identity_kind, normalized, repo_id, entity_id, max(confidence) confidence from members where role = 'consumer' group by all) o using (identity_kind, normalized) where s.repo_id <> o.repo_id")
def cross_link(spark, d):
    """JOIN-09: providers and consumers of one identity in different repositories."""
    t = Tables(spark, d)
    return linking.links(linking.memberships(t.facts, t.nodes))


_EP = "case when upper(predicate) in ('DEFINES_CONFIGURATION', 'REFERENCES_CONFIGURATION') then 'configuration_key' when upper(predicate) = 'HAS_LOCAL_GUARD' then 'local_syntax_guard' when upper(predicate) = 'COVERAGE_GAP' then 'coverage_diagnostic' when regexp_matches(upper(predicate), 'ROUTE|ENDPOINT') then 'route' when regexp_matches(upper(predicate), 'EVENT|TOPIC|QUEUE') then 'message_channel' when regexp_matches(upper(predicate), 'EMITS_LOG|EMITS_ERROR') then 'emission_site' else 'reference' end"


@query(W(_FACTS) + f"select {_EP} endpoint_kind, predicate, count(*)::bigint claims from facts group by 1, 2")
def endpoint_kind_case(spark, d):
    """Kinds of the nodes at a claim's ends, by predicate."""
    return Tables(spark, d).facts.groupBy(labels.endpoint_kind(F.col("predicate")).alias("endpoint_kind"), "predicate").agg(F.count("*").alias("claims"))


@query(W(_NODES, _FACTS, _PROOFS) + "select 'subject_id' reference, count(*)::bigint dangling from facts where not exists (select 1 from nodes where entity_id = subject_id) having count(*) > 0 union all select 'object_id', count(*)::bigint from facts where not exists (select 1 from nodes where entity_id = object_id) having count(*) > 0 union all select 'evidence_id', count(*)::bigint from facts f where not exists (select 1 from proofs p where p.evidence_id = f.evidence_id) having count(*) > 0")
def dangling_refs(spark, d):
    """JOIN-06, IR-06: references of claims that lead nowhere."""
    t = Tables(spark, d)
    return coverage.dangling(t.facts, t.nodes, t.proofs)


@query(W(_NODES, _FILES) + "select coalesce(n.side, 'lookup') side, count(*)::bigint missing from (select 'entities' side, generation_id, path from nodes where kind = 'file' group by all) n full join (select generation_id, path from files group by all) f on f.generation_id = n.generation_id and f.path = n.path where n.path is null or f.path is null group by 1")
def lookup_completeness(spark, d):
    """JOIN-12: file entities without a file row, and file rows without an entity."""
    t = Tables(spark, d)
    a, b = t.nodes.where("kind = 'file'").select("generation_id", "path").distinct(), t.files.select("generation_id", "path").distinct()
    both = a.join(b, ["generation_id", "path"], "left_anti").select(F.lit("entities").alias("side")).unionByName(b.join(a, ["generation_id", "path"], "left_anti").select(F.lit("lookup").alias("side")))
    return both.groupBy("side").agg(F.count("*").alias("missing"))


_LANG = "case regexp_extract(lower(path), '\\.[^./]*$') " + " ".join(f"when '{e}' then '{v}'" for e, v in labels.LANGUAGES.items()) + " else 'text' end"
_STRUCT = ", ".join(f"'{x}'" for x in labels.STRUCTURAL)
_BASIS = f"e as (select repo_id, path, {_LANG} lang, case when content is null then 'unreadable' when contains(content, chr(0)) then 'unsupported' else 'included' end outcome from files), per as (select repo_id, count(*) files, count(*) filter (outcome <> 'included') not_included, count(*) filter (outcome = 'included' and lang not in ('configuration', 'documentation') and (lang <> 'text' or contains(path, '.')) and lang not in ({_STRUCT})) without_structure from e group by 1), dg as (select f.repo_id, count(*) diagnostics from compiler_diagnostics c join (select distinct generation_id, repo_id from files) f using (generation_id) group by 1), basis as (select repo_id, files, not_included, without_structure, coalesce(diagnostics, 0) diagnostics, not_included = 0 and without_structure = 0 and coalesce(diagnostics, 0) = 0 complete from per left join dg using (repo_id))"


@query(W(_FILES, _BASIS) + "select * from basis")
def coverage_basis(spark, d):
    """COV-01 to COV-03: what is lacking for completeness, per repository."""
    t = Tables(spark, d)
    return coverage.basis(t.files_with(**coverage.told()), t.compiler_diagnostics)


@query(W(_FILES, _BASIS, _NODES) + f"select b.repo_id, coalesce(h.hits, 0)::bigint hits, b.complete, case when coalesce(h.hits, 0) > 0 then 'found' when b.complete then 'not_found' else 'unknown' end state from basis b left join (select repo_id, count(*) hits from nodes where lower(label) = lower('{LABEL}') group by 1) h using (repo_id)")
def result_state(spark, d):
    """COV-04: found, not found or unknown in each repository."""
    t = Tables(spark, d)
    hits = t.nodes.where(F.lower("label") == LABEL.lower()).groupBy("repo_id").agg(F.count("*").alias("hits"))
    rows = coverage.basis(t.files_with(**coverage.told()), t.compiler_diagnostics).join(hits, "repo_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("repo_id", "hits", "complete", coverage.state(F.col("hits"), F.col("complete")).alias("state"))


@query(W(_ACTIVE, "neg as (select 'neg-' || sha256(repository_id || chr(0) || revision_id || chr(0)) negative_id, revision_id generation_id from ir_source_revisions where repository_id is not null)") + "select distinct negative_id from neg where generation_id not in (select generation_id from active)")
def negative_invalidation(spark, d):
    """COV-08, COV-09: recorded absences (one per revision) that depend on generations no longer active."""
    t = Tables(spark, d)
    neg = t.ir_source_revisions.where("repository_id is not null").select(ids.prefixed("neg-", "repository_id", "revision_id").alias("negative_id"), F.col("revision_id").alias("generation_id"))
    return coverage.stale_negatives(neg, t.active)


@query(W(_FILES) + "select source_id, 's-' || sha256(generation_id || chr(0) || path || chr(0) || sha256 || chr(0)) digest_id from files")
def digest_id(spark, d):
    """Identities as digests of NUL-ended parts."""
    return Tables(spark, d).files.select("source_id", ids.prefixed("s-", "generation_id", "path", "sha256").alias("digest_id"))


@query(W(_NODES) + "select entity_id, 'kb.e1.' || rtrim(translate(to_base64(encode('{\"T\":\"e\",\"G\":\"' || generation_id || '\",\"I\":\"' || entity_id || '\"}')), '+/', '-_'), '=') handle from nodes")
def handle_encode(spark, d):
    """PRJ-06: opaque handles."""
    return Tables(spark, d).nodes.select("entity_id", ids.handle("e", "generation_id", "entity_id").alias("handle"))


@query("select generation_id, path, name, start_line, min(extractor) extractor, count(*)::bigint copies from symbols group by 1, 2, 3, 4")
def first_wins_dedup(spark, d):
    """SET-04, IR-01: one row per symbol, the first extractor by name."""
    return table(spark, d, "symbols").groupBy("generation_id", "path", "name", "start_line").agg(F.min("extractor").alias("extractor"), F.count("*").alias("copies"))


@query(W(_NODES) + "select distinct 'ce-' || sha256(repo_id || chr(0) || kind || chr(0) || case when identity = '' then concat_ws(':', 'syntax', language, path, kind, label) else identity end || chr(0)) canonical_id, label from nodes")
def canonical_aliases(spark, d):
    """IR-02: labels of identities that outlive generations; an empty identity gets its default."""
    own = F.when(F.col("identity") == "", F.concat_ws(":", F.lit("syntax"), "language", "path", "kind", "label")).otherwise(F.col("identity"))
    return Tables(spark, d).nodes.select(ids.prefixed("ce-", "repo_id", "kind", own).alias("canonical_id"), "label").distinct()


_LM_WANTED = "'DEPENDENCY_DECLARATION','DECLARES_MODULE','DECLARES_EFFECTIVE_ENDPOINT','DECLARES_ENDPOINT','DECLARES_UI_ROUTE','PUBLISHES_EVENT','CONSUMES_EVENT','PRODUCES_TOPIC','CONSUMES_TOPIC','SENDS_QUEUE','LISTENS_QUEUE','DEFINES_CONFIGURATION','REFERENCES_CONFIGURATION','BINDS_CONFIGURATION'"


@query(W(_NODES, _FACTS, _FILES, "anch as (select f.repo_id, f.generation_id, f.path from (select distinct repo_id, generation_id, path from files) f join nodes n on n.generation_id = f.generation_id and n.path = f.path and n.kind = 'file' and n.evidence_id is not null), told as (select f.*, s.repo_id, s.label s_label from facts f join nodes s on s.entity_id = f.subject_id)") + f"""
select 'repository_summary' landmark_kind, repo_id, repo_id as label, 1.0 confidence, count(distinct (generation_id, path))::bigint records from anch group by repo_id
union all select 'service_summary', repo_id, s_label, 0.9, count(*) from told where predicate in ('DECLARES_EFFECTIVE_ENDPOINT','DECLARES_UI_ROUTE','PUBLISHES_EVENT','PRODUCES_TOPIC','SENDS_QUEUE') group by repo_id, s_label
union all select case when predicate in ('DEPENDENCY_DECLARATION','DECLARES_MODULE') then 'dependency' when contains(predicate, 'CONFIGURATION') then 'boundary' else 'contract' end, told.repo_id, predicate || ': ' || o.label, max(confidence), count(*) from told join nodes o on o.entity_id = told.object_id where predicate in ({_LM_WANTED}) group by 1, 2, 3
union all select 'test_anchor', repo_id, path, 0.9, count(*) from anch where lower(path) like '%\\_test.go' escape '\\' or lower(path) like '%.test.ts' or lower(path) like '%.spec.ts' or lower(path) like '%/test/%' or lower(path) like '%/tests/%' group by repo_id, path""")
def landmarks_union(spark, d):
    """IR-09: precomputed landmarks of all kinds."""
    t = Tables(spark, d)
    return history.landmarks(t.files, t.nodes, t.facts)


_OLD = _ACTIVE.replace("active as", "old as").replace("from ir_source_revisions)", "from ir_source_revisions where indexed_at < timestamp '2025-01-01')")


@query(W(_ACTIVE, _OLD) + "select coalesce(n.repo, o.repo) repo, case when o.repo is null then 'added' when n.repo is null then 'removed' when o.generation_id <> n.generation_id then 'changed' else 'unchanged' end as \"change\" from active n full join old o on o.repo = n.repo")
def landmark_changed_repos(spark, d):
    """IR-10, JOIN-03: repositories whose generation changed since a date."""
    t = Tables(spark, d)
    old = current.active_generations(t.ir_source_revisions.where("indexed_at < timestamp_ntz '2025-01-01 00:00:00'"))
    return history.changed_repositories(old, t.active)


@query(W(_ACTIVE) + "select sha256(coalesce(array_to_string(list_sort(list(distinct generation_id)), ','), '')) fingerprint, count(distinct generation_id)::bigint generations from active")
def catalog_fingerprint(spark, d):
    """AGG-08: one digest of all active generations."""
    return history.fingerprint(Tables(spark, d).active)


@query("select user_id, arg_max(event_type, (ts, event_id)) state, max(ts) as \"at\", count(*)::bigint as \"events\" from events where user_id is not null group by 1")
def queue_last_state(spark, d):
    """IR-21: the last state of each queue."""
    return history.last_states(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query("select user_id, event_type, props, min(event_id) event_id, count(*)::bigint copies, sha256(user_id::varchar || chr(0) || event_type || chr(0) || props || chr(0)) event_digest from events group by 1, 2, 3")
def event_dedup(spark, d):
    """STR-07: idempotent insert of events."""
    return history.first_events(table(spark, d, "events"), ["user_id", "event_type", "props"], "event_id")


@query("with g as (select user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > 3600000000)::int, 1) n from events where user_id is not null and ts is not null), b as (select *, sum(n) over (partition by user_id order by ts) burst from g) select user_id, min(ts) as \"first\", max(ts) as \"last\", count(*)::bigint as \"events\", epoch_us(max(ts)) - epoch_us(min(ts)) > 14400000000 capped from b group by user_id, burst")
def debounce_sessions(spark, d):
    """STR-03: bursts with an hour of quiet between them, told where longer than four hours."""
    return history.debounced(table(spark, d, "events"), "user_id", "ts", 3600, 14400)


@query("with a as (select event_id, event_id % 7 + 1 attempt from events) select event_id, attempt::int attempt, case when attempt < 5 then least(900, 30 * pow(2, attempt - 1)::int) else -1 end wait_s, attempt >= 5 exhausted from a")
def retry_backoff(spark, d):
    """STR-05: waits that double up to a cap, until attempts are used up."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 + 1).cast("int").alias("attempt"))
    return history.backoff(rows, "attempt").withColumn("wait_s", F.coalesce("wait_s", F.lit(-1)))


@query(f"with r as (select {_T % 'repository_id'} repo, revision_id generation_id, max(indexed_at) t from ir_source_revisions group by 1, 2) select repo, generation_id, row_number() over (partition by repo order by t desc, generation_id desc)::int as \"position\", row_number() over (partition by repo order by t desc, generation_id desc) <= 3 kept from r where repo <> ''")
def retention_topn(spark, d):
    """IR-18, SRT-13: generations kept per repository."""
    return history.retained(table(spark, d, "ir_source_revisions"))


@query(W(_FACTS, _ACTIVE) + "select sha256(coalesce(subject_id, '') || chr(0) || predicate || chr(0) || coalesce(object_id, '') || chr(0) || derivation || chr(0)) fact, count(distinct f.generation_id)::bigint observations, bool_or(a.generation_id is not null) active from facts f left join active a using (generation_id) group by 1")
def fact_lifecycle(spark, d):
    """IR-17: facts that an active generation still observes."""
    t = Tables(spark, d)
    return history.fact_lifecycle(t.facts, t.active)


@query(W(_NODES, "a as (select repo_id, case when contains(path, '/') then split_part(path, '/', 1) else '.' end area, path from nodes where path <> '')") + "select case grouping(repo_id, area) when 0 then 'area' when 1 then 'repository' else 'estate' end as \"level\", coalesce(repo_id, '') repo_id, coalesce(area, '') area, count(*)::bigint entities, count(distinct path)::bigint files from a group by rollup (repo_id, area)")
def cloud_rollup(spark, d):
    """AGG-05, AGG-06: counts of the estate, repositories and areas in one pass."""
    return history.rollup(Tables(spark, d).nodes)


_MARK = r"(^|/)(package(-lock)?\.json|[^/]*lock\.(json|yaml))$"


@query(W(_FILES, f"""o as (select distinct repo_id, path from files), mk as (select distinct repo_id, case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '' end module from o where regexp_matches(lower(path), '{_MARK}')),
j as (select o.repo_id, o.path, arg_max(module, length(module)) module from o join mk on mk.repo_id = o.repo_id and (module = '' or starts_with(o.path, module || '/')) group by 1, 2)""") + "select o.repo_id, o.path, coalesce(nullif(j.module, ''), case when contains(o.path, '/') then split_part(o.path, '/', 1) else '.' end) as \"module\" from o left join j using (repo_id, path)")
def longest_prefix_module(spark, d):
    """JOIN-08: the deepest directory with a manifest above each file."""
    return history.module_of(Tables(spark, d).files, _MARK)


@query(W(_PROOFS) + "select evidence_id, path, start_line, end_line from proofs where start_line <= 30 and end_line >= 10")
def line_overlap_claims(spark, d):
    """FLT-15, JOIN-07: evidence that touches the lines 10 to 30."""
    return history.overlapping(Tables(spark, d).proofs.select("evidence_id", "path", "start_line", "end_line"), 10, 30)


@query(W(_PROOFS, _FILES, "f as (select generation_id, path, string_split(content, chr(10)) ls from files where content is not null), x as (select v.evidence_id, v.generation_id, v.path, v.start_line, v.end_line, greatest(1, v.start_line - 2) lo, ls from proofs v join f using (generation_id, path))") + "select evidence_id, generation_id, path, start_line, end_line, lo as first_line, least(least(end_line + 2, len(ls)) - lo + 1, 40)::int as \"lines\", array_to_string(ls[lo:lo + greatest(0, least(least(end_line + 2, len(ls)) - lo + 1, 40)) - 1], chr(10)) excerpt from x where lo <= len(ls)")
def source_lines_slice(spark, d):
    """PRJ-02, PRJ-03: source lines around evidence."""
    t = Tables(spark, d)
    return history.source_lines(t.files, t.proofs.select("evidence_id", "generation_id", "path", "start_line", "end_line"))


@query(W(_FILES) + "select source_id, path, length(content) - length(replace(content, chr(10), '')) + 1 as \"lines\" from files where content is not null")
def line_count(spark, d):
    """PRJ-04: lines of each file."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    return Tables(spark, d).files_with(lines=lines.cast("long")).where("lines is not null").select("source_id", "path", "lines")


_LINES = "l as (select repo_id, path, " + _LANG + " lang, unnest(string_split(content, chr(10))) t, generate_subscripts(string_split(content, chr(10)), 1) line from files where content is not null)"


@query(W(_FILES, _LINES) + f"select repo_id, path, line::int line, t as \"text\" from l where contains(t, '{NEEDLE}')")
def line_literal_baseline(spark, d):
    """RET-21, RET-22: lines that hold a text as written."""
    return evaluation.line_baseline(Tables(spark, d).files_with(content=F.when(F.contains("content", F.lit(NEEDLE)), F.col("content"))), NEEDLE)


_BLOCK = f"list_bool_or(list_transform(string_split(lower(path), '/'), lambda s: s in ({', '.join(repr(x) for x in discover.BLOCKED_DIRS)}, '.env') or starts_with(s, '.env.') or " + " or ".join(f"contains(s, '{w}')" for w in discover.BLOCKED_WORDS) + "))"
_REASON = f"case when {_BLOCK} then case when regexp_matches(lower(path), '(build|dist|target)/') then 'generated' when regexp_matches(lower(path), '(vendor|node_modules)/') then 'vendor' else 'built_in_policy' end when regexp_matches(path, '^docs/(?:[^/]+/)*[^/]+$') then 'catalog_pattern' when content is null then 'unreadable' when strlen(content) > 8000 then 'file_too_large' when contains(content, chr(0)) then 'binary' else '' end"
_SCAN = f"scan as (select repo_id, path, {_LANG} as \"language\", case when regexp_matches(lower(path), '\\.(md|adoc|txt|rst)$') then 'documentation' else 'source' end classification, strlen(coalesce(content, ''))::bigint as \"size\", sha256(coalesce(content, '')) sha256, {_REASON} reason from files)"
_OUTCOME = "case when reason = '' then 'included' when reason = 'unreadable' then 'unreadable' when reason = 'binary' then 'unsupported' else 'excluded' end"


def _scan(spark, d):
    return discover.scan(Tables(spark, d).files_with(**discover.told()), 8000, exclude=("docs/**",))


@query(W(_FILES, _SCAN) + f"select repo_id, path, \"language\", classification, \"size\", sha256, {_OUTCOME} outcome, reason from scan")
def scan_coverage(spark, d):
    """SRC-01 to SRC-13: one outcome row per file."""
    return _scan(spark, d)


@query(W(_FILES, _SCAN) + "select reason, count(*)::bigint files from scan where reason <> '' group by 1")
def exclusion_counts(spark, d):
    """SRC-03: how many files each reason keeps out."""
    return _scan(spark, d).where("outcome <> 'included'").groupBy("reason").agg(F.count("*").alias("files"))


@query(W(_FILES) + f"select {_LANG} as \"language\", count(*)::bigint files from files group by 1")
def language_tag(spark, d):
    """SRC-08: files by language of their extension."""
    return Tables(spark, d).files.groupBy(labels.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@query(W(_FILES) + "select repo_id, path from files where regexp_matches(path, '^src/(?:[^/]+/)*[^/]*Service\\.[^/]*$') group by all")
def glob_filter(spark, d):
    """SRC-07: a glob whose ** spans directories."""
    return Tables(spark, d).files.where(discover.matches_glob(F.col("path"), "src/**/*Service.*")).select("repo_id", "path").distinct()


@query(W(_FILES) + "select repo_id, sha256(string_agg(path || chr(0) || sha256 || chr(0), '' order by path, sha256)) snapshot from files group by 1")
def content_snapshot(spark, d):
    """SRC-13, IR-23: one digest of a repository's paths and hashes; only (path, hash) pairs meet."""
    return Tables(spark, d).files.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("x")).select("repo_id", F.sha2(F.array_join(F.transform("x", lambda s: F.concat(s["path"], F.chr(F.lit(0)), s["sha256"], F.chr(F.lit(0)))), ""), 256).alias("snapshot"))


_CHG = "chg as (select repo_id, path from files where ingested_at >= (select max(ingested_at) - interval 30 day from files) group by all)"


def _recent(t: Tables) -> DataFrame:
    last = t.files.agg((F.max("ingested_at") - F.expr("interval 30 days")).alias("since"))
    return t.files.join(F.broadcast(last), F.col("ingested_at") >= F.col("since")).select("repo_id", "path").distinct()


@query(W(_FILES, _CHG, _NODES, _FACTS, "ins as (select entity_id from nodes join chg using (repo_id, path)), oth as (select subject_id e from facts where object_id in (select entity_id from ins) union select object_id from facts where subject_id in (select entity_id from ins))") + "select repo_id, path from chg union select repo_id, path from nodes where entity_id in (select e from oth)")
def affected_paths(spark, d):
    """IR-13: recently changed paths and the files one claim away."""
    t = Tables(spark, d)
    return discover.affected_paths(_recent(t), t.facts, t.nodes)


@query(W(_FILES, _CHG) + "select repo_id, case when bool_or(regexp_matches(lower(path), '(^|/)(tsconfig[^/]*\\.json|package\\.json|pom\\.xml|[^/]+\\.gradle(\\.kts)?)$')) then 'full' else 'affected' end scope from chg group by 1")
def rebuild_scope(spark, d):
    """IR-14: which repositories must be rebuilt in full."""
    return discover.rebuild_scope(_recent(Tables(spark, d)))


@query(W(_FILES, _LINES) + "select repo_id, path, line::int line, trim(regexp_extract(trim(t), '^([^:=#]+?)\\s*[:=]', 1)) as \"key\" from l where regexp_matches(lower(path), '\\.(ya?ml|properties)$') and trim(t) <> '' and not starts_with(trim(t), '#') and trim(regexp_extract(trim(t), '^([^:=#]+?)\\s*[:=]', 1)) <> ''")
def config_lines_extract(spark, d):
    """EXT-17: keys that configuration files define."""
    return extract.configuration_keys(Tables(spark, d).files_with(content=F.when(extract.is_configuration(F.col("path")), F.col("content"))))


@query(W(_FILES, "j as (select repo_id, path, content::json c from files where lower(path) like '%.json' and json_valid(content))") + "select distinct repo_id, path, unnest(coalesce(json_keys(c, '$.dependencies'), []) || coalesce(json_keys(c, '$.devDependencies'), []) || coalesce(json_keys(c, '$.packages'), [])) dependency from j")
def manifest_json_extract(spark, d):
    """EXT-18: dependencies named in JSON manifests and lock files."""
    return extract.manifest_dependencies(Tables(spark, d).files_with(content=F.when(F.lower("path").endswith(".json"), F.col("content"))))


_SQLRE = r"""(?i)["''`]\s*((?:select\s[^"''`]+?\sfrom|delete\s+from|insert\s+into|update)\s+[A-Za-z_][\w$.]*)"""


@query(W(_FILES, _LINES, f"s as (select repo_id, path, line, unnest(regexp_extract_all(t, '{_SQLRE}', 1)) s from l)") + "select repo_id, path, line::int line, regexp_extract(s, '([A-Za-z_][\\w$.]*)$', 1) sql_table, case when starts_with(lower(s), 'select') then 'READS_TABLE' else 'WRITES_TABLE' end access from s")
def sql_table_extract(spark, d):
    """EXT-19: tables named in SQL strings."""
    return extract.sql_tables(Tables(spark, d).files)


def _rule_sql() -> str:
    parts = []
    for langs, pattern, group, predicate, conf in extract.RULES:
        p = pattern.replace("'", "''")
        parts.append(f"select repo_id, path, line::int line, unnest(regexp_extract_all(t, '{p}', {group})) target, '{predicate}' predicate, {conf}::double confidence from l where lang in ({', '.join(repr(x) for x in langs)})")
    return "select * from (" + " union all ".join(parts) + ") where target <> ''"


@query(W(_FILES, _LINES) + _rule_sql())
def syntax_relationships(spark, d):
    """EXT-02 to EXT-14: relationships told by source lines."""
    return extract.relationships(Tables(spark, d).files)


_CASES = "cases as (select label as \"case\", rank() over (partition by label order by confidence desc, entity_id) rk, relevant from (select n.label, n.entity_id, coalesce(c.c, 1.0) confidence, n.kind in ('symbol:method', 'symbol:function') relevant from nodes n left join conf c on c.id = lower(n.entity_id)))"


def _cases(t: Tables) -> DataFrame:
    rows = retrieval.with_confidence(t.nodes, t.facts).select(F.col("label").alias("case"), "entity_id", "confidence", F.col("kind").isin("symbol:method", "symbol:function").alias("relevant"))
    return ranking.ranks(rows, "case", [F.desc("confidence"), F.col("entity_id")])


@query(W(_NODES, _FACTS, _CONF, _CASES, 'per as (select "case", min(rk) filter (relevant) first, count(*) filter (relevant) al, count(*) filter (relevant and rk <= 5) top, sum(1 / log2(rk + 1.0)) filter (relevant) dcg from cases group by 1)') + "select count(*)::bigint cases, round(avg(coalesce(1.0 / first, 0.0)), 6) mrr, round(avg(coalesce((first = 1)::int::double, 0.0)), 6) precision_at_1, round(avg(coalesce(case when al > 0 then top::double / al end, 0.0)), 6) recall_at_5, round(avg(coalesce(case when al > 0 then dcg / list_sum(list_transform(generate_series(1, al), lambda k: 1 / log2(k + 1.0))) end, 0.0)), 6) ndcg from per")
def metrics_mrr_ndcg(spark, d):
    """AGG-11: retrieval quality with each label as a case."""
    return evaluation.quality(_cases(Tables(spark, d)))


@query("select event_type, count(*)::bigint n, quantile_disc(\"value\", 0.95) percentile from events where \"value\" is not null group by 1")
def percentile_p95(spark, d):
    """AGG-12: nearest-rank percentile."""
    return evaluation.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query(W(_PROOFS, "r as (select repo_id, evidence_id, ceil(strlen(coalesce(excerpt, '')) / 4.0)::bigint tokens, row_number() over (partition by repo_id order by start_line, evidence_id) n from proofs), s as (select *, sum(tokens) over (partition by repo_id order by n) total from r where n <= 8)") + "select repo_id, evidence_id, n::int n, tokens, total::bigint total from s where total <= 400")
def context_limits(spark, d):
    """IR-24, SRT-15: evidence that fits a context of eight rows and 400 tokens per repository (a budget)."""
    p = Tables(spark, d).proofs
    return evaluation.packed(p, "repo_id", [F.col("start_line"), F.col("evidence_id")], "excerpt", 8, 400).select("repo_id", "evidence_id", "n", "tokens", "total")


@query(W(_NODES) + "select * from (select entity_id, repo_id, path, (row_number() over (order by repo_id, path, entity_id) - 1)::bigint as \"position\" from nodes) where entity_id in (select entity_id from nodes where kind = 'route') ")
def rank_position_seek(spark, d):
    """SRT-14: how many rows come before each route in the listing order."""
    n = Tables(spark, d).nodes.select("entity_id", "repo_id", "path", "kind")
    rows = ranking.positions(n, [F.col("repo_id"), F.col("path"), F.col("entity_id")])
    return rows.where("kind = 'route'").select("entity_id", "repo_id", "path", "position")


@query(W(_NODES) + "select kind, language, count(*)::bigint n from nodes where kind in (select kind from nodes where repo_id = 'storefront-core' intersect select kind from nodes where repo_id <> 'storefront-core') group by 1, 2")
def algebra_intersect(spark, d):
    """SET-07, SET-08: the algebra's intersection, as semi-joins on the key."""
    n = Tables(spark, d).nodes
    a, b = n.where("repo_id = 'storefront-core'").select("kind").distinct(), n.where("repo_id <> 'storefront-core'").select("kind").distinct()
    return n.join(a.join(b, "kind", "left_semi"), "kind", "left_semi").groupBy("kind", "language").agg(F.count("*").alias("n"))


def _declaration_sql() -> str:
    return " union all ".join(f"select repo_id, path, line::int line, '{kind}' kind, regexp_extract(t, '{pattern}', 1) as \"name\" from l where lang in ({', '.join(repr(x) for x in langs)}) and regexp_extract(t, '{pattern}', 1) <> ''" for langs, kind, pattern in extract.DECLARATIONS)


@query(W(_FILES, _LINES) + _declaration_sql())
def declarations_extract(spark, d):
    """EXT-01: declarations told by the heads of lines."""
    return extract.declarations(Tables(spark, d).files)


@query(W(_FILES, _LINES, f"decl as (select repo_id, path, line, min(\"name\") nm from ({_declaration_sql()}) group by all)", "hit as (select repo_id, path, line::int line from l where contains(t, 'throw '))") + "select h.repo_id, h.path, h.line, coalesce((select arg_max(nm, line) from decl x where x.repo_id = h.repo_id and x.path = h.path and x.line <= h.line), '<file>') scope from hit h")
def nearest_symbol(spark, d):
    """EXT-21: the declaration that each thrown error lies in."""
    f = Tables(spark, d).files
    rows = extract.lines(f).where(F.contains("text", F.lit("throw "))).select("repo_id", "path", "line")
    return extract.nearest_declaration(rows, extract.declarations(f))


@query(W(_FILES) + """select distinct 'e-' || sha256(generation_id || chr(0) || kind || chr(0) || identity || chr(0) || path || chr(0)) entity_id, kind, label, path from (
select generation_id, 'file' kind, path as label, 'file:' || path identity, path from files
union all select s.generation_id, 'symbol:' || s.kind, s.name, case when s.identity = '' then concat_ws(':', 'syntax', s.path, s.kind, s.name, s.start_byte::varchar) else s.identity end, s.path from symbols s where exists (select 1 from files f where f.generation_id = s.generation_id and f.path = s.path))""")
def materialized_nodes(spark, d):
    """IR-01: nodes of files and symbols with their digests."""
    t = Tables(spark, d)
    return materialize.nodes(t.files, t.symbols)


@query(W(_FILES) + "select path, count(*)::bigint symbols from symbols s where not exists (select 1 from files f where f.generation_id = s.generation_id and f.path = s.path) group by 1")
def source_not_indexed(spark, d):
    """EXT-23: symbols of paths without a file."""
    t = Tables(spark, d)
    return materialize.not_indexed(t.symbols, t.files)


_CODES = ("TS1005", "TS1109", "TS1128", "TS1185", "SyntaxError", "IndentationError", "parse_error", "source_not_indexed")


@query(f"select case when code in ({', '.join(repr(c) for c in _CODES)}) then code else 'other' end code, case when path <> '' then 'h_' || substr(sha256(path), 1, 24) else '' end path_hash, count(*)::bigint as \"events\" from compiler_diagnostics group by 1, 2")
def diagnostics_sanitized(spark, d):
    """IR-27: diagnostics without names."""
    return materialize.sanitized(table(spark, d, "compiler_diagnostics"), _CODES)


@query(W(_FILES) + "select source_id as \"key\" from (select source_id, row_number() over (order by ingested_at desc, source_id desc) n, sum(\"size\") over (order by ingested_at desc, source_id desc rows unbounded preceding) s from files) where n > 400 or s > 900000")
def cache_victims(spark, d):
    """SRT-17: what a bounded cache of files would drop, oldest first."""
    return materialize.evicted(Tables(spark, d).files, "source_id", "ingested_at", "size", 400, 900_000)
