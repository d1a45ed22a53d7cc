"""Queries of the general data-quality problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.orphans import orphan_report, orphans
from .operators.snapshots import snapshot_changes
from .session import WHITE_SPACE, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEY = f"lower(trim(%s, '{WHITE_SPACE}'))"
_REFS = [("claims", "claim_id", "subject_id", "ingested_at", "entities"), ("claims", "claim_id", "object_id", "ingested_at", "entities"), ("entities", "entity_id", "evidence_id", "ingested_at", "evidence"), ("ir_source_revisions", "revision_id", "repository_id", "indexed_at", "ir_repositories")]
_TARGETS = [("entities", "entity_id", "ingested_at"), ("evidence", "evidence_id", "ingested_at"), ("ir_repositories", "repository_id", "created_at")]
_ORPHANS = (
    "with r as ("
    + " union all ".join(
        f"select distinct '{t}' ref_table, '{f}' ref_field, {i} record_id, {_KEY % f} k, min({at}) over (partition by {i}) seen, '{to}' tt from {t} where {i} is not null" for t, i, f, at, to in _REFS
    )
    + "), g as ("
    + " union all ".join(f"select '{t}' tt, {_KEY % k} k, min({at}) since, min(deleted_at) until from {t} group by 2" for t, k, at in _TARGETS)
    + "), o as (select r.*, r.k as key from r left join g on r.tt = g.tt and r.k = g.k where r.k <> '' and (g.k is null or g.since > r.seen or coalesce(g.until <= r.seen, false))) "
)


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("claims", "entities", "evidence", "ir_source_revisions", "ir_repositories")}


@query(_ORPHANS + "select distinct ref_table, ref_field, record_id from o")
def p3_found(spark, d):
    """Orphan references: one row per table, field and record."""
    return orphans(_tables(spark, d)).select("ref_table", "ref_field", "record_id").distinct()


@query(_ORPHANS + "select ref_table, ref_field, strftime(seen, '%Y-%m') as period, count(*)::bigint as orphans, count(distinct key)::bigint as keys from o group by 1, 2, 3")
def p3_report(spark, d):
    """Orphan references per table, field and month."""
    return orphan_report(_tables(spark, d))


_CHANGES = r"""
with m as (
  select repo_id, snapshot_no, regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') as path,
         lower(regexp_replace(trim(sha256), '^[A-Za-z0-9_-]+[:=]', '')) as sha, delivered_at
  from file_manifests where path is not null),
f as (select * from m qualify row_number() over (partition by repo_id, snapshot_no, path order by delivered_at desc nulls last, sha desc nulls last) = 1),
d as (select repo_id, snapshot_no, lag(snapshot_no) over (partition by repo_id order by snapshot_no) as before from (select distinct repo_id, snapshot_no from snapshot_deliveries)),
o as (select d.repo_id, d.snapshot_no, f.path, f.sha from d join f on f.repo_id = d.repo_id and f.snapshot_no = d.before),
n as (select d.repo_id, d.snapshot_no, f.path, f.sha from d join f on f.repo_id = d.repo_id and f.snapshot_no = d.snapshot_no where d.before is not null),
j as (select coalesce(n.repo_id, o.repo_id) repo_id, coalesce(n.snapshot_no, o.snapshot_no) snapshot_no, n.path np, o.path op, n.sha ns, o.sha os
      from o full join n on o.repo_id = n.repo_id and o.snapshot_no = n.snapshot_no and o.path = n.path),
a as (select repo_id, snapshot_no, ns, min(np) np, count(*) c from j where op is null group by 1, 2, 3),
ren as (select j.repo_id, j.snapshot_no, a.np as path, j.op as old_path, j.os sha from j join a on a.repo_id = j.repo_id and a.snapshot_no = j.snapshot_no and a.ns = j.os where j.np is null and a.c = 1),
c as (
  select repo_id, snapshot_no, 'modified' as kind, np as path, '' as old_path, ns sha256 from j where np is not null and op is not null and ns is distinct from os
  union all select repo_id, snapshot_no, 'renamed', path, old_path, sha from ren
  union all select repo_id, snapshot_no, 'removed', op, '', os from j where np is null and not exists (select 1 from ren where ren.repo_id = j.repo_id and ren.snapshot_no = j.snapshot_no and ren.old_path = j.op)
  union all select repo_id, snapshot_no, 'added', np, '', ns from j where op is null and not exists (select 1 from ren where ren.repo_id = j.repo_id and ren.snapshot_no = j.snapshot_no and ren.path = j.np))
"""


@query(_CHANGES + "select repo_id, snapshot_no, kind, path, old_path from c")
def p4_found(spark, d):
    """File changes of each delivery against the one before."""
    return snapshot_changes(table(spark, d, "file_manifests"), table(spark, d, "snapshot_deliveries")).select("repo_id", "snapshot_no", "kind", "path", "old_path")


@query(_CHANGES + "select repo_id, snapshot_no, kind, count(*)::bigint as changes, count(distinct sha256)::bigint as contents from c group by 1, 2, 3")
def p4_counts(spark, d):
    """Changes per repository, delivery and kind."""
    rows = snapshot_changes(table(spark, d, "file_manifests"), table(spark, d, "snapshot_deliveries"))
    return rows.groupBy("repo_id", "snapshot_no", "kind").agg(F.count("*").alias("changes"), F.countDistinct("sha256").alias("contents"))
