import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryframe.operators.orphans import Reference, Target, orphan_report, orphans
from quarryframe.operators.snapshots import snapshot_changes

T0 = datetime(2025, 1, 1)
CLAIMS = "claim_id string, subject_id string, object_id string, ingested_at timestamp_ntz, extra string, key string, at int, heavy int"
ENT = "entity_id string, evidence_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, since int, until int"
EV = "evidence_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
REV = "revision_id string, repository_id string, indexed_at timestamp_ntz"
REP = "repository_id string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def tables(spark, claims=(), entities=(), evidence=(), revisions=(), repositories=()):
    make = lambda rows, schema: spark.createDataFrame([tuple(r) + (None,) * (schema.count(",") + 1 - len(r)) for r in rows], schema)
    return {"claims": make(claims, CLAIMS), "entities": make(entities, ENT), "evidence": make(evidence, EV), "ir_source_revisions": make(revisions, REV), "ir_repositories": make(repositories, REP)}


def cases(df):
    return sorted((r.ref_table, r.ref_field, r.record_id) for r in df.collect())


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_orphans_by_time(spark, heavy):
    d = lambda n: T0 + timedelta(days=n)
    t = tables(
        spark,
        claims=[("c1", " E1 ", "e2", d(5)), ("c1", " E1 ", "e2", d(50)), ("c2", "", None, d(5)), ("c3", "e9", "e1", d(5)), ("c4", "e3", "e1", d(5)), ("c5", "e4", "e1", d(5)), (None, "e9", "e9", d(5)), ("c6", "e9", "e9", None), ("c7", "e4", "\tE1\n", d(3))],
        entities=[("e1", None, d(1)), ("e2", "v1", d(9)), ("E3", "  ", d(1), None), ("e3", None, d(2), d(5)), ("e4", "v0", d(1), d(4))],
        evidence=[("V1", d(9), None)],
        revisions=[("g1", "A", d(1)), ("g2", "b", d(1))],
        repositories=[("a ", d(1), None)],
    )
    got = cases(orphans(t, heavy_from=heavy))
    assert got == [("claims", "object_id", "c1"), ("claims", "subject_id", "c3"), ("claims", "subject_id", "c4"), ("claims", "subject_id", "c5"), ("entities", "evidence_id", "e4"), ("ir_source_revisions", "repository_id", "g2")]
    report = {(r.ref_field, r.period): r.orphans for r in orphan_report(t).collect()}
    assert report["subject_id", "2025-01"] == 3


def test_orphans_of_empty_tables(spark):
    assert cases(orphans(tables(spark))) == []
    assert cases(orphans(tables(spark, claims=[("c", "x", None, T0)]))) == [("claims", "subject_id", "c")]


def test_orphans_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("hot").alias("subject_id"), F.lit(T0).cast("timestamp_ntz").alias("ingested_at"))
    t = {"claims": rows, "entities": spark.createDataFrame([("hot", T0, None)], "entity_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")}
    refs, to = (Reference("claims", "claim_id", "subject_id", "ingested_at", "entities"),), (Target("entities", "entity_id", "ingested_at", "deleted_at"),)
    assert orphans(t, refs, to, heavy_from=100).count() == 0


MAN = "snapshot_no int, repo_id string, path string, sha256 string, delivered_at timestamp_ntz, chunk int, pair int, v string, digest int"
DEL = "repo_id string, snapshot_no int"


def changes(spark, rows, deliveries, **kw):
    m = spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], MAN)
    return sorted((r.repo_id, r.snapshot_no, r.kind, r.path, r.old_path) for r in snapshot_changes(m, spark.createDataFrame(deliveries, DEL), **kw).collect())


def plain_changes(rows, deliveries):
    """The same by plain dictionaries."""
    snap = {}
    for n, repo, path, sha, t in sorted(rows, key=lambda r: (r[4], r[3])):
        snap.setdefault((repo, n), {})[path] = sha
    out = []
    for repo in {d[0] for d in deliveries}:
        ns = sorted(n for r, n in deliveries if r == repo)
        for a, b in zip(ns, ns[1:]):
            old, new = snap.get((repo, a), {}), snap.get((repo, b), {})
            added = {p for p in new if p not in old}
            by = {}
            for p in added:
                by.setdefault(new[p], []).append(p)
            used = set()
            for p in old:
                if p not in new:
                    to = by.get(old[p], [])
                    if len(to) == 1:
                        used.add(to[0])
                        out.append((repo, b, "renamed", to[0], p))
                    else:
                        out.append((repo, b, "removed", p, ""))
                elif old[p] != new[p]:
                    out.append((repo, b, "modified", p, ""))
            out += [(repo, b, "added", p, "") for p in added - used]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_changes_against_dictionaries(spark, chunk):
    rng = random.Random(chunk)
    rows, deliveries = [], []
    for repo in ("a", "b"):
        files = {f"d{rng.randrange(4)}/f{k}": f"{rng.randrange(30):02x}" for k in range(60)}
        for n in (1, 2, 4):
            for p in rng.sample(sorted(files), 8):
                sha = files.pop(p)
                if rng.random() < 0.5:
                    files["moved/" + p] = sha
            for p in rng.sample(sorted(files), 6):
                files[p] = f"{rng.randrange(30):02x}"
            files[f"new{n}"] = "zz"
            deliveries.append((repo, n))
            rows += [(n, repo, p, s, T0 + timedelta(days=n)) for p, s in files.items()]
            rows.append((n, repo, f"new{n}", "yy", T0 + timedelta(days=n, hours=1)))
    rows.append((3, "a", "not/delivered", "aa", T0))
    assert changes(spark, rows, deliveries, chunk_keys=chunk) == plain_changes(rows, deliveries)


def test_changes_with_untidy_rows(spark):
    rows = [
        (1, "r", "./a\\b//c", "SHA256:AB", T0), (2, "r", "a/b/c", "ab", T0), (1, "r", "x", None, T0), (2, "r", "y", None, T0), (1, "r", None, "aa", T0), (None, "r", "p", "aa", T0), (1, None, "p", "aa", T0), (1, "r", "gone", "cd", T0), (2, "r", "Gone", "cd", T0),
    ]
    assert changes(spark, rows, [("r", 1), ("r", 2), ("r", 2)]) == [("r", 2, "added", "y", ""), ("r", 2, "removed", "x", ""), ("r", 2, "renamed", "Gone", "gone")]


def test_changes_of_empty_snapshots(spark):
    rows = [(1, "r", "a", "1", T0), (3, "r", "b", "2", T0)]
    assert changes(spark, rows, [("r", 1), ("r", 2), ("r", 3)]) == [("r", 2, "removed", "a", ""), ("r", 3, "added", "b", "")]
    assert changes(spark, [(1, "r", "a", "1", T0)], [("r", 1)]) == []
    m = spark.createDataFrame([], MAN)
    assert snapshot_changes(m, spark.createDataFrame([], DEL)).count() == 0
