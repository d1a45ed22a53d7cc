"""What changed between consecutive full snapshots.

Rows are sorted by (repository, path) across all snapshots with one range shuffle, so every snapshot of a key lies in one
partition. There the sorted keys are cut into content-defined chunks (a key starts a chunk if its hash says so), each
delivery's chunk is digested, and chunks whose digest equals that of the delivery before are discarded unread. Only rows of
unmatched chunks are shuffled again and joined to tell added, modified, removed and renamed paths.

Defined results: a row without path, repository or snapshot number is dropped; null hashes are equal to each other only and
never found as renames; of several rows of one path in a snapshot the one delivered last holds (the greater hash at equal
times, rows without time first); snapshots not in the deliveries are ignored; a delivered snapshot without rows is empty, so
all paths before it are removed; empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A key starts a chunk if the low bits of its hash are zero: chunks hold 64 keys on average.
CHUNK_KEYS = 64


def clean_path(c: Column) -> Column:
    """Forward slashes only, one at a time, and no leading './'."""
    return F.regexp_replace(F.regexp_replace(c, r"[\\/]+", "/"), r"^(\./)+", "")


def clean_hash(c: Column) -> Column:
    """Hex digits in lower case without the name of an algorithm."""
    return F.lower(F.regexp_replace(F.trim(c), r"^[A-Za-z0-9_-]+[:=]", ""))


def delivery_pairs(deliveries: DataFrame) -> DataFrame:
    """(repo_id, snapshot_no, before, after): each delivery with its neighbours; a delivery told twice is one."""
    d = deliveries.select("repo_id", "snapshot_no").where("repo_id is not null and snapshot_no is not null").distinct()
    w = Window.partitionBy("repo_id").orderBy("snapshot_no")
    return d.select("repo_id", "snapshot_no", F.lag("snapshot_no").over(w).alias("before"), F.lead("snapshot_no").over(w).alias("after"))


def _unmatched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of chunks that differ between a delivery and the one before. Rows come sorted by repository and path; a chunk that
    a batch leaves open is carried over to the next."""
    rest: pd.DataFrame | None = None

    def sides(f: pd.DataFrame, chunk: np.ndarray) -> pd.DataFrame:
        parts = []
        for col, sign in (("before", 1), ("after", -1)):
            has = f[col].notna().to_numpy()
            g = f.loc[has, ["repo_id", "path", "sha"]].copy()
            g["pair"] = (f["snapshot_no"] if sign > 0 else f["after"])[has].astype("int64").to_numpy()
            g["is_new"] = sign > 0
            g["chunk"] = chunk[has]
            h = f.loc[has, "digest"].to_numpy(dtype=np.int64)
            g["h"] = h if sign > 0 else -h  # two's complement: equal chunks sum to zero
            parts.append(g)
        g = pd.concat(parts, ignore_index=True)
        differs = g.groupby(["chunk", "pair"], sort=False)["h"].transform("sum").to_numpy() != 0
        return g.loc[differs, ["repo_id", "pair", "path", "sha", "is_new"]]

    for f in frames:
        if rest is not None:
            f = pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        new_repo = (f["repo_id"] != f["repo_id"].shift()).to_numpy()
        new_key = new_repo | (f["path"] != f["path"].shift()).to_numpy()
        start = new_repo | (new_key & f["cuts"].to_numpy(dtype=bool))
        chunk = np.cumsum(start)
        last = int(np.flatnonzero(start)[-1])
        rest = f.iloc[last:]
        if last:
            yield sides(f.iloc[:last], chunk[:last])
    if rest is not None:
        yield sides(rest, np.zeros(len(rest), dtype=np.int64))


def snapshot_rows(manifests: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per repository, snapshot and path, range partitioned by repository and path: every version of a path is in one place."""
    rows = manifests.select(
        "repo_id", "snapshot_no", clean_path(F.col("path")).alias("path"), F.struct(F.col("delivered_at").alias("t"), clean_hash(F.col("sha256")).alias("sha")).alias("v")
    ).where("repo_id is not null and snapshot_no is not null and path is not null")
    rows = rows.repartitionByRange("repo_id", "path")
    # range partitions by (repo_id, path) already cluster this aggregation: no second shuffle
    rows = rows.groupBy("repo_id", "path", "snapshot_no").agg(F.max("v").alias("v")).select("repo_id", "path", "snapshot_no", F.col("v.sha").alias("sha"))
    return rows.join(pairs, ["repo_id", "snapshot_no"])


def changed_rows(manifests: DataFrame, deliveries: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """(repo_id, pair, path, sha, is_new): the rows of unmatched chunks on either side of each delivery."""
    rows = snapshot_rows(manifests, delivery_pairs(deliveries))
    rows = rows.select(
        "repo_id", "path", "sha", "snapshot_no", "before", "after",
        (F.pmod(F.xxhash64("path"), F.lit(chunk_keys)) == 0).alias("cuts"), F.xxhash64("path", F.coalesce("sha", F.lit("-"))).alias("digest"),
    ).sortWithinPartitions("repo_id", "path")
    return rows.mapInPandas(_unmatched, "repo_id string, pair int, path string, sha string, is_new boolean")


def snapshot_changes(manifests: DataFrame, deliveries: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """(repo_id, snapshot_no, kind, path, old_path, sha256): the changes of each delivery against the repository's delivery before."""
    some = F.lit(1)
    versions = changed_rows(manifests, deliveries, chunk_keys).groupBy("repo_id", "pair", "path").agg(
        F.max(F.when(F.col("is_new"), F.struct(some.alias("x"), F.col("sha").alias("sha")))).alias("n"),
        F.max(F.when(~F.col("is_new"), F.struct(some.alias("x"), F.col("sha").alias("sha")))).alias("o"),
    )
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("n.sha").eqNullSafe(F.col("o.sha")), "modified")
    rows = versions.select("repo_id", F.col("pair").alias("snapshot_no"), kind.alias("kind"), "path", F.coalesce("n.sha", "o.sha").alias("sha")).where("kind is not null")
    rows = cut(rows)  # only what changed; three branches read it, and chunks are compared once
    moved = rows.where("kind <> 'modified'")
    # one row per hash: how many paths it was added under, and how often it was removed
    by_hash = moved.where("sha is not null").groupBy("repo_id", "snapshot_no", "sha").agg(
        F.count(F.when(F.col("kind") == "added", 1)).alias("adds"), F.max(F.when(F.col("kind") == "removed", True)).alias("gone"), F.max(F.when(F.col("kind") == "added", F.col("path"))).alias("to")
    ).where("adds = 1 and gone").select("repo_id", "snapshot_no", "sha", "to")
    told = moved.join(by_hash, ["repo_id", "snapshot_no", "sha"], "left").where(~((F.col("kind") == "added") & F.col("to").isNotNull()))
    renamed = F.col("to").isNotNull()
    told = told.select(
        "repo_id", "snapshot_no", F.when(renamed, "renamed").otherwise(F.col("kind")).alias("kind"), F.coalesce("to", "path").alias("path"),
        F.when(renamed, F.col("path")).otherwise("").alias("old_path"), "sha",
    )
    same = rows.where("kind = 'modified'").select("repo_id", "snapshot_no", "kind", "path", F.lit("").alias("old_path"), "sha")
    return told.unionByName(same).withColumnRenamed("sha", "sha256")
