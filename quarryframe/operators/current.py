"""The state of redelivered tables: the last row of each record, deletions as told by any of its rows, and active generations.

Each column is reduced on its own, to its value in the row with the latest time, so that Catalyst drops the columns that a query
doesn't use from the shuffle and from the scan. Texts should be turned into what is asked of them before the reduction.
Nulls: rows whose key is null are dropped; a row without a time comes before rows with one. Ties: of rows with the same latest
time each column has its greatest value (repeated rows are one). Empty tables give none; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import id_key


def _latest(c: str, time: str) -> Column:
    return F.max(F.struct(F.col(time).alias("t"), F.col(c).alias("v"))).getField("v").alias(c)


def last_rows(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row a key: the one with the latest time. Combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, time)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(time).alias(time), *[_latest(c, time) for c in others])


def present(rows: DataFrame, key: str, time: str = "ingested_at", deleted: str = "deleted_at") -> DataFrame:
    """The last row of each record that none of its rows tells deleted."""
    others = [c for c in rows.columns if c not in (key, time, deleted)]
    got = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(deleted).alias("_d"), F.max(time).alias(time), *[_latest(c, time) for c in others])
    return got.where("_d is null").drop("_d")


def only(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """The rows of the records of which any row meets the condition: what a search has to reduce. The condition reaches the scan;
    it must be asked again of the last rows."""
    return rows.join(rows.where(condition).select(key).distinct(), key, "left_semi")


def active_generations(revisions: DataFrame) -> DataFrame:
    """(repo, generation_id, git_commit, indexed_at): the newest revision of each repository; blank repositories have none."""
    r = revisions.select(id_key("repository_id").alias("repo"), F.struct("indexed_at", F.col("revision_id").alias("generation_id"), "git_commit").alias("v")).where("repo is not null")
    return r.groupBy("repo").agg(F.max("v").alias("v")).select("repo", "v.generation_id", "v.git_commit", "v.indexed_at")


def entity_confidence(claims: DataFrame) -> DataFrame:
    """(entity_id, confidence): the greatest confidence of the claims at either end; both ends are combined before the shuffle."""
    ends = claims.select(F.explode(F.array(id_key("subject_id"), id_key("object_id"))).alias("entity_id"), "confidence").where("entity_id is not null")
    return ends.groupBy("entity_id").agg(F.max("confidence").alias("confidence"))
