"""Sources and sinks: files as a table, adapters, generations written beside each other and activated by one pointer.

A file that isn't UTF-8 or holds NUL characters has null content; an empty folder is an empty table.
"""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels


def read_tree(spark: SparkSession, root: str, repo_id: str, pattern: str = "*") -> DataFrame:
    """(repo_id, path, sha256, size, language, classification, content): the files below a folder of any file system Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in ("/" + base.lstrip("/"))) + "/+", "")
    text = F.when(F.is_valid_utf8("content") & (F.instr(F.decode("content", "UTF-8"), "\x00") == 0), F.decode("content", "UTF-8"))
    rows = raw.select(F.lit(repo_id).alias("repo_id"), path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), text.alias("content"))
    return rows.select("repo_id", "path", "sha256", "size", labels.language_of(F.col("path")).alias("language"), labels.classification_of(F.col("path")).alias("classification"), "content")


class SourceAdapter(ABC):
    """Something that tells a repository's revision, files and changes."""

    @abstractmethod
    def revision(self, repo_id: str) -> str: ...

    @abstractmethod
    def files(self, spark: SparkSession, repo_id: str) -> DataFrame: ...

    def changes(self, spark: SparkSession, repo_id: str, before: DataFrame) -> DataFrame:
        from ..operators.snapshots import snapshot_changes

        now = self.files(spark, repo_id).select(F.lit(2).alias("snapshot_no"), "repo_id", "path", "sha256", F.current_timestamp().cast("timestamp_ntz").alias("delivered_at"))
        old = before.select(F.lit(1).alias("snapshot_no"), "repo_id", "path", "sha256", F.current_timestamp().cast("timestamp_ntz").alias("delivered_at"))
        both = spark.createDataFrame([(repo_id, 1), (repo_id, 2)], "repo_id string, snapshot_no int")
        return snapshot_changes(old.unionByName(now), both)


class FolderAdapter(SourceAdapter):
    def __init__(self, roots: dict[str, str]) -> None:
        self.roots = roots

    def revision(self, repo_id: str) -> str:
        return self.roots[repo_id]

    def files(self, spark: SparkSession, repo_id: str) -> DataFrame:
        return read_tree(spark, self.roots[repo_id], repo_id)


def stage(tables: dict[str, DataFrame], folder: str, revision: str, repo_id: str) -> None:
    """Writes all tables of a revision; rows of other repositories are refused before anything is written."""
    for name, df in tables.items():
        if "repo_id" in df.columns and df.where(F.col("repo_id") != repo_id).limit(1).count():
            raise ValueError(f"{name} holds rows of another repository")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/revision={revision}/{name}")


def activate(spark: SparkSession, folder: str, revision: str) -> None:
    """Makes a staged revision the one that is read: a new pointer row, whose time decides; readers see the old or the new one."""
    spark.createDataFrame([(revision, time.time_ns())], "revision string, at long").coalesce(1).write.mode("append").parquet(f"{folder}/active")


def active_revision(spark: SparkSession, folder: str) -> str:
    return spark.read.schema("revision string, at long").parquet(f"{folder}/active").agg(F.max_by("revision", "at")).first()[0]


def read_active(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/revision={active_revision(spark, folder)}/{name}")


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def catalog(text: str) -> dict:
    """A catalog of 1 to 100 sources; ValueError for unknown keys, several objects or more than 1 MiB."""
    if len(text.encode()) > 1 << 20:
        raise ValueError("catalog is too large")
    x = json.loads(text)
    known = {"version", "sources", "limits", "compiler_runtime", "retention_generations", "vector", "features"}
    if not isinstance(x, dict) or set(x) - known:
        raise ValueError("unknown catalog key")
    if not 1 <= len(x.get("sources", [])) <= 100:
        raise ValueError("a catalog has 1 to 100 sources")
    return x
