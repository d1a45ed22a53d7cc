"""Discovery: path policy, languages, limits, hashes and coverage outcomes of a file table, and affected paths of a change.

Null paths are dropped; null contents are unreadable; the first excluding rule gives the reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels

# Directories and words that keep a path out (fixed values).
BLOCKED_DIRS = (".git", ".gradle", "node_modules", "vendor", "build", "dist", "target", "dependency", "dependencies", "env")
BLOCKED_WORDS = ("secret", "credential", "keystore", "private-key", "private_key")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ** spans directories, * and ? stay within one."""
    out = []
    for part in glob.split("/"):
        if part == "**":
            out.append("(?:[^/]+/)*")
            continue
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
        out.append(body + "/")
    text = "".join(out)
    return "^" + (text[:-1] if text.endswith("/") else text + "[^/]+") + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def blocked(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), _bad)


def _bad(s: Column) -> Column:
    out = s.isin(*BLOCKED_DIRS) | (s == ".env") | s.startswith(".env.")
    for w in BLOCKED_WORDS:
        out = out | s.contains(w)
    return out


def reason(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Why a path is left out, '' if it isn't."""
    low = F.lower(path)
    built = F.when(F.exists(F.array(*[F.lit(f"{d}/") for d in ("build", "dist", "target")]), lambda d: low.contains(d)), "generated").when(low.contains("vendor/") | low.contains("node_modules/"), "vendor").otherwise("built_in_policy")
    out = F.when(blocked(path), built)
    for g in exclude:
        out = out.when(matches_glob(path, g), "catalog_pattern")
    if include:
        any_ = matches_glob(path, include[0])
        for g in include[1:]:
            any_ = any_ | matches_glob(path, g)
        out = out.when(~any_, "not_included")
    return out.otherwise("")


def told() -> dict[str, Column]:
    """What a row tells about its text: to be made before rows are reduced, so that texts aren't shuffled."""
    text = F.coalesce("content", F.lit(""))
    return {"bytes": F.octet_length(text).cast("long"), "digest": F.sha2(text, 256), "unreadable": F.col("content").isNull(), "binary": F.contains(text, F.lit("\x00"))}


def scan(files: DataFrame, max_bytes: int = 1 << 20, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, path, language, classification, size, sha256, outcome, reason): one outcome row per file (with the columns of ``told``)."""
    why = reason(F.col("path"), include, exclude)
    why = F.when(why != "", why).when(F.col("unreadable"), "unreadable").when(F.col("bytes") > max_bytes, "file_too_large").when(F.col("binary"), "binary").otherwise("")
    outcome = F.when(why == "", "included").when(why == "unreadable", "unreadable").when(why == "binary", "unsupported").otherwise("excluded")
    return files.where("path is not null").select("repo_id", "path", labels.language_of(F.col("path")).alias("language"), labels.classification_of(F.col("path")).alias("classification"), F.col("bytes").alias("size"), F.col("digest").alias("sha256"), outcome.alias("outcome"), why.alias("reason"))


def affected_paths(changes: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, path): changed paths, and the files of claims whose ends lie in them, one hop."""
    changed = changes.select("repo_id", "path").distinct()
    inside = entities.join(changed, ["repo_id", "path"], "left_semi").select("entity_id").distinct()
    ends = claims.select("subject_id", "object_id")
    other = ends.join(inside.withColumnRenamed("entity_id", "object_id"), "object_id", "left_semi").select(F.col("subject_id").alias("entity_id")).unionByName(ends.join(inside.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").select(F.col("object_id").alias("entity_id")))
    return changed.unionByName(entities.join(other.distinct(), "entity_id", "left_semi").select("repo_id", "path")).distinct()


def rebuild_scope(changes: DataFrame) -> DataFrame:
    """(repo_id, scope): full if a build description changed, else affected."""
    full = F.lower("path").rlike(r"(^|/)(tsconfig[^/]*\.json|package\.json|pom\.xml|[^/]+\.gradle(\.kts)?)$")
    return changes.groupBy("repo_id").agg(F.max(full).alias("f")).select("repo_id", F.when(F.col("f"), "full").otherwise("affected").alias("scope"))
