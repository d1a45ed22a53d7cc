"""Coverage and three-valued results: an absence is told only where everything was looked at.

found if there are rows; not_found if there are none and coverage is complete; unknown otherwise. Repositories without any
file are incomplete; nulls in classification or language count as unsupported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def told() -> dict[str, Column]:
    """What a row tells about its text: to be made before rows are reduced, so that texts aren't shuffled."""
    return {"outcome": F.when(F.col("content").isNull(), "unreadable").when(F.contains("content", F.lit("\x00")), "unsupported").otherwise("included")}


def entries(files: DataFrame) -> DataFrame:
    """(repo_id, path, outcome, capability): what became of each file (with the columns of ``told``)."""
    lang = labels.language_of(F.col("path"))
    return files.select("repo_id", "generation_id", "path", lang.alias("language"), "outcome", F.when(lang.isin(*labels.STRUCTURAL), "lexical,structural").otherwise("lexical").alias("capability"))


def basis(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(repo_id, files, not_included, without_structure, diagnostics, complete) per repository."""
    e = entries(files)
    lacking = (F.col("outcome") == "included") & ~F.col("language").isin("configuration", "documentation") & ((F.col("language") != "text") | F.contains("path", F.lit("."))) & ~F.array_contains(F.split("capability", ","), "structural")
    per = e.groupBy("repo_id").agg(F.count("*").alias("files"), F.count(F.when(F.col("outcome") != "included", 1)).alias("not_included"), F.count(F.when(lacking, 1)).alias("without_structure"))
    owner = files.select("generation_id", "repo_id").distinct()
    told = diagnostics.join(owner, "generation_id").groupBy("repo_id").agg(F.count("*").alias("diagnostics"))
    out = per.join(told, "repo_id", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.lit(0)))
    return out.withColumn("complete", (F.col("not_included") == 0) & (F.col("without_structure") == 0) & (F.col("diagnostics") == 0))


def state(rows: Column, complete: Column, truncated: Column | None = None) -> Column:
    cut = F.lit(False) if truncated is None else truncated
    return F.when(rows > 0, F.when(cut, "unknown").otherwise("found")).when(complete & ~cut, "not_found").otherwise("unknown")


def stale_negatives(negatives: DataFrame, active: DataFrame) -> DataFrame:
    """Recorded absences that depend on a generation which is no longer active (columns negative_id, generation_id)."""
    return negatives.join(active.select("generation_id").distinct(), "generation_id", "left_anti").select("negative_id").distinct()


def dangling(claims: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(reference, dangling): how many references of claims lead nowhere, by anti-joins; null references count too."""
    e, v = entities.select("entity_id"), evidence.select("evidence_id")
    parts = [claims.select(F.lit(c).alias("reference"), F.col(c).alias(k)).join(t.distinct(), k, "left_anti").groupBy("reference").agg(F.count("*").alias("dangling")) for c, k, t in (("subject_id", "entity_id", e), ("object_id", "entity_id", e), ("evidence_id", "evidence_id", v))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
