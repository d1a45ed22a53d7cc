"""Cross-repository links: claims' objects normalised to identities, providers joined to consumers of other repositories.

Labels that name no identity are left out; an identity is told once per repository, entity and role (its surest claim). Every provider
of an identity is linked to every consumer in another repository, since those links are the result; nulls never link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.ids import prefixed


def memberships(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(identity_kind, normalized, role, repo_id, entity_id, predicate, confidence): what each repository says about an identity."""
    e = entities.select(F.col("entity_id").alias("object_id"), "repo_id", "label")
    rows = claims.join(e, "object_id").select(labels.identity_kind(F.col("predicate")).alias("identity_kind"), labels.normalized_identity(F.col("predicate"), F.col("label")).alias("normalized"), labels.role(F.col("predicate")).alias("role"), "repo_id", F.col("object_id").alias("entity_id"), "predicate", "confidence")
    return rows.where("normalized is not null").groupBy("identity_kind", "normalized", "role", "repo_id", "entity_id", "predicate").agg(F.max("confidence").alias("confidence"))


def links(members: DataFrame) -> DataFrame:
    """(link_id, predicate, subject_id, object_id, subject_repo, object_repo, confidence) of providers and consumers in different repositories."""
    side = lambda r, p: members.where(F.col("role") == r).groupBy("identity_kind", "normalized", "repo_id", "entity_id").agg(F.max("confidence").alias("confidence")).select("identity_kind", "normalized", *[F.col(c).alias(f"{p}_{c}") for c in ("repo_id", "entity_id", "confidence")])
    both = side("provider", "s").join(side("consumer", "o"), ["identity_kind", "normalized"]).where("s_repo_id <> o_repo_id")
    predicate = labels.link_predicate(F.col("identity_kind"))
    return both.select(prefixed("x-", predicate, "s_entity_id", "o_entity_id").alias("link_id"), predicate.alias("predicate"), F.col("s_entity_id").alias("subject_id"), F.col("o_entity_id").alias("object_id"), F.col("s_repo_id").alias("subject_repo"), F.col("o_repo_id").alias("object_repo"), F.least("s_confidence", "o_confidence").alias("confidence")).distinct()
