"""References to records that do not exist.

A reference is an orphan if, at the referring record's earliest time, its target was unknown: no such id, or its earliest
time is later, or it had been deleted by then. Ids are compared without surrounding white space and without regard to case.

Plan: references are counted per key with map-side combine; keys with very many references (at most ``MAX_HEAVY``, a fixed
bound) are looked up by broadcasting their few targets, all other references meet their targets in a shuffle join, and both
halves are united. No key is ever gathered into one task.

Defined results: null and blank references are no cases; a record delivered several times is judged at its earliest time (a
row without a time counts as earliest only if no row of the record has one, and such a record has no case); rows without a
record id are dropped, since they name no record; empty tables give no rows (an empty target table makes every reference an
orphan); columns other than those named are never read, so extra or clashing columns have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import id_key

#: At most so many keys are treated as heavy; their targets are what is broadcast (one row each).
MAX_HEAVY = 64
#: References to one key from which it is heavy.
HEAVY_FROM = 20_000


@dataclass(frozen=True)
class Reference:
    table: str
    record: str
    field: str
    time: str
    target: str


@dataclass(frozen=True)
class Target:
    table: str
    key: str
    time: str
    deleted: str


REFERENCES = (
    Reference("claims", "claim_id", "subject_id", "ingested_at", "entities"),
    Reference("claims", "claim_id", "object_id", "ingested_at", "entities"),
    Reference("entities", "entity_id", "evidence_id", "ingested_at", "evidence"),
    Reference("ir_source_revisions", "revision_id", "repository_id", "indexed_at", "ir_repositories"),
)
TARGETS = (
    Target("entities", "entity_id", "ingested_at", "deleted_at"),
    Target("evidence", "evidence_id", "ingested_at", "deleted_at"),
    Target("ir_repositories", "repository_id", "created_at", "deleted_at"),
)


def references(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(target, key, ref_table, ref_field, record_id, at): one row per record and distinct key that it refers to."""
    by_record: dict[tuple[str, str, str], list[Reference]] = {}
    for r in refs:
        by_record.setdefault((r.table, r.record, r.time), []).append(r)
    parts = []
    for (t, record, time), fields in by_record.items():
        rows = tables[t].select(
            F.col(record).alias("record_id"), F.col(time).alias("at"), *[id_key(f.field).alias(f"k{i}") for i, f in enumerate(fields)]
        ).where("record_id is not null")
        # collect_set is bounded by the deliveries of one record
        rows = rows.groupBy("record_id").agg(F.min("at").alias("at"), *[F.collect_set(f"k{i}").alias(f"k{i}") for i in range(len(fields))])
        one = F.array(*[F.struct(F.lit(f.target).alias("target"), F.lit(f.field).alias("ref_field"), F.col(f"k{i}").alias("ks")) for i, f in enumerate(fields)])
        rows = rows.select("record_id", "at", F.explode(one).alias("x")).select("record_id", "at", "x.target", "x.ref_field", F.explode("x.ks").alias("key"))
        parts.append(rows.select("target", "key", F.lit(t).alias("ref_table"), "ref_field", "record_id", "at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def targets(tables: dict[str, DataFrame], of: tuple[Target, ...] = TARGETS) -> DataFrame:
    """(target, key, since, until): one row per target id, from its earliest time to its deletion as told by any row."""
    out = None
    for t in of:
        rows = tables[t.table].select(F.lit(t.table).alias("target"), id_key(t.key).alias("key"), F.col(t.time).alias("since"), F.col(t.deleted).alias("until"))
        rows = rows.where("key is not null").groupBy("target", "key").agg(F.min("since").alias("since"), F.min("until").alias("until"))
        out = rows if out is None else out.unionByName(rows)
    return out


def heavy_keys(tables: dict[str, DataFrame], refs: tuple[Reference, ...], at_least: int, at_most: int) -> DataFrame:
    """The keys with the most references, counted over the rows as delivered: at most `at_most` rows."""
    out = None
    for r in refs:
        rows = tables[r.table].select(F.lit(r.target).alias("target"), id_key(r.field).alias("key"), F.month(r.time).alias("period"))
        # per key and period first, so that a heavy key's months are combined before they meet
        rows = rows.where("key is not null").groupBy("target", "key", "period").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("target", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least).orderBy(F.desc("n"), "target", "key").limit(at_most)


def orphans(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES, of: tuple[Target, ...] = TARGETS, heavy_from: int = HEAVY_FROM, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """(ref_table, ref_field, record_id, key, at) of each orphan reference."""
    rows, to = references(tables, refs), targets(tables, of)
    heavy = F.broadcast(heavy_keys(tables, refs, heavy_from, max_heavy).select("target", "key", F.lit(True).alias("heavy")))
    flagged = rows.join(heavy, ["target", "key"], "left")
    few = F.broadcast(to.join(heavy, ["target", "key"], "left_semi"))
    many = flagged.where("heavy is null").join(to, ["target", "key"], "left")
    both = flagged.where("heavy").join(few, ["target", "key"], "left").unionByName(many)
    absent = F.col("since").isNull() | (F.col("since") > F.col("at")) | F.coalesce(F.col("until") <= F.col("at"), F.lit(False))
    return both.where(F.col("at").isNotNull() & absent).select("ref_table", "ref_field", "record_id", "key", "at").distinct()


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_field, period, orphans, keys): counts per table, field and month of the records' earliest times."""
    rows = orphans(tables).withColumn("period", F.date_format("at", "yyyy-MM"))
    per_key = rows.groupBy("ref_table", "ref_field", "period", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("ref_table", "ref_field", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("keys"))
