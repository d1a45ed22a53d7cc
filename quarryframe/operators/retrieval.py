"""Retrievers over entities, evidence and texts: exact, literal, full text with BM25, structural, vector; ranking, fusion and pages.

Every order is total, so two runs give the same rows. Nulls never match a query; an empty query matches nothing; ties are broken
by ids; empty tables give no rows; columns not named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .current import entity_confidence

MATCH_CLASS = {"exact_symbol": 0, "exact_identifier": 1, "exact_path": 2, "exact_protocol_config": 3, "literal": 4, "lexical": 5}
TIERS = {"exact": 0, "structural": 1, "landmark": 2}


def with_confidence(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities with the greatest confidence of their claims, 1 if they have none."""
    c = entity_confidence(claims).withColumnRenamed("entity_id", "_e").withColumnRenamed("confidence", "_c")
    return entities.join(c, F.lower("entity_id") == F.col("_e"), "left").withColumn("confidence", F.coalesce("_c", F.lit(1.0))).drop("_e", "_c")


def named(query: str) -> Column:
    """Whether label or path equals the query, without regard to case."""
    return (F.lower("label") == query.lower()) | (F.lower("path") == query.lower())


def holds(query: str) -> Column:
    """Whether a file's content contains the query, without regard to case."""
    return F.contains(F.lower("content"), F.lit(query.lower()))


def exact(entities: DataFrame, claims: DataFrame, query: str) -> DataFrame:
    """Entities whose label or path equals the query, without regard to case; the filter runs before any join."""
    q = query.lower()
    hit = entities.where(named(q)) if q else entities.limit(0)
    hit = hit.withColumn("match_type", F.when(F.lower("label") == q, "exact_identifier").otherwise("exact_path"))
    return with_confidence(hit, claims).select("entity_id", "repo_id", "kind", "label", "path", "evidence_id", "match_type", "confidence")


def literal(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities of the given files (those that hold the query)."""
    hit = hits.select("generation_id", "path").distinct()
    kind = F.when(F.col("kind").startswith("configuration"), "exact_protocol_config").otherwise("literal")
    return entities.join(hit, ["generation_id", "path"], "left_semi").select("entity_id", "repo_id", "kind", "label", "path", kind.alias("match_type"))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bm25(rows: DataFrame, key: str, text: str, phrase: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, hits, score) of rows that hold the phrase; the score is negative, less is better. Corpus figures are one row."""
    words = [w for w in phrase.lower().split() if w]
    t = rows.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    # separators are doubled so that neighbouring hits don't share one
    joined = F.concat(F.lit(" "), F.array_join("t", "  "), F.lit(" "))
    needle = " " + "  ".join(words) + " "
    hits = ((F.length(joined) - F.length(F.replace(joined, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
    scored = t.select(key, F.size("t").cast("double").alias("len"), hits.alias("hits"))
    corpus = scored.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), F.count(F.when(F.col("hits") > 0, 1)).cast("double").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    f = F.col("hits").cast("double")
    score = -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return scored.where("hits > 0").join(F.broadcast(corpus)).select(key, "hits", F.round(score, 6).alias("score"))


def structural(entities: DataFrame, claims: DataFrame, query: str) -> DataFrame:
    """Entities with a claim whose other end is labelled as the query: claims as undirected edges, then two equal joins."""
    named = entities.where(F.lower("label") == query.lower()).select(F.col("entity_id").alias("dst"))
    near = undirected(claims).join(named, "dst", "left_semi").select(F.col("src").alias("entity_id")).distinct()
    return entities.join(near, "entity_id", "left_semi").select("entity_id", "repo_id", "kind", "label", "path")


def undirected(claims: DataFrame) -> DataFrame:
    """(src, dst, predicate, claim_id) for both directions of every claim."""
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("subject_id", "object_id"), ("object_id", "subject_id"))]
    return claims.where("subject_id is not null and object_id is not null").select("claim_id", "predicate", F.explode(F.array(*ends)).alias("x")).select("x.src", "x.dst", "predicate", "claim_id")


def search(entities: DataFrame, hits: DataFrame, claims: DataFrame, query: str) -> DataFrame:
    """Exact, literal and full-text matches of entities, one row per (entity, match) with its least score; hits are the files that hold the query."""
    e = exact(entities, claims, query).select("entity_id", "match_type").withColumn("score", F.lit(0.0))
    lit_ = literal(entities, hits).select("entity_id", "match_type").withColumn("score", F.lit(0.0))
    text = F.concat_ws(" ", "label", "kind", "path")
    lex = bm25(entities.select("entity_id", text.alias("text")), "entity_id", "text", " ".join(query.lower().split())).select("entity_id", F.lit("lexical").alias("match_type"), "score")
    best = e.unionByName(lit_).unionByName(lex).groupBy("entity_id", "match_type").agg(F.min("score").alias("score"))
    rows = with_confidence(entities, claims).select("entity_id", "repo_id", "label", "path", "confidence").join(best, "entity_id")
    cls = F.create_map(*[F.lit(x) for kv in MATCH_CLASS.items() for x in kv])[F.col("match_type")]
    rows = rows.withColumn("class", F.coalesce(cls, F.lit(6)))
    return rows


def search_order() -> list[Column]:
    return [F.col("class"), F.when(F.col("match_type") == "lexical", F.col("score")).asc_nulls_first(), F.col("confidence").desc(), F.col("repo_id"), F.col("path"), F.col("entity_id")]


def evidence_tier(sources: Column) -> Column:
    """0 exact, 1 structural, 2 landmark, 3 anything else."""
    t = F.lit(3)
    for name in ("landmark", "structural", "exact"):
        t = F.when(F.array_contains(sources, name), TIERS[name]).otherwise(t)
    return t


def fuse(candidates: DataFrame) -> DataFrame:
    """(entity_id, evidence_id, sources, tier, confidence, best_rank): one row per key of rows (entity_id, evidence_id, source, rank, confidence)."""
    g = candidates.groupBy("entity_id", "evidence_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"), F.min("rank").alias("best_rank"))
    return g.select("entity_id", "evidence_id", F.array_join("sources", ",").alias("sources"), evidence_tier(F.col("sources")).alias("tier"), "confidence", "best_rank")


def budgeted(candidates: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first `budget` candidates in retriever order, and whether the budget stopped the rest."""
    w = Window.orderBy(*order)
    first = candidates.orderBy(*order).limit(budget + 1)  # bounded before the window gathers it
    return first.withColumn("n", F.row_number().over(w)).withColumn("truncated", F.max("n").over(Window.partitionBy(F.lit(1))) > budget).where(F.col("n") <= budget)


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


#: Vectors in a block; blocks of queries meet blocks of vectors, and each meeting is one matrix product.
BLOCK = 1024


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, keys, dims, data): vectors as blocks of rows of one matrix of doubles, padded with zeros to the longest."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), BLOCK):
                part = f.iloc[i : i + BLOCK]
                dims = np.array([len(v) for v in part["v"]], dtype=np.int32)
                data = np.zeros((len(part), int(dims.max())), dtype=np.float64)
                for r, v in enumerate(part["v"]):
                    data[r, : len(v)] = v
                yield pd.DataFrame({"keys": [part["k"].to_numpy(np.int64).tobytes()], "dims": [dims.tobytes()], "data": [data.tobytes()]})

    v = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    return v.mapInPandas(pack, "keys binary, dims binary, data binary")


def _nearest(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}

        def matrix(f, i, p):
            keys, dims = np.frombuffer(f[p + "keys"].iloc[i], np.int64), np.frombuffer(f[p + "dims"].iloc[i], np.int32)
            data = np.frombuffer(f[p + "data"].iloc[i], np.float64).reshape(len(keys), -1)
            norm = np.sqrt((data * data).sum(1))
            return keys, dims, np.divide(data, norm[:, None], out=np.zeros_like(data), where=norm[:, None] > 0)

        for f in frames:
            for i in range(len(f)):
                qk, qd, q = matrix(f, i, "q_")
                vk, vd, v = matrix(f, i, "")
                w = min(q.shape[1], v.shape[1])
                cos = np.where(qd[:, None] == vd[None, :], q[:, :w] @ v[:, :w].T, 0.0).round(6) + 0.0
                for r, key in enumerate(qk.tolist()):
                    row = cos[r]
                    own = vk != key
                    if own.sum() > k:
                        least = np.partition(row[own], -k)[-k]  # ties at the bound are all kept until they are ordered by key
                        own &= row >= least
                    got = best.setdefault(key, [])
                    got.extend(zip((-row[own]).tolist(), vk[own].tolist(), strict=True))
                    if len(got) > 4 * k:
                        got.sort()
                        del got[k:]
        rows = [(q, v, -c) for q, got in best.items() for c, v in sorted(got)[:k]]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "cosine"])

    return run


def top_cosine(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, vec_id, cosine, position): the k vectors nearest to each query, itself left out; ties by key.

    Both sides are cut into blocks; a block of vectors is sent to every block of queries through a shuffle and multiplied there, each
    task keeps k rows for a query, and these meet in a window. Nothing is broadcast. Null keys and null or empty vectors are left
    out; null components count as zero; vectors of another length, and those of length zero, have the cosine zero.
    """
    q = _blocks(queries, key, vector).select(*[F.col(c).alias(f"q_{c}") for c in ("keys", "dims", "data")])
    # the number of query blocks is known only at run time: every block of queries gets a number, vectors are copied to all of them
    q = q.withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("q_keys"), "q_keys")))
    many = q.agg(F.coalesce(F.max("n"), F.lit(0)).alias("many"))
    v = _blocks(vectors, key, vector).join(F.broadcast(many)).where("many > 0").select("keys", "dims", "data", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("n"))
    schema = "query_id long, vec_id long, cosine double"
    part = v.join(q, "n").mapInPandas(_nearest(k), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return part.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def hash_embedding(rows: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, dim, value): feature hashing of words, signed and normalised; a text without words has no rows. Partial sums before the shuffle."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z0-9_./:\-]+)"), 1)
    h = rows.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n")).withColumn("h", F.sha2("w", 256))
    dim = F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % dims
    sign = F.when(F.conv(F.substring("h", 5, 2), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)
    sums = h.groupBy(key, dim.alias("dim")).agg(F.sum(F.col("n") * sign).cast("double").alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(key)))
    return sums.select(key, "dim", F.round(F.col("s") / norm, 6).alias("value"))


def ambiguous(entities: DataFrame) -> DataFrame:
    """(label, places, state): how many repositories, paths and identities share a label; more than one is ambiguous."""
    g = entities.groupBy(F.lower("label").alias("label")).agg(F.countDistinct("repo_id", "path", "identity").alias("places"))
    return g.select("label", "places", F.when(F.col("places") > 1, "unknown").otherwise("found").alias("state"))
