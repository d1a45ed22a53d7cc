"""Retrieval quality and context budgets: reciprocal rank, precision, recall, gain, nearest-rank percentiles, packed contexts.

A case without a relevant result scores zero; null ranks count as not found; no cases give one row of nulls and zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(results: DataFrame) -> DataFrame:
    """(cases, mrr, precision_at_1, recall_at_5, ndcg) of rows (case, rank, relevant)."""
    hit = F.col("relevant") & F.col("rank").isNotNull()
    per = results.groupBy("case").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.count(F.when(F.col("relevant"), 1)).alias("all"), F.count(F.when(hit & (F.col("rank") <= 5), 1)).alias("top"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("all").cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + 1 / F.log2(k + 1.0))
    z = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return per.agg(F.count("*").alias("cases"), z(1.0 / F.col("first")).alias("mrr"), z((F.col("first") == 1).cast("double")).alias("precision_at_1"), z(F.col("top") / F.when(F.col("all") > 0, F.col("all"))).alias("recall_at_5"), z(F.when(F.col("all") > 0, F.col("dcg") / ideal)).alias("ndcg"))


def nearest_rank(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """(by, n, percentile): the value at rank ceil(q n), from counts per distinct value so that a group is never gathered."""
    per = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    per = per.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return per.where(F.col("upto") >= F.ceil(F.col("n") * q)).groupBy(by, "n").agg(F.min(value).alias("percentile")).select(by, "n", "percentile")


def packed(candidates: DataFrame, by: str, order: list, text: str, most_rows: int = 8, most_tokens: int = 1490) -> DataFrame:
    """The candidates of each package that fit its limits: at most `most_rows`, and `most_tokens` estimated as a quarter of the bytes."""
    w = Window.partitionBy(by).orderBy(*order)
    first = candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_rows)
    tokens = F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)
    return first.withColumn("tokens", tokens.cast("long")).withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= most_tokens)


def line_baseline(files: DataFrame, needle: str) -> DataFrame:
    """(repo_id, path, line, text): lines that hold the needle as it is written."""
    rows = files.where(F.contains("content", F.lit(needle))).select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return rows.where(F.contains("text", F.lit(needle))).select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")
