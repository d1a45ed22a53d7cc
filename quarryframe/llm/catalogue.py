"""Queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import credentials, docs, encode, mixing, origins, spans, subjects, syntax

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


# every run of 300 characters of the last texts: brute force over the whole table
_RUNS = """with f as (select source_id, content from (select source_id, content, row_number() over (partition by source_id order by ingested_at desc, content desc) n from source_files where length(content) >= 300) where n = 1),
g as (select source_id, p, md5(substr(content, p, 300)) r from (select source_id, content, unnest(range(1, length(content) - 298)) p from f)),
k as (select r from g group by r having min(source_id) <> max(source_id)), """


@query(_RUNS + "d as (select distinct g.source_id, g.r from g join k using (r)) select distinct a.source_id source_id_a, b.source_id source_id_b from d a join d b on a.r = b.r and a.source_id < b.source_id")
def p6_found(spark, d):
    """Pairs of records that share a run of at least 300 characters."""
    return spans.shared_pairs(table(spark, d, "source_files"))


@query(_RUNS + """m as (select g.source_id, p, coalesce(lead(p) over (partition by g.source_id order by p), p + 300) q from g join k using (r)), c as (select source_id, sum(least(300, q - p))::bigint shared_chars from m group by 1),
a as (select source_id, arg_max(coalesce(length(content), 0), (content is not null, ingested_at))::bigint chars from source_files where source_id is not null group by 1)
select a.source_id, chars, coalesce(shared_chars, 0)::bigint shared_chars, round(coalesce(shared_chars, 0) / nullif(chars, 0), 6) as "share" from a left join c using (source_id)""")
def p6_shares(spark, d):
    """The share of each record that is found elsewhere."""
    return spans.shared_shares(table(spark, d, "source_files"))


@query()
def p8_ids(spark, d):
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents"))


@query("select doc_id, true as same from documents")
def p8_roundtrip(spark, d):
    """Whether each document's ids decode to its text; null and empty texts both decode to an empty text."""
    docs = table(spark, d, "documents")
    back = encode.decode_corpus(encode.encode_corpus(docs), encode.token_bytes(spark)).withColumnRenamed("text", "back")
    return docs.select("doc_id", "text").join(back, "doc_id", "left").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


@query()
def p5_found(spark, d):
    """Files that aren't valid in the language of their extension."""
    return syntax.unparsable(table(spark, d, "source_files")).select("source_id")


@query()
def p5_repairs(spark, d):
    """Least edits, kind of damage and first damaged line of each file that doesn't parse."""
    rows = syntax.checked(table(spark, d, "source_files")).where("cost > 0")
    return rows.select("source_id", "repo_id", "path", "syntax", "cost", "damage", "first_line", "edits")


@query()
def p5_rates(spark, d):
    """Rates of files that don't parse, per repository and language."""
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "compiler_diagnostics"))


@query()
def p1_found(spark, d):
    """Functions and methods with documentation of their own."""
    return docs.documented(table(spark, d, "source_files"), table(spark, d, "symbols"))


@query()
def p1_pairs(spark, d):
    """Code with its description, inherited descriptions resolved."""
    return docs.pairs(table(spark, d, "source_files"), table(spark, d, "symbols"))


@query()
def p7_found(spark, d):
    """Lines on which a credential begins."""
    return credentials.credentials(table(spark, d, "source_files"), table(spark, d, "evidence")).select("record_table", "record_id", "line_no").distinct()


@query()
def p7_redacted(spark, d):
    """Every text with its credentials masked."""
    return credentials.redacted(table(spark, d, "source_files"), table(spark, d, "evidence"))


@query()
def p2_found(spark, d):
    """Files that are generated, minified, vendored or data."""
    return origins.not_handwritten(table(spark, d, "source_files")).select("source_id")


@query()
def p2_labels(spark, d):
    """Every file's label with its belief, beside the classification it came with."""
    return origins.classified(table(spark, d, "source_files"))


@query()
def p10_found(spark, d):
    """The subjects that each document is about."""
    return subjects.assigned(table(spark, d, "documents"), table(spark, d, "subject_labels")).select("doc_id", "subject_id")


@query()
def p10_composition(spark, d):
    """The corpus by subject."""
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


@query()
def p9_shares(spark, d):
    """Actual token shares of the mixture beside their targets."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


@query()
def p9_copies(spark, d):
    """How often each document is taken."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))
