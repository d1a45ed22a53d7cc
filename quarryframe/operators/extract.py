"""Extraction of typed relationships from source text with built-in expressions: one row in, many rows out, no Python.

Rows are (repo_id, path, line, target, predicate, confidence). Null contents give none; every line is read; a line with several
matches gives a row for each; predicates and confidences are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels

# (languages, pattern, group of the target, predicate, confidence); predicates, confidences and the patterns of routes, elements, environment
# names and placeholders are fixed values
_JS, _JVM = ("typescript", "tsx", "javascript", "jsx"), ("java", "kotlin")
RULES: tuple[tuple[tuple[str, ...], str, int, str, float], ...] = (
    (_JS, r"""^\s*import\b[^'"]*['"]([^'"]+)['"]""", 1, "IMPORTS", 1.0),
    (_JVM, r"^\s*import\s+(?:static\s+)?([\w.]+)", 1, "IMPORTS", 1.0),
    (_JS, r"""<Route\b[^>]*\bpath\s*=\s*["']([^"']+)["']""", 1, "DECLARES_UI_ROUTE", 0.95),
    (_JS, r"\belement\s*=\s*\{\s*<([A-Za-z_$][\w$]*)", 1, "ROUTE_RENDERS_COMPONENT", 0.95),
    (_JS, r"""\b(?:fetch|axios(?:\.\w+)?)\(\s*['"`]([^'"`$]+)['"`]""", 1, "INVOKES_API", 0.95),
    (_JS, r"""\bconsole\.(?:log|info|warn|debug)\(\s*["']([^"']*)["']""", 1, "EMITS_LOG", 0.95),
    (_JS, r"""\bconsole\.error\(\s*["']([^"']*)["']""", 1, "EMITS_ERROR", 0.95),
    (_JS, r"""\bdispatchEvent\(\s*new\s+\w+\(\s*["']([^"']+)["']""", 1, "PUBLISHES_EVENT", 0.95),
    (_JS, r"""\baddEventListener\(\s*["']([^"']+)["']""", 1, "SUBSCRIBES_EVENT", 0.95),
    (_JS, r"(?:process\.env|import\.meta\.env)\.([A-Za-z_]\w*)", 1, "REFERENCES_CONFIGURATION", 0.95),
    (_JS + _JVM, r"\bthrow\s+(?:new\s+)?([A-Z][\w$.]*)\s*\(", 1, "EMITS_ERROR", 0.95),
    (_JVM, r"""@(?:Request|Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]+)\"""", 1, "DECLARES_ENDPOINT", 0.9),
    (_JVM, r"""@JmsListener\([^)]*"([^"]+)\"""", 1, "LISTENS_QUEUE", 0.95),
    (_JVM, r"""@KafkaListener\([^)]*"([^"]+)\"""", 1, "CONSUMES_TOPIC", 0.95),
    (_JVM, r"""@Table\([^)]*"([^"]+)\"""", 1, "MAPS_TABLE", 0.95),
    (_JVM, r"(?:publishEvent|multicastEvent)\s*\(\s*new\s+([A-Za-z_$][\w$.]*)", 1, "PUBLISHES_EVENT", 0.95),
    (_JVM, r"""\bkafkaTemplate\.(?:send|convertAndSend)\(\s*"([^"]+)\"""", 1, "PRODUCES_TOPIC", 0.95),
    (_JVM, r"""\bjmsTemplate\.(?:send|convertAndSend)\(\s*"([^"]+)\"""", 1, "SENDS_QUEUE", 0.95),
    (_JVM, r"""\b(?:rest|web)(?:Template|Client)\.\w+\(\s*"([^"]+)\"""", 1, "INVOKES_API", 0.9),
    (_JVM, r"""\blog(?:ger)?\.(?:trace|debug|info|warn)\(\s*"([^"]*)\"""", 1, "EMITS_LOG", 0.95),
    (_JVM, r"""\blog(?:ger)?\.error\(\s*"([^"]*)\"""", 1, "EMITS_ERROR", 0.95),
    (_JS + _JVM, r"\$\{([A-Za-z0-9_.-]+)(?::[^}]*)?\}", 1, "REFERENCES_CONFIGURATION", 0.95),
)


def lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, line, text) with lines counted from 1."""
    lang = labels.language_of(F.col("path"))
    return files.where("content is not null").select("repo_id", "path", lang.alias("language"), F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("repo_id", "path", "language", (F.col("pos") + 1).alias("line"), "text")


def relationships(files: DataFrame) -> DataFrame:
    """All rules in one pass over the lines: each line builds the array of its matches, which is then exploded."""
    def found(langs: tuple[str, ...], pattern: str, group: int, predicate: str, confidence: float) -> Column:
        hits = F.when(F.col("language").isin(*langs), F.regexp_extract_all("text", F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, lambda t: F.struct(t.alias("target"), F.lit(predicate).alias("predicate"), F.lit(confidence).alias("confidence")))

    return lines(files).select("repo_id", "path", "line", F.explode(F.concat(*[found(*r) for r in RULES])).alias("x")).select("repo_id", "path", "line", "x.target", "x.predicate", "x.confidence").where("target <> ''")


def is_configuration(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(ya?ml|properties)$")


def configuration_keys(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, key): keys in front of the first ':' or '=' of configuration lines; comments are skipped."""
    rows = lines(files.where(is_configuration(F.col("path")))).withColumn("t", F.trim("text"))
    key = F.trim(F.regexp_extract("t", r"^([^:=#]+?)\s*[:=]", 1))
    return rows.where("t <> '' and t not like '#%'").select("repo_id", "path", "line", key.alias("key")).where("key <> ''")


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(repo_id, path, dependency) from JSON manifests: names under dependencies, devDependencies or packages; other JSON gives none."""
    m = "map<string,string>"
    rows = files.where(F.lower("path").endswith(".json")).select("repo_id", "path", F.from_json("content", f"dependencies {m}, devDependencies {m}, packages {m}").alias("j"))
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "packages")]))
    return rows.select("repo_id", "path", F.explode(names).alias("dependency")).distinct()


def sql_tables(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, sql_table, access): tables named in string literals that hold SQL."""
    hit = F.regexp_extract_all("text", F.lit(r"""(?i)["'`]\s*((?:select\s[^"'`]+?\sfrom|delete\s+from|insert\s+into|update)\s+[A-Za-z_][\w$.]*)"""), 1)
    rows = lines(files).select("repo_id", "path", "line", F.explode(hit).alias("s"))
    access = F.when(F.lower("s").startswith("select"), "READS_TABLE").otherwise("WRITES_TABLE")
    return rows.select("repo_id", "path", "line", F.regexp_extract("s", r"([A-Za-z_][\w$.]*)$", 1).alias("sql_table"), access.alias("access"))


# (languages, kind, pattern with the name as its group) (fixed values)
DECLARATIONS: tuple[tuple[tuple[str, ...], str, str], ...] = (
    (_JS + _JVM + ("python",), "class", r"^\s*(?:(?:export|default|public|private|protected|internal|abstract|final|sealed|open|data|static)\s+)*class\s+([A-Za-z_$][\w$]*)"),
    (_JS + ("java",), "interface", r"^\s*(?:(?:export|public|private|protected)\s+)*interface\s+([A-Za-z_$][\w$]*)"),
    (_JS, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*[(<]"),
    (("kotlin",), "function", r"^\s*(?:(?:public|private|protected|internal|suspend|inline|override|open|operator)\s+)*fun\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)\s*\("),
    (("python",), "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*[(\[]"),
    (("java",), "method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], .?]+\s+([A-Za-z_]\w*)\s*\("),
)


def declarations(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, kind, name): declarations told by the heads of lines."""
    def found(langs: tuple[str, ...], kind: str, pattern: str) -> Column:
        name = F.when(F.col("language").isin(*langs), F.regexp_extract("text", pattern, 1)).otherwise("")
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    rows = lines(files).select("repo_id", "path", "line", F.explode(F.array(*[found(*d) for d in DECLARATIONS])).alias("x"))
    return rows.select("repo_id", "path", "line", "x.kind", "x.name").where("name <> ''")


def nearest_declaration(rows: DataFrame, decls: DataFrame) -> DataFrame:
    """Rows (repo_id, path, line) with the last declaration at or above their line, '<file>' if there is none: one sort per file, no pairs."""
    from pyspark.sql import Window

    a = rows.select("repo_id", "path", "line", F.lit(1).alias("is_row"), F.lit(None).cast("string").alias("name"))
    b = decls.groupBy("repo_id", "path", "line").agg(F.min("name").alias("name")).select("repo_id", "path", "line", F.lit(0).alias("is_row"), "name")
    w = Window.partitionBy("repo_id", "path").orderBy("line", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("scope", F.last("name", ignorenulls=True).over(w))
    return both.where("is_row = 1").select("repo_id", "path", "line", F.coalesce("scope", F.lit("<file>")).alias("scope"))
