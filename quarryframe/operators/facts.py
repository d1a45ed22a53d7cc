"""Facts told by whole source texts: calls, annotations, messages, routes and the conditions around them.

Unlike the rules over lines, these see calls and annotations that are wrapped over lines. Everything but the conditions is built-in
expressions, one row in and many rows out; conditions need a matching of brackets and run in Arrow batches. Null contents and texts of
other languages give none; comments are no code; a fact told several times in a file has its count; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels

JS, JVM = ("typescript", "tsx", "javascript", "jsx"), ("java", "kotlin")
STRINGS = r""""[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`]*`"""
COMMENTS = r"(?s:/\*.*?\*/)|//[^\n]*"

# Annotations to the facts they tell: predicate and confidence (fixed values).
ANNOTATIONS: dict[str, tuple[tuple[str, float], ...]] = {
    **{f"{m}Mapping": (("DECLARES_ENDPOINT", 0.9),) for m in ("Request", "Get", "Post", "Put", "Patch", "Delete")},
    "JmsListener": (("LISTENS_QUEUE", 0.95), ("CONSUMES_EVENT", 0.9)), "KafkaListener": (("CONSUMES_TOPIC", 0.95), ("CONSUMES_EVENT", 0.9)), "EventListener": (("LISTENS_EVENT", 0.95), ("CONSUMES_EVENT", 0.9)),
    "FeignClient": (("DEPENDS_ON_EXTERNAL", 0.95),), "Value": (("REFERENCES_CONFIGURATION", 0.95),), "ConfigurationProperties": (("BINDS_CONFIGURATION", 0.95),), "Table": (("MAPS_TABLE", 0.95),),
}
# Annotations that tell a gap where they have no literal (fixed values).
DYNAMIC = (*[f"{m}Mapping" for m in ("Request", "Get", "Post", "Put", "Patch", "Delete")], "JmsListener", "KafkaListener", "Value", "ConfigurationProperties", "Table")
# Template to the facts of a send with a literal destination (fixed values).
SENDS = {"kafkaTemplate": (("PRODUCES_TOPIC", 0.95), ("EMITS_EVENT", 0.9)), "jmsTemplate": (("SENDS_QUEUE", 0.95), ("EMITS_EVENT", 0.9))}
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
# Words before a name and a parenthesis that leave it a call, and words that are no calls themselves (fixed values of the languages).
BEFORE_CALL = ("return", "else", "throw", "await", "yield", "case", "in", "of", "do", "when")
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "super", "this", "constructor", "synchronized", "await", "when", "try", "new", "import", "throw", "assert", "yield", "do", "else", "void", "delete", "in", "of", "case", "fun")


def _texts(files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(repo_id, path, language, text) of the files of some languages, comments taken out."""
    lang = labels.language_of(F.col("path"))
    bare = F.regexp_replace("content", f"({STRINGS})|{COMMENTS}", "$1")
    return files.where("content is not null").select("repo_id", "path", lang.alias("language"), bare.alias("text")).where(F.col("language").isin(*languages))


def _literal(c: Column) -> Column:
    """The first string literal of a match, without its quotes; '' if there is none."""
    return F.regexp_extract(c, "[\"'`]([^\"'`\\n]*)[\"'`]", 1)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.where("target <> ''").groupBy("repo_id", "path", "target", "predicate", "confidence").agg(F.count("*").alias("times"))


def _facts(pairs: tuple[tuple[str, float], ...]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("predicate"), F.lit(c).alias("confidence")) for p, c in pairs])


def calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, target, predicate, confidence, times): calls of plain names; declarations, methods of objects and words of the language aren't."""
    t = F.regexp_replace("text", STRINGS, '""')
    t = F.regexp_replace(t, r"\n\s*(?:(?:async|static|get|set|override|private|public|protected)\s+)*[A-Za-z_$][\w$]*\s*\([^()]*\)\s*(?::[^={};\n]+)?\{", "\n{")  # members of classes
    t = F.regexp_replace(t, r"[\w\]?>][>\]]\s+[A-Za-z_$][\w$]*\s*\(", ">(")  # declarations behind a generic or array type
    t = F.regexp_replace(t, r"\(", "( ")
    found = F.regexp_extract_all(t, F.lit(r"[^\w$.@]((?:[\w$]+\s+)?[A-Za-z_$][\w$]*)\s*\("), 1)
    rows = _texts(files, JS + JVM).select("repo_id", "path", F.explode(found).alias("m"))
    name, head = F.regexp_extract("m", r"([A-Za-z_$][\w$]*)$", 1), F.regexp_extract("m", r"^([\w$]+)\s", 1)
    rows = rows.select("repo_id", "path", name.alias("target"), head.alias("head")).where((F.col("head") == "") | F.col("head").isin(*BEFORE_CALL)).where(~F.col("target").isin(*NO_CALL))
    return _counted(rows.withColumn("predicate", F.lit("CALLS")).withColumn("confidence", F.lit(0.8)))


def http_calls(files: DataFrame) -> DataFrame:
    """Requests of user interfaces: the address and 'METHOD address', or a gap where the address isn't literal; micro-frontends by name."""
    m = F.col("m")
    t = _texts(files, JS)
    asks = t.select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"""\b(?:fetch|axios\.(?:get|post|put|patch|delete))\s*\(\s*(?:"[^"\n]*"|'[^'\n]*'|`[^`$]*`|[^\s])"""), 0)).alias("m"))
    url = _literal(m)
    verb = F.when(m.startswith("fetch"), "GET").otherwise(F.upper(F.regexp_extract(m, r"^axios\.(\w+)", 1)))
    row = lambda target, p, c: F.struct(target.alias("target"), F.lit(p).alias("predicate"), F.lit(c).alias("confidence"))
    told = F.when(url != "", F.array(row(url, "INVOKES_API", 0.95), row(F.concat_ws(" ", verb, url), "INVOKES_API", 0.95))).otherwise(F.array(row(F.lit("nonliteral_http_url"), "COVERAGE_GAP", 0.0)))
    apps = t.select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"""\bregisterApplication\s*\([^()"'`]*["'`]([^"'`\n]+)["'`]"""), 1)).alias("target"))
    return _counted(asks.select("repo_id", "path", F.explode(told).alias("x")).select("repo_id", "path", "x.*").unionByName(apps.withColumn("predicate", F.lit("REGISTERS_MICROFRONTEND")).withColumn("confidence", F.lit(0.85))))


def annotations(files: DataFrame) -> DataFrame:
    """What annotations tell, some of it twice; a known one without a literal is a gap, of a value only the first placeholder counts."""
    m = F.col("m")
    found = F.regexp_extract_all("text", F.lit(r"@(?:" + "|".join(ANNOTATIONS) + r")\b(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?"), 0)
    rows = _texts(files, JVM).select("repo_id", "path", F.explode(found).alias("m")).select("repo_id", "path", F.regexp_extract(m, r"^@(\w+)", 1).alias("name"), _literal(m).alias("lit"))
    value = F.when(F.col("name") == "Value", F.regexp_extract("lit", r"\$\{([A-Za-z0-9_.\-]+)", 1)).otherwise(F.col("lit"))
    table = F.create_map(*[x for k, v in ANNOTATIONS.items() for x in (F.lit(k), _facts(v))])
    told = rows.where("lit <> ''").select("repo_id", "path", value.alias("target"), F.explode(table[F.col("name")]).alias("x")).select("repo_id", "path", "target", "x.*")
    gaps = rows.where((F.col("lit") == "") & F.col("name").isin(*DYNAMIC)).select("repo_id", "path", F.concat(F.lit("dynamic_"), F.lower("name")).alias("target"), F.lit("COVERAGE_GAP").alias("predicate"), F.lit(0.0).alias("confidence"))
    return _counted(told.unionByName(gaps))


def messages(files: DataFrame) -> DataFrame:
    """Sends to topics and queues, published events and requests of services, with their twins; computed destinations are gaps."""
    m, t = F.col("m"), _texts(files, JVM)
    sends = t.select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:kafkaTemplate|jmsTemplate)\s*\.\s*(?:convertAndSend|send)\s*\([^()]*"), 0)).alias("m")).select("repo_id", "path", F.regexp_extract(m, r"^(\w+)", 1).alias("via"), _literal(m).alias("target"))
    table = F.create_map(*[x for k, v in SENDS.items() for x in (F.lit(k), _facts(v))])
    sent = sends.where("target <> ''").select("repo_id", "path", "target", F.explode(table[F.col("via")]).alias("x")).select("repo_id", "path", "target", "x.*")
    gaps = sends.where("target = ''").select("repo_id", "path", F.lit("computed_message_destination").alias("target"), F.lit("COVERAGE_GAP").alias("predicate"), F.lit(0.0).alias("confidence"))
    events = t.select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:publishEvent|multicastEvent)\s*\(\s*new\s+([A-Za-z_$][\w$.]*)"), 1)).alias("target"), ).select("repo_id", "path", "target", F.explode(_facts((("PUBLISHES_EVENT", 0.95), ("EMITS_EVENT", 0.82)))).alias("x")).select("repo_id", "path", "target", "x.*")
    asks = t.select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:restTemplate|webClient|restClient)\s*\.\s*\w+\s*\([^()]*"), 0)).alias("m")).select("repo_id", "path", F.upper(F.regexp_extract(m, r"\.\s*(\w+)", 1)).alias("how"), _literal(m).alias("url")).where("url <> ''")
    verb = F.lit("")
    for v in VERBS:
        verb = F.when(F.col("how").startswith(v), v).otherwise(verb)
    asked = asks.select("repo_id", "path", F.explode(F.array(F.col("url"), F.when(verb != "", F.concat_ws(" ", verb, "url")).otherwise(""))).alias("target"), F.lit("INVOKES_API").alias("predicate"), F.lit(0.9).alias("confidence"))
    return _counted(sent.unionByName(gaps).unionByName(events).unionByName(asked))


def effective_routes(files: DataFrame) -> DataFrame:
    """(repo_id, path, target, predicate, confidence, times): the path of the class's mapping before that of each method's, with the method."""
    a = r"@\w+(?:\s*\([^()]*\))?\s*"
    of_class = r"@RequestMapping\s*\(([^()]*)\)\s*(?:" + a + r")*(?:(?:public|protected|private|abstract|final|open|sealed)\s+)*(?:class|interface)\b"
    t = _texts(files, JVM)
    prefix = _literal(F.regexp_extract("text", of_class, 1))
    own = F.regexp_extract_all(F.regexp_replace("text", of_class, " class"), F.lit(r"@(?:Request|Get|Post|Put|Patch|Delete)Mapping\s*\([^()]*\)"), 0)
    rows = t.select("repo_id", "path", prefix.alias("prefix"), F.explode(own).alias("m"))
    rows = rows.select("repo_id", "path", "prefix", F.upper(F.regexp_extract("m", r"^@(\w+)Mapping", 1)).alias("verb"), _literal(F.col("m")).alias("own")).where("own <> ''")
    trim = lambda c: F.btrim(F.col(c), F.lit("/"))
    route = F.when(F.col("prefix") == "", F.col("own")).otherwise(F.concat(F.lit("/"), trim("prefix"), F.lit("/"), trim("own")))
    return _counted(rows.select("repo_id", "path", F.concat_ws(" ", "verb", route).alias("target"), F.lit("DECLARES_EFFECTIVE_ENDPOINT").alias("predicate"), F.lit(0.9).alias("confidence")))


_BLANK = re.compile(f"{STRINGS}|{COMMENTS}", re.S)
_IF = re.compile(r"\bif\s*\(")
_FACT = re.compile(r"\bthrow\b|\b(?:fetch|axios\.\w+|console\.(?:error|warn|log|info)|(?:[\w$.]+\.)?(?:dispatchEvent|addEventListener)|publishEvent|(?:kafkaTemplate|jmsTemplate)\s*\.\s*(?:convertAndSend|send)|(?:restTemplate|webClient|restClient)\s*\.\s*\w+|log(?:ger)?\.(?:trace|debug|info|warn|error))\s*\(")
_OPEN = {"(": ")", "{": "}", "[": "]"}


def _closing(text: str, at: int) -> int:
    """Where the bracket at text[at] closes, or the end."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] in "([{":
            depth += 1
        elif text[k] in ")]}":
            depth -= 1
            if not depth:
                return k
    return len(text)


def _statement_end(text: str, at: int) -> int:
    """Where the statement that begins at text[at] ends: its block, or its semicolon."""
    while at < len(text) and text[at].isspace():
        at += 1
    if text[at : at + 1] == "{":
        return _closing(text, at)
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] in "([{") - (text[k] in ")]}")
        if depth < 0 or not depth and text[k] in ";\n" and text[at:k].strip():
            return k
    return len(text)


def guarded(text: str) -> list[tuple[int, str]]:
    """(line, condition) of each fact in a text that lies in a conditional statement: the innermost one's."""
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    spans = []
    for m in _IF.finditer(bare):
        close = _closing(bare, m.end() - 1)
        end = _statement_end(bare, close + 1)
        other = re.compile(r"[\s;}]*\belse\b").match(bare, end)
        if other and not re.compile(r"\s*if\b").match(bare, other.end()):
            end = _statement_end(bare, other.end())
        spans.append((m.end(), close, end, text[m.end() : close].strip().strip("()")))
    out = []
    for m in _FACT.finditer(bare):
        inside = [s for s in spans if s[1] < m.start() < s[2] and s[3]]
        if inside:
            out.append((text.count("\n", 0, m.start()) + 1, max(inside)[3]))
    return out


def guards(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, target, predicate, confidence): the innermost condition around each emission, request, message or error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, p, line, g, "HAS_LOCAL_GUARD", 1.0) for r, p, c in zip(f["repo_id"], f["path"], f["content"], strict=True) for line, g in guarded(c)]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "line", "target", "predicate", "confidence"])

    rows = files.where("content is not null").where(labels.language_of(F.col("path")).isin(*JS, *JVM)).select("repo_id", "path", "content")
    return rows.mapInPandas(run, "repo_id string, path string, line int, target string, predicate string, confidence double").distinct()


def positions(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (generation_id, path, start_byte) with the line and column (in bytes, from 1) that the byte has in the file's text."""
    f = files.where("content is not null").select("generation_id", "path", F.encode("content", "UTF-8").alias("b"))
    hit = spans.join(f, ["generation_id", "path"]).where("start_byte >= 0 and start_byte <= octet_length(b)")
    before = F.expr("cast(substring(b, 1, cast(start_byte as int)) as string)")
    last = F.length(F.substring_index(before, "\n", -1))  # whole lines before it are whole characters
    whole = F.octet_length(F.substring(before, F.lit(1), F.length(before) - last))
    return hit.select(*spans.columns, (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.col("start_byte") - whole + 1).cast("int").alias("column"))
