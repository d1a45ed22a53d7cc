"""Generated, minified, vendored and blob files, by belief propagation over directory trees.

Each file gives evidence from its text and name (markers of generators and licences in the comments before its first code, lock files, dense long lines,
rows of literals) and each directory from its name; copies of one text share the strongest evidence that it is third-party
code. Messages then run up the tree of a repository from files to directories, level by level, and down again: a directory
takes after its children and its parent, a file after its directory. What a directory hears from its children counts as that of
``VOICES`` of them at most, on average, since siblings aren't independent witnesses. All messages of a level are one aggregation or join keyed
by directory, so a repository of any size is spread over all tasks. The label with the greatest belief is the file's.

Defined results: null and empty texts are judged by path and neighbours only; the last row of a redelivered record holds; a
null path is a file in the root without a name; a null repository is one of its own; rows without source_id are dropped; empty
tables give no rows; the given classification is only reported beside the result, since it is too coarse or wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
_N = len(LABELS)
#: Log odds of clear evidence.
CLEAR = 8.0
#: The children of a directory weigh together as so many at most.
VOICES = 1.2

# Given the label of a directory (row), how its files and its subdirectories are labelled (columns as LABELS).
_FILE = np.array([[0.70, 0.12, 0.05, 0.09, 0.04], [0.04, 0.92, 0.01, 0.02, 0.01], [0.25, 0.04, 0.66, 0.03, 0.02], [0.01, 0.02, 0.02, 0.94, 0.01], [0.35, 0.03, 0.01, 0.01, 0.60]])
_DIR = np.array([[0.92, 0.03, 0.01, 0.03, 0.01], [0.03, 0.94, 0.01, 0.01, 0.01], [0.30, 0.03, 0.63, 0.02, 0.02], [0.01, 0.01, 0.01, 0.96, 0.01], [0.40, 0.03, 0.02, 0.02, 0.53]])

_COMMENT = re.compile(r"^\s*(?://|#|/?\*|<!--|--|;|%|\"\"\"|''')")
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto[- ]?generated\b|\bautomatically generated\b|\b(?:code|file|source|class|module|this)\b.{0,24}\bgenerated\b.{0,12}\b(?:by|from|with|using|on|via)\b|^\W*generated (?:by|from|with|on|using|via|code|file|at)\b|\bgenerated\b.{0,60}\bdo not (?:edit|modify|change)\b|\bdo not (?:edit|modify)\b.{0,30}\b(?:generated|by hand|manually)\b|\bmachine[- ]generated\b|\bcode generator\b.{0,20}\bdo not\b"
    r"|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand (?:bearbeiten|ändern)\b|\bgénéré automatiquement\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\b(?:edits|changes|modifications) (?:are|will be) (?:overwritten|lost)\b", re.I)  # fmt: skip
_LICENSED = re.compile(
    r"\b(?:MIT|BSD|ISC|Apache|MPL|LGPL|GPL|Unlicense)[ -](?:\d-Clause )?licen[sc]e\b|\blicensed under the\b|\breleased under\b|\bSPDX-License-Identifier\b|@licen[sc]e\b|\bupstream:\s*\S|\b(?:imported|copied|vendored|taken) (?:unchanged |verbatim |unmodified )?from\b|\(c\) (?:the )?[\w.-]+ (?:authors|contributors)|\bcopyright\b.{0,30}\b(?:authors|contributors|developers)\b|\bdistributed under\b", re.I)
_LOCK = re.compile(r"(?:^|[/._-])(?:lock\.(?:json|ya?ml|toml)|package-lock\.json|pnpm-lock\.ya?ml|shrinkwrap\.ya?ml)$|(?:^|/)(?:npm-shrinkwrap\.json|yarn\.lock|poetry\.lock|cargo\.lock|gemfile\.lock|composer\.lock|pipfile\.lock|go\.sum|packages\.lock\.json|[\w.-]+\.lock)$", re.I)
_GEN_NAME = re.compile(r"\.(?:g|gen|generated|pb|pb\.\w+|designer|g\.\w+)\.\w+$|_pb2(?:_grpc)?\.pyi?$|_generated\.\w+$|\.pb\.go$", re.I)
_MIN_NAME = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.bundle\.js$|\.[0-9a-f]{8,}\.(?:js|css)$", re.I)
_LITERAL_ROW = re.compile(r"""["'`]?[A-Za-z0-9+/=_-]{40,}["'`]?\s*[,;+]?|["'`](?:\\x[0-9a-fA-F]{2}|\\\d{3}|[0-9a-fA-F]{2}[ :,]?){8,}["'`]\s*[,;+]?|[\[({]*[\s\d.,xXa-fA-FuUlL+\-eE_]*\d[\s\d.,xXa-fA-FuUlL+\-eE_]*[\])}]*\s*[,;]?(?:\s*(?:\#|//).*)?|[\[({]\s*["'][^"']*["'](?:\s*,\s*[-\d."'\w+]+)+\s*[\])}]\s*[,;]?|-?[\d.]+(?:[,;\t ]-?[\d.]+)+""")
_VENDOR_DIRS = frozenset("third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages site-packages pods carthage".split())
_LIBRARY_HOLDERS = frozenset("vendor vendored external externals deps extern contrib".split())
_GEN_DIRS = frozenset("generated __generated__ generated-sources generated_sources generated-src autogen gen gen-src codegen-out".split())
_VERSIONED = re.compile(r"^@?[a-z][\w.-]*(?:@|-v?)\d+\.\d+(?:\.\d+)?[\w.-]*$", re.I)


#: A table of literals is data from so many characters; shorter ones are what people write in code.
LITERALS = 600
#: Shorter texts aren't told to be copies of each other: they are too easily written twice.
SHORTEST_COPY = 200


def head_comments(text: str) -> str:
    """The comments at the head of a text, however long, up to code that isn't a package or import line."""
    out, close = [], ""
    for line in text.split("\n"):
        s = line.strip()
        while close or s.startswith(("/*", "<!--")):
            start = 0 if close else 2 if s.startswith("/*") else 4
            close = close or ("*/" if start == 2 else "-->")
            end = s.find(close, start)
            if end < 0:
                out.append(s)
                s = ""
                break
            out.append(s[: end + len(close)])
            s, close = s[end + len(close) :].strip(), ""
        if _COMMENT.match(s):
            out.append(s)
        elif s and not re.match(r"(?:package|import|from|using|use|require|'use strict'|\"use strict\")\b", s):
            break
    return "\n".join(out)


def body_key(text: str) -> int:
    """A digest of the text without its comment head and white space, by which copies meet."""
    lines = text.split("\n")
    k, inside = 0, False
    while k < len(lines):
        s = lines[k].strip()
        if s and not inside and not _COMMENT.match(lines[k]):
            break
        inside = ("/*" in s or inside) and "*/" not in s
        k += 1
    return xxhash.xxh3_64_intdigest("".join("".join(lines[k:]).split())) - (1 << 63)


def evidence(path: str, text: str | None) -> list[float]:
    """Log potentials of the labels from a file's own name and text."""
    u = [0.0] * _N
    low = (path or "").lower()
    name = low.rsplit("/", 1)[-1]
    if _LOCK.search(low) and not name.endswith((".java", ".kt", ".ts", ".tsx", ".js", ".jsx", ".py")):
        u[1] += CLEAR
    if _GEN_NAME.search(low):
        u[1] += 5.0
    if _MIN_NAME.search(name):
        u[2] += 2.5
    if not text:
        return u
    # a text without marks is hardly minified or a blob; it may well be third-party or generated code
    u[1], u[2], u[3], u[4] = u[1] - 1.2, u[2] - 5.0, u[3] - 0.3, u[4] - 5.0
    head = head_comments(text)
    if head:
        if _GENERATED.search(head):
            u[1] += CLEAR
        if _LICENSED.search(head):
            u[3] += CLEAR
    n = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    prose = low.endswith((".md", ".rst", ".txt", ".adoc", ".html"))
    if not prose and n > 120 and lines:
        code = sorted((len(x) for x in lines), reverse=True)
        # long lines hold most of the text, and hardly any of it is white space
        in_long = sum(x for x in code if x > min(250, n / 2)) / n
        blank = sum(text.count(c) for c in " \t\n") / n
        # of a short text, nearly all that people put between words must be gone
        if in_long > 0.7 and (n > 400 or blank < 0.05) and low.endswith((".js", ".mjs", ".cjs", ".css", ".ts", ".jsx", ".tsx", ".html", ".java", ".kt", ".py")):
            u[2] += 5.0 + (CLEAR if blank < 0.14 else 2.0)
    if not prose and lines and n > LITERALS:
        literal = sum(len(x.strip()) for x in lines if _LITERAL_ROW.fullmatch(x.strip())) / sum(len(x.strip()) for x in lines)
        if literal > 0.8:
            u[4] += 5.0 + CLEAR
        elif literal > 0.6 and n > 6 * LITERALS:
            u[4] += 5.0 + 3.0
    return u


def directory_evidence(path: str) -> list[float]:
    """Log potentials of a directory from the names on its path; a holder of libraries counts only with a library below it."""
    u = [0.0] * _N
    parts = path.lower().split("/")
    last = parts[-1]
    if last in _VENDOR_DIRS:
        u[3] += CLEAR
    elif len(parts) > 1 and parts[-2] in _LIBRARY_HOLDERS and (len(parts) == 2 or parts[-3] in ("src", "tools", "app", "packages", "web")):
        u[3] += CLEAR
    elif _VERSIONED.match(last):
        u[3] += 4.0
    elif last in _GEN_DIRS:
        u[1] += CLEAR
    return u


def _evidence_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [evidence(p, t) for p, t in zip(f["path"], f["content"], strict=True)]
        out = f[["source_id", "repo_id", "path", "classification", "ingested_at"]].copy()
        out["u"] = rows
        out["copy"] = pd.array([body_key(t) if t and len(t) >= SHORTEST_COPY else None for t in f["content"]], dtype="Int64")
        yield out


def _directory_potentials(c: str) -> Column:
    return F.pandas_udf(lambda paths: paths.map(directory_evidence), T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR)(F.col(c))


def _vector(parts: list[Column]) -> Column:
    return F.array(*parts)


def _message(u: Column, table: np.ndarray, up: bool) -> Column:
    """The message over an edge, in logs: up from a child's potentials to its parent, or down from a parent to its child."""
    weights = table if up else table.T

    def send(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, _N))
        top = x.max(axis=1, keepdims=True) if len(x) else x[:, :1]
        return pd.Series(list(np.log(np.exp(x - top) @ weights.T)))

    return F.pandas_udf(send, T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR)(u)


def _voices(rows: DataFrame, by: list[str | Column]) -> DataFrame:
    """The children's messages m together, and the weight w with which each of them counts."""
    w = F.least(F.lit(1.0), F.lit(VOICES) / F.count("*"))
    return rows.groupBy(*by).agg(_vector([F.sum(F.col("m")[i]) * w for i in range(_N)]).alias("m"), w.alias("w"))


def _plus(a: Column, b: Column, weight: Column | None = None) -> Column:
    """Sum of two vectors, the second weighted; a missing one is zero."""
    w = F.lit(1.0) if weight is None else weight
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + w * y))


def files_with_evidence(sources: DataFrame) -> DataFrame:
    """(source_id, repo_id, dir, path, classification, u): one row per record; copies share evidence of third-party code."""
    rows = sources.where("source_id is not null").select("source_id", F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.coalesce("path", F.lit("")).alias("path"), "classification", "content", "ingested_at")
    rows = rows.mapInPandas(_evidence_frames, "source_id string, repo_id string, path string, classification string, ingested_at timestamp_ntz, u array<double>, copy long")
    last = rows.groupBy("source_id").agg(F.max_by(F.struct("repo_id", "path", "classification", "u", "copy"), "ingested_at").alias("v")).select("source_id", "v.*")
    last = last.withColumn("dir", F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), r"^/+", ""))
    # third-party evidence of a text: its licence head or any of its places
    chain = F.exists(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/")), lambda d: d.rlike(_VENDOR_PLACE))
    shared = last.where("copy is not null").groupBy("copy").agg(F.count("*").alias("n"), F.max((F.col("u")[3] > 0) | chain).alias("foreign")).where("n > 1 and foreign").select("copy", "foreign")
    # texts without a copy key are spread by their own ids instead of meeting in one task
    key, has = F.coalesce("copy", F.xxhash64("source_id")), F.col("copy").isNotNull()
    last = last.withColumns({"k": key, "has": has}).join(shared.select(F.col("copy").alias("k"), F.lit(True).alias("has"), "foreign"), ["k", "has"], "left")
    u = _plus(F.col("u"), F.when(F.col("foreign"), F.array(*[F.lit(CLEAR if i == 3 else 0.0) for i in range(_N)])))
    return last.select("source_id", "repo_id", "dir", "path", "classification", u.alias("u"))


_VENDOR_PLACE = r"(?i)(^|/)(third_party|third-party|thirdparty|3rdparty|3rd_party|node_modules|bower_components|jspm_packages|site-packages)$|^((src|tools|app|packages|web)/)?(vendor|vendored|external|externals|deps|extern|contrib)/[^/]+$"


def classified(sources: DataFrame) -> DataFrame:
    """(source_id, repo_id, path, classification, label, belief): each record's label with the greatest belief."""
    files = cut(files_with_evidence(sources))
    # every directory above a file, the root as '' at depth 0
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    dirs = files.select("repo_id", "dir").distinct().select("repo_id", F.explode(above).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    parent = F.when(F.instr("dir", "/") > 0, F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)).otherwise("")
    dirs = cut(dirs.select("repo_id", "dir", depth.alias("depth"), F.when(depth > 0, parent).alias("parent"), _directory_potentials("dir").alias("u")))
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("source_id", "repo_id", "path", "classification", F.lit("").alias("label"), F.lit(0.0).alias("belief")).limit(0)
    # up: what a directory hears from its files and subdirectories
    heard = _voices(files.select("repo_id", "dir", _message(F.col("u"), _FILE, True).alias("m")), ["repo_id", "dir"])
    inbox = dirs.join(heard, ["repo_id", "dir"], "left").select("repo_id", "dir", "depth", "parent", _plus(F.col("u"), F.col("m")).alias("b"), F.col("w").alias("fw"))
    levels: dict[int, DataFrame] = {}
    carried: DataFrame | None = None
    for d in range(deepest, -1, -1):
        level = inbox.where(F.col("depth") == d)
        if carried is not None:
            level = level.join(carried, ["repo_id", "dir"], "left").select("repo_id", "dir", "parent", "fw", _plus(F.col("b"), F.col("m")).alias("b"), F.col("w").alias("dw"))
        else:
            level = level.withColumn("dw", F.lit(None).cast("double"))
        level = cut(level.withColumn("m", _message(F.col("b"), _DIR, True)).select("repo_id", "dir", "parent", "fw", "dw", "b", "m"))
        levels[d] = level
        carried = _voices(level.select("repo_id", F.col("parent").alias("dir"), "m"), ["repo_id", "dir"])
    # down: the parent's belief without what the child said itself
    prior = _vector([F.lit(float(x)) for x in np.log([0.96, 0.01, 0.005, 0.02, 0.005])])
    beliefs = levels[0].select("repo_id", "dir", "fw", "dw", _plus(F.col("b"), prior).alias("b"))
    every = beliefs
    for d in range(1, deepest + 1):
        above_ = beliefs.select("repo_id", F.col("dir").alias("parent"), F.col("b").alias("pb"), F.col("dw").alias("pw"))
        level = levels[d].join(above_, ["repo_id", "parent"]).withColumn("rest", _plus(F.col("pb"), F.col("m"), -F.col("pw")))
        level = level.select("repo_id", "dir", "fw", "dw", "b", _message(F.col("rest"), _DIR, False).alias("down")).select("repo_id", "dir", "fw", "dw", _plus(F.col("b"), F.col("down")).alias("b"))
        beliefs = cut(level)
        every = every.unionByName(beliefs)
    rows = files.withColumn("own", _message(F.col("u"), _FILE, True)).join(every, ["repo_id", "dir"]).withColumn("rest", _plus(F.col("b"), F.col("own"), -F.col("fw")))
    rows = rows.withColumn("down", _message(F.col("rest"), _FILE, False)).select("source_id", "repo_id", "path", "classification", _plus(F.col("u"), F.col("down")).alias("x"))
    best = F.array_max("x")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("x")))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("x", best).cast("int"))
    return rows.select("source_id", "repo_id", "path", "classification", label.alias("label"), F.round(1 / total, 6).alias("belief"))


def not_handwritten(sources: DataFrame) -> DataFrame:
    """The records whose label isn't handwritten."""
    return classified(sources).where(F.col("label") != LABELS[0])
