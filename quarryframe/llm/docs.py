"""Functions paired with the documentation written for them.

Symbols of one file are gathered (bounded by the file) and joined to its content; there the comment directly above the
declaration or its annotations, or the docstring that opens the body, is read, its tags are parsed, and what is left after
taking away everything that says nothing decides whether it is documentation. Class headers and override or inherit tags are
kept on the way: for pairs, methods without text of their own take that of the method they override, by joins over the class
hierarchy that are repeated until nothing changes; what stays empty is dropped.

Defined results: symbols without a file, of files without content, or beyond the last line have none; repeated symbols (also
by another extractor) are one; of several rows of a file the last one with content holds; null names or lines are dropped;
comments are read whole; extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+")
# What tools read, in comments (fixed values of the tools).
_DIRECTIVE = re.compile(
    r"^(?:noqa\b|type:\s*ignore|pylint:|pragma:|fmt:\s*(?:on|off|skip)|isort:|mypy:|pyright:|ruff:|flake8:|yapf:|nosec\b|coverage:|eslint[-\w]*|prettier-ignore|tslint:|jshint|jslint|jscs:|istanbul |c8 |v8 ignore|stylelint-|biome-ignore|deno-|"
    r"@ts-\w+|@flow|@format|@jsx|@eslint|webpack\w+:|nosonar\b|nolint|noinspection\b|checkstyle:|cspell:|spell-?checker:|sonar-|spotless:|ktlint-|detekt:|@formatter:|formatter:|suppress ?warnings|codacy|lint[:-]|#?region\b|#?endregion\b|language=|-\*-|vim?:|!/)", re.I)  # fmt: skip
_PLACEHOLDER = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|tba|tbc|hack)\b[\s:.,;()\-]*(?:\(?\s*(?:add|write|insert|fill|in|out|missing|docs?|documentation|document|description|describe|comment|javadoc|kdoc|docstring|me|this|it|here|later|revisit|soon)\b[\s:.,;()]*)*"
    r"|n\s*/\s*a|none|null|empty|description|documentation|docs?|comment|javadoc|docstring|summary|placeholder|lorem ipsum.*|(?:no|missing|add|insert|write|needs?|without|lacks)\s+(?:an?\s+)?(?:docs?|documentation|description|comment|summary)(?:\s+(?:here|yet|available|provided|needed|missing|follows))*"
    r"|(?:please\s+)?document\s+(?:me|this|here)|undocumented|not documented(?: yet)?|(?:beschreibung|dokumentation|doku)\s+(?:folgt|fehlt)|kommt noch|(?:falta|sin)\s+(?:documentar|documentación|descripción)|por documentar|pendiente|à (?:documenter|compléter|faire)|(?:pas de|sans) (?:description|documentation)|documentation à venir)[\s.!:…]*$", re.I)  # fmt: skip
_INHERIT = re.compile(r"(?i:\{?@inherit_?doc\b[^}\s]*\}?|\{?@override\b\}?)|(?i:\binherit(?:ed)? (?:doc|documentation|javadoc)s?(?: from [\w.#]+)?|^\(?see (?:base|super|parent)\w*\)?|^(?:overrides?|overridden from|inherited from|same as|see) (?:base|super|parent)\w*\.?$)")
_TAG = re.compile(r"^(?:@(\w+)|:(\w+)((?:\s+[^:\n]*)?):)\s*(.*)$", re.S)
_REFS = frozenset("see link override inheritdoc inherit author since version deprecated_by copydoc implements extends augments overrides suppress hide internal".split())
_NAMED = frozenset("param arg argument parameter key keyword kwarg throws exception raises raise except property prop template tparam typeparam receiver field type rtype cvar ivar var yields".split())
_SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|keyword args)\s*:?\s*$", re.I)
_SMALL = frozenset("a an the this that it its of for to in on by with from and or as is are be method function class constructor helper der die das den dem ein eine le la les un une el los las una de del des du".split())
_CODE_LINE = re.compile(
    r"^(?:[\w$.\[\]]+(?:\s*:\s*[\w<>\[\], ]+)?\s*[-+*/|&]?=(?!=)\s*\S.*[;)\]\w]|(?:await\s+|new\s+)?[\w$]+(?:(?:\.|\?\.|::|->)[\w$]+)+\s*\(.*\)?[;{]?|[\w$]+\([^()]*[\d\"',=][^()]*\);?|(?:return|throw|raise|yield|assert|del|import|from|break|continue|pass)\b(?:\s+[\w$.(){}\[\]\"',\d+*/-]+)*;?|[\w$.]+;\s*|.*[()=\[\]{}<>+*\"'|&].*;\s*|(?:var|let|const|val|final|int|long|double|float|boolean|bool|char|byte|short|void|string|String|auto|[A-Z]\w*)\s+[\w$]+;\s*|[{}()\[\];,\s]+|.*[{]\s*|[})\]]+[;,)]*(?:\s*(?:else|catch|finally)\b.*)?"
    r"|(?:if|for|while|switch|elif|with|else|try|except)\b.*[:{)]\s*|(?:async\s+)?(?:def|class)\s+\w+.*:\s*|(?:(?:public|private|protected|internal|static|final|export|async|suspend|override|abstract|default)\s+)*(?:function|fun|def|class|interface|const|let|var|val)\s+[\w$]+\s*[(<=:{].*|@\w+\(.*\))$")  # fmt: skip
_PROSE_END = re.compile(r"[.!?…]\s*$")


def _stem(w: str) -> str:
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ers", ""), ("er", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith(("ss", "eed")) and re.search("[aeiouy]", w[: len(w) - len(end)]):
            w = w[: len(w) - len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w[:-1] + "i" if len(w) > 2 and w.endswith("y") else w.rstrip("e") if len(w) > 3 else w


def _words(text: str) -> list[str]:
    return [c.lower() for w in _WORD.findall(text) for c in _CAMEL.findall(w)]


def strip_markers(lines: list[str]) -> list[str]:
    """The text of comment lines without the signs that make them comments."""
    out = []
    for x in lines:
        x = x.strip()
        x = re.sub(r"^(?:/\*+!?|//+!?|#+!?|\*+(?!/))", "", x)
        x = re.sub(r"\*+/$", "", x).strip()
        out.append(x.lstrip("*/").strip() if not re.match(r"/\w", x) else x)
    return out


def said(lines: list[str], name: str) -> str:
    """What documentation lines say beyond tags without description, references, directives, placeholders, ornaments, code that
    was commented out and the words of the name; empty if nothing is left."""
    own = {_stem(w) for w in _words(name)}
    if name[:1].isupper():  # a component is named after what it shows
        own |= {_stem(w) for w in ("render", "show", "display", "component", "view")}
    parts: list[str] = []
    code, prose = 0, 0
    kept: list[str] = []
    for line in lines:
        line = line.strip()
        if not any(c.isalnum() for c in line) or _DIRECTIVE.match(line) or _SECTION.match(line):
            continue
        if _CODE_LINE.match(line) and not (_PROSE_END.search(line) and len(line.split()) > 3 and not line.endswith(("...", ";"))) and not _TAG.match(line):
            code += 1
            continue
        prose += 1
        kept.append(line)
    # a line of prose-like words inside commented-out code isn't prose
    tag: list[str] = []
    for line in kept:
        line = _INHERIT.sub(" ", line).strip()
        m = _TAG.match(line)
        if m:
            word = (m[1] or m[2] or "").lower()
            rest = m[4] or ""
            if m[1] and word in _NAMED:
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?\[?[\w$.*`]+(?:=[^\]\s]*)?\]?\s*(?:-\s*)?", "", rest)
            elif m[1]:
                rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
            if word in _REFS:
                rest = ""
            line = rest
        line = re.sub(r"\{@\w+\s+[^}]*\}", " ", line).strip()
        # sentence by sentence: a placeholder behind a sentence is one too
        for s in re.split(r"(?<=[.!?])\s+", line):
            if any(c.isalnum() for c in s) and not _PLACEHOLDER.match(s.strip("-–—*#=~ \t")):
                tag.append(s)
    for s in tag:
        left = [w for w in _words(s) if w not in _SMALL and _stem(w) not in own]
        if left:
            parts.append(s)
    return " ".join(parts)


def _comment_above(lines: list[str], at: int, python: bool) -> list[str] | None:
    """The comment whose last line is lines[at], or None."""
    if at < 0:
        return None
    s = lines[at].strip()
    if not python and s.endswith("*/"):
        top = at
        while top >= 0:
            t = lines[top].strip()
            if "/*" in t:
                return lines[top : at + 1] if t.startswith("/*") else None
            top -= 1
        return None
    mark = "#" if python else "//"
    if not s.startswith(mark):
        return None
    top = at
    while top > 0 and lines[top - 1].strip().startswith(mark):
        top -= 1
    return lines[top : at + 1]


def _annotation_top(lines: list[str], at: int) -> int:
    """The first line of the annotation that ends on lines[at], or at + 1 if none does."""
    s = lines[at].strip() if at >= 0 else ""
    if s.startswith("@") and not s.startswith("@interface"):
        return at
    if s.endswith(")") and s.count(")") > s.count("("):
        depth, top = 0, at
        while top >= 0:
            t = lines[top]
            depth += t.count(")") - t.count("(")
            if t.strip().startswith("@"):
                return top if depth <= 0 else at + 1
            if depth <= 0 or not t.strip():
                break
            top -= 1
    return at + 1


_DOCSTRING = re.compile(r"""\s*(?:#[^\n]*\n\s*)*[rRuU]?(\"\"\"|'''|"|')""")


def _head_end(text: str, at: int) -> int:
    """The place after the colon that ends the head of the Python function that starts at text[at]."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            j = text.find("\n", i)
            i = n if j < 0 else j
            continue
        elif c in "\"'":
            q = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            j = text.find(q, i + len(q))
            i = n if j < 0 else j + len(q)
            continue
        elif c == ":" and not depth:
            return i + 1
        elif c == "\n" and not depth:
            return -1
        i += 1
    return -1


def _declaration(lines: list[str], at: int, end_line: int, name: str, python: bool) -> int:
    """The line that declares the symbol whose span begins at lines[at], which may be at what is written before the keyword. It is looked
    for in the whole span, or in 40 lines of code if the span is shorter; comments and annotations of any length don't count."""
    named = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])")
    stop, inside, depth = max(end_line, at + 40), False, 0
    for k in range(at, len(lines)):
        if k >= stop:
            break
        s = lines[k].strip()
        if inside or (not python and s.startswith("/*")):
            inside = "*/" not in (s if inside else s[2:])
            stop += 1
        elif not s or s.startswith(("//", "*", "#")):
            stop += 1
        elif s.startswith("@") or depth > 0:
            depth += s.count("(") - s.count(")")
            stop += 1
            if not s.startswith("@") and named.search(s):
                return k
        elif named.search(s):
            return k
    return at


def documentation(lines: list[str], text: str, starts: list[int], start_line: int, name: str, python: bool, end_line: int = 0) -> list[str]:
    """The documentation lines of the function whose symbol begins at start_line, markers taken off; empty if there is none."""
    at = start_line - 1
    if not 0 <= at < len(lines):
        return []
    decl = _declaration(lines, at, end_line, name, python)
    found: list[str] = []
    k = decl - 1
    while k >= -1:
        comment = _comment_above(lines, k, python)
        if comment is not None:
            found = strip_markers(comment)
            break
        top = _annotation_top(lines, k) if k >= 0 else k + 1
        if top > k:
            break
        k = top - 1
    if python:
        d = re.compile(r"\b(?:def|class)\b").search(text, starts[decl])
        end = _head_end(text, d.start()) if d and d.start() < starts[decl] + len(lines[decl]) else -1
        m = _DOCSTRING.match(text, end) if end > 0 else None
        if m:
            close = text.find(m[1], m.end())
            if close > 0:
                found = found + [x.strip() for x in text[m.end() : close].split("\n")]
    return found


def _code(lines: list[str], start: int, end: int, python: bool) -> str:
    """The function's lines; a span over only its head is carried on to the end of the body."""
    i = start - 1
    if end > start:
        return "\n".join(lines[i:end])
    if python:
        k = i
        while k < len(lines) and not lines[k].rstrip().endswith(":"):
            k += 1
        indent = len(lines[i]) - len(lines[i].lstrip())
        k += 1
        while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
            k += 1
        return "\n".join(lines[i:k]).rstrip()
    depth, seen = 0, False
    for k in range(i, len(lines)):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*", "", lines[k])
        depth += bare.count("{") - bare.count("}")
        seen = seen or "{" in bare
        if seen and depth <= 0:
            return "\n".join(lines[i : k + 1])
    return "\n".join(lines[i:])


_CLASS = re.compile(r"^(\s*)(?:[\w@()]+\s+)*?(?:class|interface|object)\s+(\w+)([^{\n]*)")


_PY_HEAD = re.compile(r"\s*\((.*)\)\s*:\s*(?:#.*)?$")
_HEAD_GOES_ON = re.compile(r"\s*(?:extends\b|implements\b|:\s*[A-Z]|,)")


def _classes(lines: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """(line, indentation, name, parents) of the classes of a file, from their heads."""
    out = []
    for i, x in enumerate(lines):
        m = _CLASS.match(x)
        if m:
            head, k = m[3], i + 1
            # a head may go on in the next lines
            while k < len(lines) and "{" not in lines[k - 1] and (head.count("(") > head.count(")") or head.rstrip().endswith(",") or _HEAD_GOES_ON.match(lines[k])):
                head += " " + lines[k].partition("{")[0].strip()
                k += 1
            py = _PY_HEAD.match(head)
            if py:
                bases = [x.strip() for x in re.sub(r"\[[^\[\]]*\]", "", py[1]).split(",")]
                names = [x.rsplit(".", 1)[-1] for x in bases if re.fullmatch(r"[A-Za-z_][\w.]*", x)]
            else:
                tail = re.sub(r"<[^<>]*>|\([^()]*\)(?=\s*(?::|extends|implements|\{|$))", "", head)
                p = re.search(r"(?:extends|implements|:)\s*(.*)$|^\(([^)]*)\)", tail if "(" not in head or ":" in tail or "extends" in tail else head)
                names = re.findall(r"[A-Z]\w*", (p[1] or p[2] or "")) if p else []
            out.append((i, len(m[1].expandtabs(4)), m[2], names))
    return out


_CODE_PATH = r"(?i)\.(?:java|kts?|pyi?|[cm]?[jt]s|[jt]sx)$"


def _overrides(path: str, name: str, head: str) -> bool:
    """Whether a method with this head can override one of a parent: not a constructor, and in Java and Kotlin neither private nor static."""
    if path.lower().endswith((".py", ".pyi")):
        return not (name.startswith("__") and not name.endswith("__"))
    if name == "constructor" or name.startswith("#") or re.search(r"\bprivate\b", head):
        return False
    return not (path.lower().endswith((".java", ".kt", ".kts")) and re.search(r"\bstatic\b", head))


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each parent in each class head of a file, whatever symbols the file has."""
    for f in frames:
        keys = zip(f["generation_id"], f["path"], f["version"], f["content"], strict=True)
        rows = [(gen, path, version, name, above) for gen, path, version, content in keys for _, _, name, parents in _classes(content.split("\n")) for above in parents]
        yield pd.DataFrame(rows, columns=["generation_id", "path", "version", "class_name", "above"])


_ROWS = "generation_id string, repo_id string, path string, name string, start_line int, kind string, class_name string, parents array<string>, doc string, inherits boolean, code string"


def _pair(with_code: bool):
    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for gen, repo, path, content, symbols in zip(f["generation_id"], f["repo_id"], f["path"], f["content"], f["symbols"], strict=True):
                lines = [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]
                text = "\n".join(lines)
                starts, n = [], 0
                for x in lines:
                    starts.append(n)
                    n += len(x) + 1
                python = path.lower().endswith((".py", ".pyi"))
                classes = _classes(lines)
                for s in symbols:
                    own = documentation(lines, text, starts, s["start_line"], s["name"], python, s["end_line"] or 0)
                    doc = said(own, s["name"])
                    name, parents, code = None, [], None
                    at = s["start_line"] - 1
                    if not 0 <= at < len(lines):
                        continue
                    indent = len(lines[at].expandtabs(4)) - len(lines[at].expandtabs(4).lstrip())
                    inside = [c for c in classes if c[0] < at and c[1] < indent]
                    if inside:
                        name, parents = inside[-1][2], inside[-1][3]
                    head = lines[_declaration(lines, at, s["end_line"] or 0, s["name"], python)]
                    inherits = bool(parents) and _overrides(path, s["name"], head) or any(_INHERIT.search(x) for x in own) or any("@Override" in x for x in lines[max(0, at - 3) : at + 3]) or " override " in f" {lines[at]} "
                    if with_code:
                        code = _code(lines, s["start_line"], s["end_line"], python)
                        doc = doc and "\n".join(own).strip()
                    elif doc:
                        doc = "."
                    if doc or inherits and name:
                        rows.append((gen, repo, path, s["name"], s["start_line"], s["kind"], name, parents, doc or None, inherits, code))
            yield pd.DataFrame(rows, columns=["generation_id", "repo_id", "path", "name", "start_line", "kind", "class_name", "parents", "doc", "inherits", "code"])

    return pair


def _last(sources: DataFrame) -> DataFrame:
    """(generation_id, path, repo_id, version): which text of a file is its last; texts aren't moved for it."""
    last = sources.where("length(content) > 0").groupBy("generation_id", "path").agg(F.max(F.struct("ingested_at", F.xxhash64("content").alias("version"), "repo_id")).alias("v"))
    return last.select("generation_id", "path", "v.repo_id", "v.version")


def _read(sources: DataFrame, symbols: DataFrame, with_code: bool) -> tuple[DataFrame, DataFrame]:
    """The functions of the last texts, and (generation_id, repo_id, class_name, above) of their class heads; a text is read once for both."""
    wanted = symbols.where("kind in ('function', 'method') and name is not null and start_line is not null").select("generation_id", "path", "name", "start_line", "end_line", "kind")
    # the symbols of one file: bounded by its lines
    one = F.struct("name", "start_line", "kind", "end_line")
    wanted = wanted.groupBy("generation_id", "path", "name", "start_line", "kind").agg(F.max("end_line").alias("end_line"))
    wanted = wanted.groupBy("generation_id", "path").agg(F.collect_list(one).alias("symbols"))
    last = _last(sources)
    texts = sources.where("length(content) > 0").select("generation_id", "path", "content", F.xxhash64("content").alias("version"))
    rows = texts.join(last.join(wanted, ["generation_id", "path"]), ["generation_id", "path", "version"]).select("generation_id", "repo_id", "path", "content", "symbols")
    heads = texts.where(F.col("path").rlike(_CODE_PATH)).mapInPandas(_heads, "generation_id string, path string, version long, class_name string, above string")
    heads = heads.join(last, ["generation_id", "path", "version"]).select("generation_id", "repo_id", "class_name", "above").distinct()
    return rows.mapInPandas(_pair(with_code), _ROWS), heads


def documented(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(generation_id, path, name, start_line) of the functions and methods with documentation of their own: the pairs that aren't inherited."""
    return pairs(sources, symbols, with_code=False).where("not inherited").select("generation_id", "path", "name", "start_line").distinct()


def pairs(sources: DataFrame, symbols: DataFrame, with_code: bool = True) -> DataFrame:
    """(generation_id, repo_id, path, name, start_line, kind, class_name, doc, inherited, code): code with its description; a method
    without one takes that of the method it overrides in the nearest class above that has one. Classes need no symbols to be links;
    of classes of one name those of the same generation come first, then the least text. Repeated rows of a file give one."""
    read, heads = _read(sources, symbols, with_code)
    rows = cut(read.distinct())
    keep = ["generation_id", "repo_id", "path", "name", "start_line", "kind", "class_name", "doc", "inherited", "code"]
    have = rows.where("doc is not null").withColumn("inherited", F.lit(False))
    # a method and the class above it, one row per parent named in the class head
    open_ = rows.where("doc is null and inherits and class_name is not null").withColumn("parent", F.explode("parents")).select("generation_id", "repo_id", "path", "name", "start_line", "kind", "class_name", "code", "parent")
    texts = have.where("class_name is not null").groupBy("repo_id", F.col("class_name").alias("parent"), "name", F.col("generation_id").alias("of")).agg(F.min("doc").alias("doc"))
    out = have.select(*keep)
    if not open_.isEmpty():
        heads = cut(heads.select("repo_id", "class_name", "above").distinct())
    seen = open_.select("repo_id", "class_name", "name", "parent").distinct()
    while not open_.isEmpty():
        met = open_.join(texts, ["repo_id", "parent", "name"], "left")
        nearest = F.min(F.struct((F.col("of") != F.col("generation_id")).alias("far"), "doc"))
        found = cut(met.where("doc is not null").groupBy("generation_id", "repo_id", "path", "name", "start_line", "kind", "class_name").agg(nearest.getField("doc").alias("doc"), F.min("code").alias("code")))
        out = out.unionByName(found.withColumn("inherited", F.lit(True)).select(*keep))
        left = met.where("doc is null").drop("doc", "of").join(found.select("generation_id", "path", "name", "start_line"), ["generation_id", "path", "name", "start_line"], "left_anti")
        up = left.join(heads.select("repo_id", F.col("class_name").alias("parent"), "above"), ["repo_id", "parent"]).drop("parent").withColumnRenamed("above", "parent")
        # a cycle of class heads leads nowhere new
        open_ = cut(up.join(seen, ["repo_id", "class_name", "name", "parent"], "left_anti"))
        seen = cut(seen.unionByName(open_.select("repo_id", "class_name", "name", "parent")).distinct())
    return out
