"""Source files that do not parse: minimum-cost syntax repair by error-correcting chart parsing.

A file is lexed by the language of its extension and put into a tree of bracketed groups. Every statement, member, argument
or other part between separators is derived by the chart of ``chart.Grammar``; a bracketed group inside it is one token that
stands for everything its own parts are derivable as. So the cost of a file is the sum of the least edits of its parts and of
the brackets that are missing or in excess; zero means that it parses. Parts of one shape are parsed once per worker, which
makes the cost nearly that of lexing. Where the edits lie tells truncation (at the end), conflict (at markers) and mismatch
(nearly everywhere: a wrong extension) apart from single errors.

Defined results: null and empty contents and other extensions are no cases (cost null); contents of blanks only parse,
except as JSON; the last row of a redelivered record holds; whole texts are parsed, whatever their length; rows without
source_id are dropped; diagnostics only add a column to the report, since they are incomplete and partly outdated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chart import Grammar
from .grammars import GRAMMARS, JAVA_LEX, JAVA_WORDS, JS_CHUNK, JS_LEX, JS_REGEX, JS_WORDS, JSON_LEX, KT_LEX, KT_WORDS, PY_LEX, PY_WORDS

_NAMES = {"*": "STAR", "**": "POW", "?": "QM", "??": "NULLISH", "|": "PIPE"}
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: A worker remembers at most so many shapes of parts, and as many of groups; then it starts anew. Results don't depend on it.
SHAPES = 1 << 17


def js_word(terms: frozenset[str]) -> bool:
    """Whether a word is reserved only in some places."""
    return "ID" in terms


class Kind:
    """One way to read a group: its terminal, how its inside is divided, and the goal of each part. ``bare`` is the goal of a
    statement that no semicolon ends, ``order`` a pattern over the letters that ``PyParser.letter`` gives to the parts."""

    def __init__(self, name: str, how: str, goal: str, empty: bool = True, first: str | None = None, bare: str | None = None, order: str | None = None) -> None:
        self.name, self.how, self.goal, self.empty, self.first, self.bare = name, how, goal, empty, first, bare
        self.last = how != "args"  # whether a comma may stand behind the last part
        self.order = re.compile(order) if order else None


class Language:
    def __init__(self, grammar: Grammar, lex: re.Pattern[str], words: frozenset[str], kinds: dict[str, list[Kind]], top: str, split: str, jsx: bool = False, bare: str | None = None) -> None:
        self.grammar, self.lex, self.words, self.kinds, self.top, self.split, self.jsx = grammar, lex, words, kinds, top, split, jsx
        self.bare, self.typed = bare or top, split != "js" or "TArgs" in grammar.rules
        self.special = {w for w in grammar.terminals if re.fullmatch(r"[^\W\d]\w*", w) and w not in ("ID", "STR", "NUM", "TPL", "WORD", "JSX", "STAR", "POW", "QM", "NULLISH", "PIPE")} | words
        self.sets: list[frozenset[str]] = []
        self.ids: dict[frozenset[str], int] = {}
        self.plain = self.of("ID")
        self.string, self.number, self.template, self.illegal, self.element = self.of("STR"), self.of("NUM"), self.of("TPL"), self.of("?!"), self.of("JSX")
        self.word: dict[str, int] = {w: self.of(w, "WORD") if w in words else self.of(w, "ID") for w in self.special}
        self.op: dict[str, int] = {}
        self.ok: dict[tuple, bool] = {}
        self.group: dict[tuple, tuple[int, bool]] = {}
        o, w = self.ops, self.words_of
        self.semi, self.comma = o(";")[0], o(",")[0]
        self.enders = {self.plain, self.string, self.number, self.template, self.element, *w("this super true false null None True False break continue return"), *o("++ -- !!")} | {i for x, i in self.word.items() if x not in words}
        glue = {"js": "in of instanceof as satisfies extends implements else catch finally from", "kt": "else catch finally as in is by where until", "java": ""}.get(split, "")
        starts = o(". ?. ?: && || , ; : = => -> ? ?? | & * / % < > <= >= == != === !== += -= *= /= ** .. ..< :: ) as") if split == "js" else o(". ?. ?: && || , ; : = -> :: < > <= >= == != * / % .. ..<")
        self.glue = set(w(glue)) | set(starts) | ({*o("+ -")} if split == "js" else set())
        self.after_block = set(w("else catch finally while")) if split == "java" else self.glue
        o("= / * **")
        self.dots = set(o(". ?."))
        self.named = set(w("class function")) if split == "js" else set()
        self.clauses = {self.word[c]: set(w(of)) for c, of in (("else", "if"), ("catch", "try catch"), ("finally", "try catch")) if c in self.word} if split in ("js", "java") else {}
        self.contextual = {i for i in w("of as from satisfies implements in instanceof") if js_word(self.sets[i])} if split == "js" else set()
        self.member = {*o("* @"), *w("catch finally")} if split == "js" else set()
        self.heads = set(w("if for while else do"))
        self.angles = tuple(o("< >"))
        self.arrow, self.otherwise, self.loop = o("->")[0], self.word.get("else", -1), self.word.get("while", -1)

    def of(self, *terms: str) -> int:
        s = frozenset(terms)
        i = self.ids.get(s)
        if i is None:
            i = self.ids[s] = len(self.sets)
            self.sets.append(s)
        return i

    def ops(self, text: str) -> list[int]:
        return [self.op.setdefault(x, self.of(_NAMES.get(x, x))) for x in text.split()]

    def words_of(self, text: str) -> list[int]:
        return [self.word[x] for x in text.split() if x in self.word]

    def accepts(self, part: tuple[int, ...], goal: str, begins: bool = False) -> bool:
        key = (goal, part, begins)
        got = self.ok.get(key)
        if got is None:
            if len(self.ok) >= SHAPES:
                self.ok.clear()
            got = self.ok[key] = self.grammar.accepts([self.sets[i] for i in part], goal, begins)
        return got

    def repair(self, part: tuple[int, ...], goal: str, exact: bool = True) -> int:
        return max(1, self.grammar.cost([self.sets[i] for i in part], goal, exact)) if part else 1


class Group:
    __slots__ = ("open", "at", "items", "breaks", "places")

    def __init__(self, open_: str, at: int) -> None:
        self.open, self.at = open_, at
        self.items: list[int] = []
        self.breaks: list[bool] = []
        self.places: list[int] = []

    def add(self, item: int, fresh: bool, at: int) -> None:
        self.items.append(item)
        self.breaks.append(fresh)
        self.places.append(at)


class Parser:
    """Parses one text; ``edits`` gets (offset, cost, what)."""

    def __init__(self, lang: Language, exact: bool = True) -> None:
        self.lang, self.exact = lang, exact
        self.edits: list[tuple[int, int, str]] = []
        self.parts = self.wrong = 0
        self.blocks = {i for i in range(len(lang.sets)) if any(t[0] == "{" for t in lang.sets[i])}

    # dividing -----------------------------------------------------------------------------------------------------------
    def commas(self, g: Group) -> list[tuple[int, tuple[int, ...]]]:
        out, start, comma = [], 0, self.lang.comma
        for k, x in enumerate(g.items):
            if x == comma:
                out.append((start, tuple(g.items[start:k])))
                start = k + 1
        out.append((start, tuple(g.items[start:])))
        lt, gt = self.lang.angles
        if not self.lang.typed or len(out) < 2 or lt not in g.items or gt not in g.items:
            return out
        joined: list[tuple[int, tuple[int, ...]]] = []  # a comma inside < > doesn't divide
        k = 0
        while k < len(out):
            s, p = out[k]
            j, depth = k, p.count(lt) - p.count(gt)
            while depth > 0 and j + 1 < len(out):
                j += 1
                depth += out[j][1].count(lt) - out[j][1].count(gt)
            if depth == 0 and j > k:
                p, k = tuple(g.items[s : out[j][0] + len(out[j][1])]), j
            joined.append((s, p))
            k += 1
        return joined

    def statements(self, g: Group) -> list[tuple[int, tuple[int, ...]]]:
        lang, out = self.lang, []
        items, breaks, semi = g.items, g.breaks, lang.semi
        java, js = lang.split == "java", lang.split == "js"
        start, n, sets = 0, len(items), lang.sets
        for k in range(n):
            x = items[k]
            if k > start:
                p = items[k - 1]
                closed = next(iter(sets[p]))[0]
                ended = False
                if closed == "{" and not (p in lang.heads):
                    ended = x not in lang.after_block and (java or breaks[k] or js) and self._starts(x, breaks[k])
                    if js and (x == lang.loop or not ended):
                        ended = self._after_block(items, start, k)
                arm = x == lang.otherwise and k + 1 < n and items[k + 1] == lang.arrow  # 'else ->' begins an arm of its own
                if not ended and js and breaks[k] and (x in lang.contextual or p not in lang.enders and closed not in "({"):
                    ended = self._inserted(items, start, k)
                elif not ended and js and breaks[k] and next(iter(sets[x]))[0] == "[":
                    ended = self._inserted(items, start, k)
                elif not ended and not java and breaks[k] and not (x == lang.loop and closed == "{" and lang.accepts(tuple(items[start:k]), "DoHead")) and (x not in lang.glue or arm) and (p in lang.enders or closed in "([" or closed == "{" or js and k - start > 1 and items[k - 2] in lang.dots):
                    first = next(iter(sets[x]))
                    ended = (first[0] not in "([{" or (first[0] == "{" and closed == "{") or (not js and first[0] == "[")) and not (self._opened(items, start, k) if js else self._header(items, start, k))
                if ended:
                    out.append((start, tuple(items[start:k])))
                    start = k
            if x == semi:
                out.append((start, tuple(items[start:k])))
                start = k + 1
        if start < n:
            out.append((start, tuple(items[start:])))
        return [(s, p) for s, p in out if p]

    def _starts(self, x: int, fresh: bool) -> bool:
        """Whether a new statement may start after a closed block on the same line."""
        t = next(iter(self.lang.sets[x]))
        if fresh:
            return x not in self.lang.glue and t[0] not in "(["
        if self.lang.split == "js":
            return bool(self.lang.sets[x] & {"WORD"}) and x not in self.lang.glue
        return t[0] not in "([" and x not in self.lang.glue and (self.lang.split == "java" and t not in (",", ";", ".", "::", "QM", ":", "+", "-", "STAR", "/", "==", "!=", "&&", "||", "=", ")", "PIPE", "&", "<", ">"))

    def _after_block(self, items: list[int], start: int, k: int) -> bool:
        """Whether the block items[k - 1] ends the statement or member that began at start, so that items[k] begins another."""
        lang, x = self.lang, items[k]
        part = tuple(items[start:k])
        opens = next(iter(lang.sets[x]))[0]
        if opens == "[" or x in lang.member:
            return lang.accepts(part, "MemberB") or opens == "[" and lang.accepts(part, "Closed") and not (k - start > 1 and items[start + 1] == lang.op.get(":"))
        if x in lang.glue and x not in lang.contextual and x != lang.loop or opens == "{":
            return False
        return not (opens == "(" and k - start > 1 and items[start + 1] == lang.op.get(":")) and lang.accepts(part, "Closed")

    def _inserted(self, items: list[int], start: int, k: int) -> bool:
        """Whether a line break before items[k] stands for a semicolon: what is before is whole, and can't go on with items[k]."""
        lang = self.lang
        part = tuple(items[start:k])
        if lang.typed and part[-1] == lang.angles[1] and items[k] not in lang.glue and lang.accepts(part, "Typed"):
            return True  # a type's end; as a comparison it would go on
        return lang.accepts(part, "Whole") and not lang.accepts((*part, items[k]), "Whole", True)

    def _opened(self, items: list[int], start: int, k: int) -> bool:
        """Whether items[start:k] ends with the head of a control statement, or is only decorators."""
        lang, last = self.lang, items[k - 1]
        if last in lang.heads:
            return True
        if next(iter(lang.sets[last]))[0] == "(" and k - start > 1:
            before = items[k - 2]
            if k - start > 2 and items[k - 3] in lang.dots:
                return False
            if before == lang.loop:
                return not lang.accepts(tuple(items[start:k]), "DoWhile")
            if before in lang.heads or before == lang.word.get("await") and k - start > 2 and items[k - 3] in lang.heads:
                return True
        return items[start] == lang.op.get("@") and lang.accepts(tuple(items[start:k]), "Decos")

    def _header(self, items: list[int], start: int, k: int) -> bool:
        """Whether items[start:k] is only the head of a control statement."""
        i = start
        while i < k and items[i] in self.lang.heads:
            i += 1
            if i < k and next(iter(self.lang.sets[items[i]]))[0] == "(":
                i += 1
        return i == k

    # groups -------------------------------------------------------------------------------------------------------------
    def token(self, g: Group) -> int:
        """The token that a closed group is for what surrounds it."""
        lang = self.lang
        if g.open != "{" or len(g.items) < 12:
            key = (g.open, tuple(g.items), tuple(g.breaks) if g.open == "{" else ())
            got = lang.group.get(key)
            if got is not None and got[1]:
                self.parts += 1
                return got[0]
            tok, good = self._token(g)
            if len(lang.group) >= SHAPES:
                lang.group.clear()
            lang.group[key] = (tok, good)
            return tok
        return self._token(g)[0]

    def _token(self, g: Group) -> tuple[int, bool]:
        lang, kinds = self.lang, self.lang.kinds.get(g.open, [])
        cache: dict[str, list] = {}
        names = []
        for k in kinds:
            if not g.items:
                if k.empty:
                    names.append(k.name)
                continue
            parts = self._parts(g, k, cache)
            if parts and all(p and lang.accepts(p, goal) for _, p, goal in parts) and not self._stray(parts) and (k.order is None or k.order.fullmatch("".join(map(self.letter, parts)))):
                names.append(k.name)
        self.parts += 1
        if not g.items:
            names.append(g.open + _CLOSER[g.open])
        if names:
            return lang.of(*names), True
        # nothing fits: repair it as the kind with the fewest wrong parts, and let what surrounds it pass
        best, tried = None, [k for k in kinds if self._parts(g, k, cache)]
        for k in tried:
            parts = self._parts(g, k, cache)
            bad = [(s, p, goal) for s, p, goal in parts if not lang.accepts(p, goal)] or self._stray(parts)
            if best is None or len(bad) < len(best):
                best = bad
        if not best:
            self.edit(g.at, 1, "group")
        for s, p, goal in best or []:
            self.wrong += 1
            self.edit(g.places[min(s, len(g.places) - 1)], lang.repair(p, goal, self.exact), "part")
        return lang.of(*[k.name for k in kinds]), False

    def _parts(self, g: Group, k: Kind, cache: dict[str, list]) -> list[tuple[int, tuple[int, ...], str]]:
        """(offset in items, part, goal) of a non-empty group read as k; empty if it can't be read so."""
        lang, how = self.lang, k.how
        if how == "whole":
            return [(0, tuple(g.items), k.goal)]
        if how == "comp":
            return [(0, tuple(g.items), k.goal)] if lang.word["for"] in g.items else []
        if how in ("commas", "holes", "args"):
            if lang.semi in g.items and lang.semi != lang.comma:
                return []
            if how not in cache:
                parts = self.commas(g)
                if not parts[-1][1] and k.last and len(parts) > 1:
                    parts.pop()
                cache[how] = parts
            parts = cache[how]
            if how == "holes":
                return [(s, p, k.goal) for s, p in parts if p] or [(0, (lang.comma,), k.goal)]
            if g.open == "{" and lang.split == "js" and not self._fields(parts):
                return []
            return [(s, p, k.goal) for s, p in parts]
        if "stmts" not in cache:
            cache["stmts"] = self.statements(g)
        parts = cache["stmts"]
        if how == "enum":  # constants between commas, then members after the first semicolon
            cut = g.items.index(lang.semi) if lang.semi in g.items else len(g.items)
            head = Group("{", g.at)
            head.items = g.items[:cut]
            consts = self.commas(head)
            if not consts[-1][1]:
                consts.pop()
            return [(s, p, k.goal) for s, p in consts] + [(s, p, "Member" if self._ended(g, s, p) else "MemberB") for s, p in parts if s > cut]
        if how == "fields":  # statements or commas
            out, (lt, gt) = [], lang.angles
            for s, p in parts:
                start = depth = 0
                for i in range(len(p) + 1):
                    if i == len(p) or p[i] == lang.comma and not depth:
                        if i > start:
                            out.append((s + start, p[start:i], k.goal))
                        start = i + 1
                    elif p[i] in (lt, gt):
                        depth = max(0, depth + (1 if p[i] == lt else -1))
            return out
        if how == "loose":  # members, or enum constants between commas
            out = []
            for s, p in parts:
                if lang.accepts(p, "Member"):
                    out.append((s, p, "Member"))
                    continue
                start = 0
                for i in range(len(p) + 1):
                    if i == len(p) or p[i] == lang.comma:
                        if i > start:
                            out.append((s + start, p[start:i], k.goal))
                        start = i + 1
            return out
        if k.first and parts:
            return [(parts[0][0], parts[0][1], k.first)] + [(s, p, k.goal) for s, p in parts[1:]]
        if k.bare:
            return [(s, p, k.goal if self._ended(g, s, p) else k.bare) for s, p in parts]
        return [(s, p, k.goal) for s, p in parts]

    def _stray(self, parts: list[tuple[int, tuple[int, ...], str]]) -> list[tuple[int, tuple[int, ...], str]]:
        """Clauses without the statement that they belong to, and statements that lack a name."""
        lang, out = self.lang, []
        before: set[int] | tuple[int, ...] = ()
        for s, p, goal in parts:
            need = lang.clauses.get(p[0]) if p and goal[:4] in ("Stmt", "Case") else None
            if need and need.isdisjoint(before):
                out.append((s, p, goal))
            elif p and p[0] in lang.named and goal[:4] == "Stmt" and (len(p) < 2 or not lang.sets[p[1]] & {"ID", "STAR"}):
                out.append((s, p, goal))  # a declaration without a name
            before = {*before, *p} if need else p
        return out

    def _ended(self, g: Group, start: int, part: tuple[int, ...]) -> bool:
        """Whether a semicolon ends the part."""
        end = start + len(part)
        return end < len(g.items) and g.items[end] == self.lang.semi

    def letter(self, part: tuple[int, tuple[int, ...], str]) -> str:
        return "x"

    def _fields(self, parts: list) -> bool:
        """Whether parts between commas look like fields of an object at all; keeps long blocks out of the chart."""
        sets = self.lang.sets
        for _, p in parts:
            if len(p) > 1:
                a, b = sets[p[0]], sets[p[1]]
                if not (b & {":", "=", "(p)", "(a)", "as", "<"} or a & {"...", "STAR", "get", "set", "async", "type"} or any(t[0] == "(" for t in b)):
                    return False
        return True

    # lexing -------------------------------------------------------------------------------------------------------------
    def edit(self, at: int, cost: int, what: str) -> None:
        self.edits.append((at, cost, what))

    def close(self, stack: list[Group]) -> None:
        g = stack.pop()
        stack[-1].add(self.token(g), False, g.at)

    def run(self, text: str) -> None:
        start = 0
        if text[:2] == "#!" and self.lang.split in ("js", "kt"):
            start = text.find("\n")
            if start < 0:
                return
        self.scan(text, start, False)

    def scan(self, text: str, start: int, inner: bool) -> int | None:
        """Reads text from start; if inner, up to the brace that closes an embedded expression, which gives the end behind it."""
        lang = self.lang
        js = lang.split == "js"
        root = Group("[" if inner else "{", start)
        stack = [root]
        fresh = False
        n = len(text)
        word, op, plain = lang.word, lang.op, lang.plain
        freshes = [False]  # whether a line break came before the open bracket
        tokens = lang.lex.finditer(text, start)
        while (m := next(tokens, None)) is not None:
            kind = m.lastgroup
            if kind == "ws":
                continue
            if kind == "nl":
                fresh = True
                continue
            if kind == "comment":
                if "\n" in m[0]:
                    fresh = True
                continue
            g = stack[-1]
            if kind == "id":
                g.items.append(word.get(m[0], plain))  # Group.add, for the most frequent token
                g.breaks.append(fresh)
                g.places.append(m.start())
            elif kind == "op":
                x, at, item = m[0], m.start(), -1
                if js and x in ("/", "/=", "`", "<"):
                    end: int | None = None
                    if x == "`":
                        end, item = self.template(text, at), lang.template
                        if end is None:
                            self.edit(at, 1, "end")
                            end = n
                    elif x != "<":
                        if not self._operand(g) and (r := JS_REGEX.match(text, at)):
                            end, item = r.end(), lang.string
                    elif lang.jsx and self._element_starts(g, text, at):
                        end, item = self.jsx(text, at), lang.element
                        if end is None:
                            self.edit(at, 1, "element")
                    if end is not None:
                        tokens = lang.lex.finditer(text, end)
                if item >= 0:
                    g.add(item, fresh, at)
                else:
                    i = op.get(x)
                    g.items.append(i if i is not None else op.setdefault(x, lang.of(_NAMES.get(x, x))))
                    g.breaks.append(fresh)
                    g.places.append(at)
            elif kind == "open":
                stack.append(Group(m[0], m.start()))
                freshes.append(fresh)
            elif kind == "close":
                x = m[0]
                if len(stack) > 1 and _CLOSER[stack[-1].open] == x:
                    pass
                elif any(_CLOSER[s.open] == x for s in stack[1:]):
                    while _CLOSER[stack[-1].open] != x:
                        self.edit(m.start(), 1, "unclosed")
                        inside = stack.pop()
                        before = freshes.pop()
                        stack[-1].add(self.token(inside), before, inside.at)
                elif inner and x == "}":
                    while len(stack) > 1:
                        self.edit(m.start(), 1, "unclosed")
                        inside = stack.pop()
                        stack[-1].add(self.token(inside), freshes.pop(), inside.at)
                    self.token(root)
                    return m.end()
                else:
                    self.edit(m.start(), 1, "excess")
                    fresh = False
                    continue
                inside = stack.pop()
                before = freshes.pop()
                stack[-1].add(self.token(inside), before, inside.at)
            elif kind == "str":
                g.add(lang.template if js and m[0][0] == "`" else lang.string, fresh, m.start())
            elif kind == "num":
                g.add(lang.number, fresh, m.start())
            elif kind == "conflict":
                self.edit(m.start(), 1, "conflict")
                fresh = True
                continue
            else:
                self.edit(m.start(), 1, "illegal")
                continue
            fresh = False
        if inner:
            return None
        while len(stack) > 1:
            self.edit(n, 1, "end")
            inside = stack.pop()
            before = freshes.pop()
            stack[-1].add(self.token(inside), before, inside.at)
        parts = [(0, tuple(root.items))] if lang.split == "whole" else self.statements(root)
        if lang.split == "whole" and not root.items:
            self.edit(0, 1, "part")
            return None
        for s, p, _ in self._stray([(s, p, lang.top) for s, p in parts]):
            self.edit(root.places[s], 1, "part")
        for s, p in parts:
            self.parts += 1
            goal = lang.top if self._ended(root, s, p) else lang.bare
            if not lang.accepts(p, goal):
                self.wrong += 1
                self.edit(root.places[s], lang.repair(p, goal, self.exact), "end" if s + len(p) == len(root.items) and lang.grammar.begins([lang.sets[i] for i in p], goal) else "part")
        return None

    # elements, templates and regular expressions in code --------------------------------------------------------------------
    def _operand(self, g: Group) -> bool:
        """Whether what was read last in the group ends an operand, so that '/' divides."""
        if not g.items:
            return False
        last = self.lang.sets[g.items[-1]]
        if last & {"ID", "STR", "NUM", "TPL", "this", "super", "null", "true", "false", "JSX", "++", "--"}:
            return not last & {"of", "await", "yield"}
        first = next(iter(last))[0]
        return first == "[" or first == "(" and not (len(g.items) > 1 and self.lang.sets[g.items[-2]] & {"if", "while", "for", "with"}) or first == "{" and not (g.open == "{" and g.items[-1] in self.blocks)

    def template(self, text: str, at: int) -> int | None:
        """The end of the template that starts at text[at]; its fields are checked as expressions. None if the text runs out."""
        pos = at + 1
        while True:
            pos = JS_CHUNK.match(text, pos).end()
            if text.startswith("`", pos):
                return pos + 1
            if not text.startswith("${", pos):
                return None
            end = self.scan(text, pos + 2, True)
            if end is None:
                return None
            if not text[pos + 2 : end - 1].strip():
                self.edit(pos, 1, "part")
            pos = end

    _GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s|=)|<\s*[A-Za-z_$][\w$]*\s*>\s*\(")

    def _element_starts(self, g: Group, text: str, at: int) -> bool:
        if not re.match(r"[A-Za-z_$>]", text[at + 1 : at + 2]) or self._GENERIC.match(text, at) and "=>" in text[at : text.find("\n", text.find(")", at))]:
            return False
        if not g.items:
            return True
        last = self.lang.sets[g.items[-1]]
        return not (last & {"ID", "STR", "NUM", "TPL", "this", "super", "JSX", "function", "class", "new"} or next(iter(last))[0] in "([{")

    _TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?\s*")
    _SPACE = re.compile(r"(?:\s|/\*(?s:.*?)\*/|//[^\n]*)*")
    _ATTR = re.compile(r"""([A-Za-z_$][\w$:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|(?=[{<])))?|(?=\{)""")
    _TEXT = re.compile(r"[^{<>}]+")

    def jsx(self, text: str, at: int) -> int | None:
        """The end of the element that starts at text[at] == '<', or None."""
        m = self._TAG.match(text, at + 1)
        name, pos, n = m[1], m.end(), len(text)
        if name is not None and text.startswith("<", pos):  # type arguments
            depth = 0
            while pos < n:
                depth += {"<": 1, ">": -1}.get(text[pos], 0) - (text[pos - 1 : pos + 1] == "=>") * -1
                pos += 1
                if not depth:
                    break
        while name is not None:
            pos = self._SPACE.match(text, pos).end()
            if text.startswith("/>", pos):
                return pos + 2
            if text.startswith(">", pos):
                break
            m = self._ATTR.match(text, pos)
            if not m:
                return None
            pos = m.end()
            end: int | None = pos
            if m[1] is None or m[2] == "":
                end = self.scan(text, pos + 1, True) if text[pos] == "{" else self.jsx(text, pos)
            if end is None:
                return None
            pos = end
        pos += 1 if name is not None or text[pos : pos + 1] == ">" else 0
        while pos < n:
            c = text[pos]
            if c == "{":
                end = self.scan(text, pos + 1, True)
            elif c == "<":
                if text.startswith("</", pos):
                    m = self._TAG.match(text, pos + 2)
                    return m.end() + 1 if m[1] == name and text[m.end() : m.end() + 1] == ">" else None
                end = self.jsx(text, pos)
            elif c in ">}":
                return None
            else:
                end = self._TEXT.match(text, pos).end()
            if end is None:
                return None
            pos = end
        return None


class PyParser(Parser):
    """Lines with indentation instead of statements in braces."""

    _RESYNC = frozenset("def class return raise import try while pass del assert".split())

    def commas(self, g: Group) -> list[tuple[int, tuple[int, ...]]]:
        """Parts between commas; those between lambda and its colon don't divide."""
        lang, out, start, lambdas = self.lang, [], 0, 0
        comma, colon, head = lang.comma, lang.op[":"], lang.word["lambda"]
        for k, x in enumerate(g.items):
            if x == head:
                lambdas += 1
            elif x == colon and lambdas:
                lambdas -= 1
            elif x == comma and not lambdas:
                out.append((start, tuple(g.items[start:k])))
                start = k + 1
        out.append((start, tuple(g.items[start:])))
        return out

    def letter(self, part: tuple[int, tuple[int, ...], str]) -> str:
        """What a parameter or argument is, for its order: *, ** (k), / or with (d) or without (n) a default or keyword."""
        lang, p = self.lang, part[1]
        if p[0] == lang.op["*"]:
            return "s" if len(p) > 1 else "*"
        if p[0] == lang.op["**"]:
            return "k"
        if p[0] == lang.op["/"] and len(p) == 1:
            return "/"
        return "d" if lang.op["="] in (p[1:2] if part[2] == "Arg" else p) else "n"

    def run(self, text: str) -> None:
        lang = self.lang
        root = Group("{", 0)
        stack: list[Group] = [root]
        levels, expect = [0], False
        line_start = 0
        indent: int | None = None
        compound: dict[int, str] = {}

        def end_line(last: bool = False) -> None:
            nonlocal root, stack, expect, indent
            if root.items:
                p = tuple(root.items)
                at = root.places[0]
                if expect:
                    if indent > levels[-1]:
                        levels.append(indent)
                    else:
                        self.edit(at, 1, "indent")
                elif indent > levels[-1]:
                    self.edit(at, 1, "indent")
                    levels.append(indent)
                if indent < levels[-1]:
                    while levels and indent < levels[-1]:
                        levels.pop()
                    if not levels or levels[-1] != indent:
                        self.edit(at, 1, "dedent")
                        levels.append(indent)
                first = lang.sets[p[0]]
                self.parts += 1
                if not lang.accepts(p, "Line"):
                    self.wrong += 1
                    self.edit(at, lang.repair(p, "Line", self.exact), "end" if last and lang.grammar.begins([lang.sets[i] for i in p], "Line") else "part")
                    expect = bool(first & {"def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with"}) and p[-1] == lang.op[":"]
                else:
                    expect = lang.accepts(p, "Head") and p[-1] == lang.op[":"] and lang.accepts(p[:-1], "Head1")
                gone = [k for k in compound if k > indent]
                if any(compound[k] in ("try", "@") for k in gone) or compound.get(indent) == "try" and not first & {"except", "finally"} or compound.get(indent) == "@" and not first & {"def", "class", "async", "@"}:
                    self.edit(at, 1, "clause")
                word = next((w for w in ("elif", "else", "except", "finally") if w in first), None)
                if word and compound.get(indent) not in ({"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "async"), "except": ("try", "except"), "finally": ("try", "except", "else")}[word]):
                    self.edit(at, 1, "clause")
                for k in gone:
                    del compound[k]
                compound[indent] = next((w for w in ("@", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "async") if w in first), "")
            root = Group("{", 0)
            stack = [root]
            indent = None

        for m in lang.lex.finditer(text):
            kind = m.lastgroup
            if kind == "nl":
                line_start = m.end()
                if len(stack) == 1:
                    end_line(not text[m.end() :].strip())
                continue
            if kind in ("ws", "comment"):
                continue
            if kind == "conflict":
                self.edit(m.start(), 1, "conflict")
                continue
            if indent is None:
                lead = text[line_start : m.start()]
                indent = len(lead.expandtabs(8)) if lead.isspace() or not lead else len(lead)
            g = stack[-1]
            if kind == "id":
                if len(stack) > 1 and m[0] in self._RESYNC and not text[line_start : m.start()].strip():
                    while len(stack) > 1:
                        self.edit(m.start(), 1, "unclosed")
                        inner = stack.pop()
                        stack[-1].add(self.token(inner), False, inner.at)
                    end_line()
                    indent, g = m.start() - line_start, stack[-1]
                g.add(lang.word.get(m[0], lang.plain), False, m.start())
            elif kind == "op":
                i = lang.op.get(m[0])
                g.add(i if i is not None else lang.ops(m[0])[0], False, m.start())
            elif kind == "open":
                stack.append(Group(m[0], m.start()))
            elif kind == "close":
                if len(stack) > 1 and _CLOSER[stack[-1].open] == m[0]:
                    self.close(stack)
                elif any(_CLOSER[s.open] == m[0] for s in stack[1:]):
                    while _CLOSER[stack[-1].open] != m[0]:
                        self.edit(m.start(), 1, "unclosed")
                        self.close(stack)
                    self.close(stack)
                else:
                    self.edit(m.start(), 1, "excess")
            elif kind == "str":
                g.add(lang.string, False, m.start())
            elif kind == "num":
                g.add(lang.number, False, m.start())
            else:
                self.edit(m.start(), 1, "illegal")
        while len(stack) > 1:
            self.edit(len(text), 1, "end")
            self.close(stack)
        end_line(True)
        if expect or any(w in ("try", "@") for w in compound.values()):
            self.edit(len(text), 1, "end")


_YAML = Grammar("""
Line: Dash* Entry? | Dash* MARK
Dash: DASH
Entry: Key : | Key : Val | Val | QM Val | QM Key : Val?
Key: PROP* STR | PROP* FLOW | ALIAS | <<
Val: PROP* STR | PROP* FLOW | PROP* BLOCK | PROP | PROP PROP | ALIAS
""")
_YAML_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s#:]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:(?=\S)))*")
_YAML_FLOW_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s#:,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|\s+(?=[^\s#:,\[\]{}]|:(?=[^\s,\[\]{}])))*")
_YAML_DQ, _YAML_SQ = re.compile(r'"(?:[^"\\]|\\(?s:.))*"'), re.compile(r"'(?:[^']|'')*'")
_YAML_PROP, _YAML_ALIAS = re.compile(r"[&!][^\s,\[\]{}]*"), re.compile(r"\*[^\s,\[\]{}]+")
_YAML_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\r?$", re.M)


class YamlParser:
    """Block structure by indentation; each line's entry is derived by the chart, flow collections are one token."""

    def __init__(self) -> None:
        self.edits: list[tuple[int, int, str]] = []
        self.parts = self.wrong = 0

    def edit(self, at: int, cost: int, what: str) -> None:
        self.edits.append((at, cost, what))

    def flow(self, text: str, at: int) -> int | None:
        """The end of the flow collection at text[at], or None."""
        close = "]" if text[at] == "[" else "}"
        pos, n, item, colon = at + 1, len(text), False, False
        while pos < n:
            c = text[pos]
            if c in " \t\r\n":
                pos += 1
            elif c == "#" and text[pos - 1] in " \t\n":
                pos = text.find("\n", pos) if "\n" in text[pos:] else n
            elif c == close:
                return pos + 1
            elif c == ",":
                if not item and not colon:
                    return None
                item, colon, pos = False, False, pos + 1
            elif c == ":" and (text[pos + 1 : pos + 2] in (" ", "\t", "\n", "\r", ",", "]", "}", "") or item and text[pos - 1] in "\"'"):
                if colon:
                    return None
                colon, item, pos = True, False, pos + 1
            elif item:
                return None
            else:
                end = self.scalar(text, pos, True)
                if end is None:
                    return None
                item, pos = True, end
        return None

    def scalar(self, text: str, at: int, flow: bool = False) -> int | None:
        c = text[at]
        if c in "[{":
            return self.flow(text, at)
        rule = _YAML_DQ if c == '"' else _YAML_SQ if c == "'" else _YAML_PROP if c in "&!" else _YAML_ALIAS if c == "*" else _YAML_FLOW_PLAIN if flow else _YAML_PLAIN
        m = rule.match(text, at)
        if flow and c in "&!" and m:
            pos = m.end()
            while text[pos : pos + 1] in (" ", "\t"):
                pos += 1
            return self.scalar(text, pos, True) if pos < len(text) and text[pos] not in ",]}\n" else pos
        return m.end() if m else None

    def run(self, text: str) -> None:
        pos, n = 0, len(text)
        levels: list[tuple[int, str]] = []  # indentation and whether it holds a mapping or a sequence
        open_value, plain_value, block_indent = True, False, None
        while pos < n:
            eol = text.find("\n", pos)
            eol = n if eol < 0 else eol
            line = text[pos:eol].rstrip("\r")
            body = line.lstrip(" ")
            indent = len(line) - len(body)
            if block_indent is not None:
                if not body.strip() or indent > block_indent:
                    pos = eol + 1
                    continue
                block_indent = None
            if not body.strip() or body[0] == "#" or body[0] == "\t" and not body.strip():
                pos = eol + 1
                continue
            if re.match(r"(?:<{7}|={7}|>{7}|\|{7})(?: |$)", line):
                self.edit(pos, 1, "conflict")
                pos, open_value = eol + 1, True
                continue
            if indent == 0 and re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                levels, open_value, plain_value = [], True, False
                rest = line[3:].strip()
                pos = eol + 1 if not rest or rest[0] == "#" else pos + 4
                continue
            if indent == 0 and body[0] == "%":
                pos = eol + 1
                continue
            if plain_value and (not levels or indent > levels[-1][0]) and not re.search(r":(?:\s|$)| #", body):
                pos = eol + 1  # a plain scalar goes on, whatever its line begins with
                continue
            if body[0] == "\t":
                self.edit(pos, 1, "indent")
            tokens, at, end = [], pos + indent, eol
            column, dashes, key_column = indent, [], None
            last = None
            ok = True
            while at < end:
                c = text[at]
                if c in " \t\r":
                    at += 1
                    continue
                if c == "#" and text[at - 1 : at] in (" ", "\t", "\n", ""):
                    break
                if c in "-?" and text[at + 1 : at + 2] in (" ", "\t", "\n", "\r", "") and not any(t != frozenset({"DASH"}) for t in tokens):
                    if c == "-":
                        dashes.append(at - pos)
                    tokens.append(frozenset({"DASH" if c == "-" else "QM"}))
                    at += 1
                    continue
                if c == ":" and (text[at + 1 : at + 2] in (" ", "\t", "\n", "\r", "")):
                    tokens.append(frozenset({":"}))
                    at += 1
                    continue
                if c in "|>" and (m := _YAML_BLOCK.match(text, at)):
                    tokens.append(frozenset({"BLOCK"}))
                    at, last = m.end(), "BLOCK"
                    continue
                stop = self.scalar(text, at)
                if stop is None:
                    ok = False
                    break
                kind = "FLOW" if c in "[{" else "PROP" if c in "&!" else "ALIAS" if c == "*" else "STR"
                if kind != "PROP" and key_column is None:
                    key_column = at - pos
                tokens.append(frozenset({kind}))
                last = "PLAIN" if kind == "STR" and c not in "\"'" else kind
                if stop > end:  # the scalar spans lines
                    nl = text.find("\n", stop)
                    end = eol = n if nl < 0 else nl
                at = stop
            self.parts += 1
            has_key = frozenset({":"}) in tokens
            continues = plain_value and not has_key and not dashes and ok and (not levels or indent > levels[-1][0]) and tokens == [frozenset({"STR"})]
            if not ok:
                self.wrong += 1
                self.edit(at, 1, "part")
                open_value, plain_value, pos = True, False, eol + 1
                continue
            if continues:
                pos = eol + 1
                continue
            if not _YAML.accepts(tokens, "Line"):
                self.wrong += 1
                self.edit(pos + indent, max(1, _YAML.cost(tokens, "Line")), "part")
            entries = [(d, "seq") for d in dashes] + ([(key_column if key_column is not None else indent, "map")] if has_key else [])
            if not entries:
                if not open_value and levels or (levels and indent <= levels[-1][0]):
                    self.edit(pos + indent, 1, "part")
                elif not levels:
                    levels.append((indent, "scalar"))
            rooted = bool(levels)
            for col, kind in entries:
                while levels and (levels[-1][0] > col or levels[-1][0] == col and levels[-1][1] == "seq" and kind == "map"):
                    levels.pop()
                    open_value = False
                if levels and levels[-1][0] == col and levels[-1][1] == kind:
                    pass
                elif not levels and not rooted or levels and col > levels[-1][0] and open_value or levels and levels[-1][0] == col and kind == "seq" and levels[-1][1] == "map" and open_value:
                    levels.append((col, kind))
                else:
                    self.edit(pos + col, 1, "indent")
                    levels.append((col, kind))
                open_value = True
            if tokens:
                open_value = tokens[-1] in (frozenset({":"}), frozenset({"DASH"}), frozenset({"PROP"}), frozenset({"QM"}))
            plain_value = last == "PLAIN" and tokens[-1] == frozenset({"STR"})
            if tokens and tokens[-1] == frozenset({"BLOCK"}):
                block_indent = entries[-1][0] if entries and has_key else (dashes[-1] if dashes else -1)
            pos = eol + 1


def _js_kinds(ts: bool) -> dict[str, list[Kind]]:
    more = ts
    return {
        "(": [Kind("(e)", "whole", "ForExpr", False), Kind("(a)", "commas", "Elem"), Kind("(p)", "commas", "Param"), Kind("(for)", "whole", "ForHead", False), *([Kind("(ty)", "whole", "Type", False)] if more else [])],
        "[": [Kind("[a]", "holes", "Elem"), Kind("[e]", "whole", "ForExpr", False), *([Kind("[ty]", "commas", "TElem", False), Kind("[ix]", "whole", "Index", False), Kind("[mp]", "whole", "Mapped", False)] if more else [])],
        "{": [Kind("{b}", "stmts", "StmtS", bare="StmtP"), Kind("{o}", "commas", "Prop"), Kind("{c}", "stmts", "Member"), Kind("{sw}", "stmts", "CaseS", bare="Case"), Kind("{im}", "commas", "Import1"), *([Kind("{t}", "fields", "TMember"), Kind("{en}", "commas", "Enum1")] if more else [])],
    }


_JAVA_KINDS = {
    "(": [Kind("(e)", "whole", "Expr", False), Kind("(a)", "args", "Elem"), Kind("(jp)", "args", "JParam"), Kind("(an)", "args", "AnnoArg"), Kind("(jfor)", "whole", "ForHead", False), Kind("(cp)", "whole", "CatchParam", False), Kind("(cast)", "whole", "TParam", False), Kind("(cast)", "whole", "Type", False), Kind("(lp)", "args", "LParam"), Kind("(res)", "stmts", "Res", False), Kind("(pat)", "args", "Pattern")],
    "[": [Kind("[e]", "whole", "Expr", False)],
    "{": [Kind("{b}", "stmts", "StmtS", bare="StmtC"), Kind("{c}", "stmts", "Member", bare="MemberB"), Kind("{sw}", "stmts", "Case", bare="CaseB"), Kind("{jen}", "enum", "EnumConst"), Kind("{ai}", "commas", "AInit")],
}
_KT_KINDS = {
    "(": [Kind("(e)", "whole", "Expr", False), Kind("(a)", "commas", "Elem"), Kind("(kp)", "commas", "KParam"), Kind("(kfor)", "whole", "ForHead", False), Kind("(wh)", "whole", "WhenSubj", False), Kind("(dp)", "commas", "DParam", False), Kind("(ty)", "commas", "KType")],
    "[": [Kind("[a]", "commas", "Elem")],
    "{": [Kind("{b}", "stmts", "Stmt"), Kind("{l}", "stmts", "Stmt", True, "Lambda"), Kind("{c}", "loose", "EnumPart"), Kind("{w}", "stmts", "WhenArm")],
}
# The order of arguments and of parameters (fixed by the language), over the letters of PyParser.letter.
_ARGS = r"[ns]*[ds]*[dk]*"
_PARAMS = r"(?:n+/n*d*|n*d+/d*|n*d*)(?:s[nd]*|\*[nd]+)?k?"
_PY_KINDS = {
    "(": [Kind("(e)", "whole", "Paren", False), Kind("(t)", "commas", "Star"), Kind("(a)", "commas", "Arg", order=_ARGS), Kind("(a)", "comp", "Comp1", False), Kind("(p)", "commas", "Param", order=_PARAMS), Kind("(im)", "commas", "Import1", False), Kind("(wi)", "commas", "With", False), Kind("(pt)", "commas", "PatArg")],
    "[": [Kind("[l]", "commas", "Star"), Kind("[l]", "comp", "Comp1", False), Kind("[a]", "commas", "Sub", False), Kind("[tp]", "commas", "TypeParam", False), Kind("[pt]", "commas", "Pat", False)],
    "{": [Kind("{d}", "commas", "Pair"), Kind("{d}", "commas", "Star", False), Kind("{d}", "comp", "DictComp", False), Kind("{mp}", "commas", "PatPair", False)],
}
_JSON_KINDS = {"[": [Kind("[a]", "args", "Value")], "{": [Kind("{o}", "args", "Prop")], "(": []}

_BY_EXTENSION = {".java": "java", ".kt": "kt", ".ts": "ts", ".tsx": "tsx", ".js": "js", ".jsx": "jsx", ".py": "py", ".json": "json", ".yml": "yaml", ".yaml": "yaml"}
_LANGUAGES: dict[str, Language] = {}


def _language(name: str) -> Language:
    got = _LANGUAGES.get(name)
    if got is None:
        if name in ("js", "jsx", "ts", "tsx"):
            ts = name.startswith("ts")
            got = Language(GRAMMARS["ts" if ts else "js"], JS_LEX, JS_WORDS, _js_kinds(ts), "StmtS", "js", name.endswith("x"), "StmtP")
        elif name == "java":
            got = Language(GRAMMARS["java"], JAVA_LEX, JAVA_WORDS, _JAVA_KINDS, "Top", "java", bare="TopB")
        elif name == "kt":
            got = Language(GRAMMARS["kt"], KT_LEX, KT_WORDS, _KT_KINDS, "Top", "kt")
        elif name == "py":
            got = Language(GRAMMARS["py"], PY_LEX, PY_WORDS, _PY_KINDS, "Line", "py")
        else:
            got = Language(GRAMMARS["json"], JSON_LEX, frozenset(("true", "false", "null")), _JSON_KINDS, "Value", "whole")
        _LANGUAGES[name] = got
    return got


def language_of(path: str | None) -> str | None:
    """The language that a path's extension names."""
    dot = (path or "").rfind(".")
    return _BY_EXTENSION.get(path[dot:].lower()) if dot >= 0 else None


def check(language: str, text: str, exact: bool = True) -> tuple[int, str | None, int, int]:
    """(edit cost, kind of damage, first line of an edit, edits); cost 0 if the text parses. If not exact, a part that needs
    several edits counts as two, which is enough to know that the cost isn't zero."""
    text = text[1:] if text[:1] == "﻿" else text
    if language == "yaml":
        p = YamlParser()
    else:
        lang = _language(language)
        p = (PyParser if language == "py" else Parser)(lang, exact)
    p.run(text)
    if not p.edits:
        return 0, None, 0, 0
    cost = sum(c for _, c, _ in p.edits)
    first = min(a for a, _, _ in p.edits)
    if any(w == "conflict" for _, _, w in p.edits):
        damage = "conflict"
    elif p.wrong > 3 and p.wrong * 4 > p.parts:
        damage = "mismatch"
    elif any(w == "end" for _, _, w in p.edits):
        damage = "truncation"
    else:
        damage = "error"
    return cost, damage, text.count("\n", 0, first) + 1, len(p.edits)


def _check_frames(exact: bool):
    def frames_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [check(lang, text, exact) for lang, text in zip(f["syntax"], f["content"], strict=True)]
            out = f[["source_id", "repo_id", "generation_id", "path", "syntax", "ingested_at"]].copy()
            for i, c in enumerate(("cost", "damage", "first_line", "edits")):
                out[c] = [r[i] for r in rows]
            yield out

    return frames_of


def checked(sources: DataFrame, exact: bool = True) -> DataFrame:
    """(source_id, repo_id, generation_id, path, syntax, cost, damage, first_line, edits): one row per record with text in a checked language."""
    ext = F.lower(F.regexp_extract("path", r"\.[^./\\]*$", 0))
    syntax = F.create_map(*[F.lit(x) for kv in _BY_EXTENSION.items() for x in kv])[ext]
    rows = sources.where("source_id is not null and length(content) > 0").select("source_id", "repo_id", "generation_id", "path", syntax.alias("syntax"), "content", "ingested_at").where("syntax is not null")
    rows = rows.mapInPandas(_check_frames(exact), "source_id string, repo_id string, generation_id string, path string, syntax string, ingested_at timestamp_ntz, cost int, damage string, first_line int, edits int")
    last = rows.groupBy("source_id").agg(F.max(F.struct("ingested_at", "cost", "repo_id", "generation_id", "path", "syntax", "damage", "first_line", "edits")).alias("v"))
    return last.select("source_id", *[f"v.{c}" for c in ("repo_id", "generation_id", "path", "syntax", "cost", "damage", "first_line", "edits")])


def unparsable(sources: DataFrame) -> DataFrame:
    """The checked records with a nonzero edit cost."""
    return checked(sources, exact=False).where("cost > 0")


def rates(sources: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(repo_id, syntax, files, unparsable, truncation, conflict, mismatch, hinted, rate) per repository and language."""
    hints = diagnostics.where("path <> '' and generation_id is not null").select("generation_id", "path").distinct().withColumn("hint", F.lit(True))
    rows = checked(sources, exact=False).join(hints, ["generation_id", "path"], "left")
    bad = F.col("cost") > 0
    kinds = [F.count(F.when(F.col("damage") == k, 1)).alias(k) for k in ("truncation", "conflict", "mismatch")]
    out = rows.groupBy("repo_id", "syntax").agg(F.count("*").alias("files"), F.count(F.when(bad, 1)).alias("unparsable"), *kinds, F.count(F.when(bad & F.col("hint"), 1)).alias("hinted"))
    return out.withColumn("rate", F.round(F.col("unparsable") / F.col("files"), 6))
