"""Chart parsing with minimum edit cost over small context-free grammars.

A grammar is text: one rule a line, ``Name: alternative | alternative``; ``x?`` is optional, ``x*`` repeats. Names that have no
rule are terminals. A token is the set of terminals that it can stand for. ``Grammar.cost`` gives the least number of token
insertions, deletions and replacements that make a sequence derivable: first an ordinary Earley chart (cost zero), if that
fails the same chart with costs under a budget of one edit, and for several edits a table of all spans, filled by length.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np

#: A worker remembers the costs of at most so many parts; then it starts anew.
REPAIRS = 1 << 15


class Grammar:
    def __init__(self, text: str) -> None:
        raw: dict[str, list[list[str]]] = {}
        name = ""
        for line in text.strip().splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            if line.startswith("| "):
                body = line[2:]
            else:
                name, _, body = line.partition(": ")
            raw.setdefault(name, []).extend(alt.split() for alt in body.split(" | "))
        rules: dict[str, set[tuple[str, ...]]] = {}
        for lhs, alts in raw.items():
            for alt in alts:
                options: list[list[tuple[str, ...]]] = []
                for s in alt:
                    if len(s) > 1 and s[-1] == "?":
                        options.append([(), (s[:-1],)])
                    elif len(s) > 1 and s[-1] == "*":
                        many = s[:-1] + "*"
                        rules.setdefault(many, set()).update({(s[:-1],), (many, s[:-1])})
                        options.append([(), (many,)])
                    else:
                        options.append([(s,)])
                for pick in product(*options):
                    rhs = tuple(x for part in pick for x in part)
                    if rhs and rhs != (lhs,):
                        rules.setdefault(lhs, set()).add(rhs)
        self.rules = {k: sorted(v) for k, v in rules.items()}
        self.terminals = {s for alts in self.rules.values() for rhs in alts for s in rhs} - set(self.rules)
        # the rules of a name are one automaton: a state is the set of what may still come, and equal sets are one state
        self.lhs: list[str] = []
        self.ends: list[bool] = []
        self.names: list[list[tuple[str, int]]] = []  # by state: names that may come, and the state behind them
        self.terms: list[list[tuple[frozenset[str], int]]] = []
        self.start = {k: self._state(k, frozenset(alts), {}) for k, alts in self.rules.items()}
        self.behind = [dict(x) for x in self.names]
        self._memo: dict[tuple, int] = {}
        self._tables: dict[str, _Table] = {}
        first: dict[str, set[str]] = {k: set() for k in self.rules}
        changed = True
        while changed:
            changed = False
            for k, alts in self.rules.items():
                for rhs in alts:
                    new = first[rhs[0]] if rhs[0] in first else {rhs[0]}
                    if not new <= first[k]:
                        first[k] |= new
                        changed = True
        self.first = {k: frozenset(v) for k, v in first.items()}
        # as many as there are kinds of tokens, which are few, and states
        self._steps: dict[frozenset[str], dict[int, tuple[list[tuple[str, int]], list[int]]]] = {}

    def _state(self, name: str, rest: frozenset[tuple[str, ...]], known: dict[frozenset[tuple[str, ...]], int]) -> int:
        q = known.get(rest)
        if q is None:
            q = known[rest] = len(self.lhs)
            self.lhs.append(name)
            self.ends.append(() in rest)
            self.names.append([])
            self.terms.append([])
            by: dict[str, set[tuple[str, ...]]] = {}
            for r in rest:
                if r:
                    by.setdefault(r[0], set()).add(r[1:])
            terms: dict[int, set[str]] = {}
            for s, x in sorted(by.items()):
                t = self._state(name, frozenset(x), known)
                if s in self.rules:
                    self.names[q].append((s, t))
                else:
                    terms.setdefault(t, set()).add(s)
            self.terms[q] = [(frozenset(x), t) for t, x in terms.items()]
        return q

    def _step(self, q: int, token: frozenset[str]) -> tuple[list[tuple[str, int]], list[int]]:
        """The names of a state that can begin with the token, and the states behind its terminals that the token can be."""
        return [(s, t) for s, t in self.names[q] if self.first[s] & token], [t for s, t in self.terms[q] if s & token]

    def begins(self, tokens: Sequence[frozenset[str]], goal: str) -> bool:
        """Whether tokens could follow so that all derive from the goal."""
        return self.accepts(tokens, goal, True)

    def accepts(self, tokens: Sequence[frozenset[str]], goal: str, part: bool = False) -> bool:
        """Whether the tokens derive from the goal, without any edit; if part, whether they begin something that does."""
        lhs, ends, start = self.lhs, self.ends, self.start
        waiting: list[dict[str, list[tuple[int, int]]]] = []
        n = len(tokens)
        items = {(start[goal], 0)} if n else set()
        for i in range(n + 1):
            wait: dict[str, list[tuple[int, int]]] = {}
            waiting.append(wait)
            seen, todo, moved = items, list(items), set()
            asked = {goal} if not i else set()
            done: set[tuple[str, int]] = set()
            token = tokens[i] if i < n else frozenset()
            steps = self._steps.setdefault(token, {})
            while todo:
                item = todo.pop()
                q, origin = item
                if ends[q] and (key := (lhs[q], origin)) not in done:
                    done.add(key)
                    for new in waiting[origin].get(key[0], ()):
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
                step = steps.get(q)
                if step is None:
                    step = steps[q] = self._step(q, token)
                for s, t in step[0]:
                    if s in wait:
                        wait[s].append((t, origin))
                    else:
                        wait[s] = [(t, origin)]
                    if s not in asked:
                        asked.add(s)
                        new = (start[s], i)
                        seen.add(new)
                        todo.append(new)
                for t in step[1]:
                    moved.add((t, origin))
            if i == n:
                return part or (goal, 0) in done
            if not moved:
                return False
            items = moved
        return False

    def cost(self, tokens: Sequence[frozenset[str]], goal: str, exact: bool = True) -> int:
        """The least number of edits; zero if the tokens derive from the goal as they are. If not exact, two stands for two or more."""
        key = (goal, exact, *tokens)
        got = self._memo.get(key)
        if got is None:
            got = 0 if self.accepts(tokens, goal) else self._within(tokens, goal, 1) or (self._least(tokens, goal) if exact else 2)
            if len(self._memo) >= REPAIRS:
                self._memo.clear()
            self._memo[key] = got
        return got

    def _least(self, tokens: Sequence[frozenset[str]], goal: str) -> int:
        """The least number of edits, whatever it is and however long the part."""
        table = self._tables.get(goal)
        if table is None:
            table = self._tables[goal] = _Table(self.rules, goal)
        return table.cost(tokens)

    def _within(self, tokens: Sequence[frozenset[str]], goal: str, budget: int) -> int | None:
        """The least number of edits if it is within the budget. Items hold the edits inside them; an item is dropped as soon as
        the edits before it and inside it exceed the budget."""
        lhs, ended, n = self.lhs, self.ends, len(tokens)
        items: list[dict[tuple[int, int], int]] = [{} for _ in range(n + 2)]
        before: list[dict[str, int]] = [{} for _ in range(n + 2)]  # edits before a rule predicted here
        waiting: list[dict[str, set[tuple[int, int]]]] = [{} for _ in range(n + 2)]
        empty: dict[str, int] = {}
        work: list[tuple[int, int]] = []

        def relax(at: int, item: tuple[int, int], c: int, force: bool = False) -> None:
            old = items[at].get(item)
            if (old is None or c < old or force) and before[item[1]][lhs[item[0]]] + c <= budget:
                items[at][item] = c if old is None or c < old else old
                if at == here:
                    work.append(item)

        here = 0
        before[0][goal] = 0
        relax(0, (self.start[goal], 0), 0)
        for here in range(n + 1):
            token = tokens[here] if here < n else frozenset()
            work = list(items[here])
            empty = {}
            while work:
                item = work.pop()
                q, origin = item
                c, name = items[here][item], lhs[q]
                if ended[q]:
                    if name == goal and origin == 0 and here < n:
                        relax(here + 1, item, c + 1)  # delete what follows
                    if origin == here:
                        empty[name] = min(c, empty.get(name, c))
                    for wq, wo in tuple(waiting[origin].get(name, ())):
                        relax(here, (self.behind[wq][name], wo), items[origin][(wq, wo)] + c)
                for s, t in self.names[q]:
                    waiting[here].setdefault(s, set()).add(item)
                    prefix = before[origin][name] + c
                    old = before[here].get(s)
                    if old is None or prefix < old:
                        before[here][s] = prefix
                        if prefix < budget or self.first[s] & token:
                            relax(here, (self.start[s], here), 0, True)
                    if s in empty:
                        relax(here, (t, origin), c + empty[s])
                for of, t in self.terms[q]:
                    relax(here, (t, origin), c + 1)  # insert
                    if here < n:
                        relax(here + 1, (t, origin), c + of.isdisjoint(token))  # take or replace
                if self.terms[q] and here < n:
                    relax(here + 1, item, c + 1)  # delete
        ends = [c for (q, origin), c in items[n].items() if ended[q] and lhs[q] == goal and origin == 0]
        return min(ends) if ends and min(ends) <= budget else None


class _Table:
    """Least edits of every span, for the rules that a goal needs.

    The rules are one automaton: a state is the set of what may still come, equal sets are one state, and a name is the state of
    its alternatives. E[q, i, j], the least edits that make tokens i to j what may come in q, is the least of: token i deleted;
    token i taken or replaced as a terminal; a name over i to k and the rest over k to j, for k between; and what another state
    costs over the same span, plus all that is inserted around it (``closure``). Spans are filled by length, all of one
    length at once. Only the states that a split reads are kept for all lengths.
    """

    #: More than any cost of a part of half as many tokens; a sum of three still fits 16 bits.
    FAR = 10000

    def __init__(self, rules: dict[str, list[tuple[str, ...]]], goal: str) -> None:
        ids: dict[frozenset[tuple[str, ...]], int] = {}
        ends: list[bool] = []
        moves: list[dict[str, int]] = []
        self.names: dict[str, int] = {}

        def state(rest: frozenset[tuple[str, ...]]) -> int:
            q = ids.get(rest)
            if q is None:
                q = ids[rest] = len(ends)
                ends.append(() in rest)
                moves.append({})
                by: dict[str, set[tuple[str, ...]]] = {}
                for r in rest:
                    if r:
                        by.setdefault(r[0], set()).add(r[1:])
                moves[q] = {s: state(frozenset(x)) for s, x in sorted(by.items())}
            return q

        todo = [goal]
        while todo:
            name = todo.pop()
            if name not in self.names:
                first = len(moves)
                self.names[name] = state(frozenset(rules[name]))
                todo += [s for m in moves[first:] for s in m if s in rules]
        self.goal, count, far = self.names[goal], len(ends), self.FAR
        size = np.full(count, far, np.int32)  # edits when nothing is there: all is inserted
        changed = True
        while changed:
            changed = False
            for q in range(count):
                least = 0 if ends[q] else min((min(far, (size[self.names[s]] if s in rules else 1) + size[t]) for s, t in moves[q].items()), default=far)
                if least < size[q]:
                    size[q], changed = least, True
        closure = np.full((count, count), far, np.int32)
        np.fill_diagonal(closure, 0)
        takes: dict[tuple[int, int], set[str]] = {}
        splits: list[tuple[int, int, int]] = []
        for q in range(count):
            for s, t in moves[q].items():
                if s in rules:
                    x = self.names[s]
                    closure[q, t] = min(closure[q, t], size[x])
                    closure[q, x] = min(closure[q, x], size[t])
                    if moves[t]:  # with nothing to come, what follows the name is deleted inside it
                        splits.append((q, x, t))
                else:
                    closure[q, t] = min(closure[q, t], 1)
                    takes.setdefault((q, t), set()).add(s)
        for k in range(count):
            np.minimum(closure, closure[:, k, None] + closure[None, k], out=closure)
        self.ends = np.array(ends)
        self.size = size
        # only what starts with a token or divides adds to the closure; deleting is in it already
        own = sorted({q for q, _ in takes} | {q for q, _, _ in splits})
        row = {q: k for k, q in enumerate(own)}
        # names come first, the other states that are read get what they can from the names
        hubs = sorted(self.names.values())
        read = sorted(({t for _, t in takes} | {x for _, x, _ in splits} | {t for _, _, t in splits} | {self.goal}) - set(hubs))
        self.of_hubs = _Least([(h, row[o], closure[h, o]) for h in hubs for o in own if closure[h, o] < far])
        direct, through = [], []
        for q in read:
            by_hub = closure[q, hubs]
            for o in np.flatnonzero((closure[q, own] < far) & (closure[q, own] < (by_hub[:, None] + closure[np.ix_(hubs, own)]).min(0))):
                direct.append((q, o, closure[q, own[o]]))
            near = list(np.flatnonzero(by_hub < far))
            covers = by_hub[:, None] + closure[np.ix_(hubs, hubs)] <= by_hub
            for h in tuple(near):
                if any(covers[g, h] for g in near if g != h):
                    near.remove(h)
            through += [(q, hubs[h], by_hub[h]) for h in near]
        self.of_read, self.of_names = _Least(direct), _Least(through)
        self.own = len(own)
        self.takes = [(frozenset(s), q, t) for (q, t), s in sorted(takes.items())]
        self.take_to = np.array([t for _, _, t in self.takes], np.intp)
        self.take = _Least([(row[q], k, 0) for k, (_, q, _) in enumerate(self.takes)])
        made = sorted({(x, t) for _, x, t in splits})  # equal splits of several states are made once
        self.split_left, self.split_right = np.array([x for x, _ in made], np.intp), np.array([t for _, t in made], np.intp)
        at = {p: k for k, p in enumerate(made)}
        self.split = _Least([(row[q], at[x, t], 0) for q, x, t in sorted(splits)])

    def cost(self, tokens: Sequence[frozenset[str]]) -> int:
        n = len(tokens)
        kind, far = (np.int16, self.FAR) if n < self.FAR // 2 else (np.int32, 1 << 28)
        now = np.repeat(np.where(self.size < self.FAR, self.size, far).astype(kind)[:, None], n + 1, 1)
        alike = list(dict.fromkeys(tokens))
        at = {t: k for k, t in enumerate(alike)}
        wrong = np.array([[s.isdisjoint(t) for t in alike] for s, _, _ in self.takes], kind).reshape(len(self.takes), len(alike))[:, [at[t] for t in tokens]]
        left, right = [now[:0]], [now[:0]]  # by length: what splits read, by start
        for length in range(1, n + 1):
            m = n - length + 1
            before = now[:, 1:]
            base = np.full((self.own, m), far, kind)
            self.take.into(base, wrong[:, :m] + before[self.take_to])
            if length > 1 and len(self.split_left):
                best = left[1][:, :m] + right[length - 1][:, 1:]
                both = np.empty_like(best)
                for k in range(2, length):
                    np.add(left[k][:, :m], right[length - k][:, k:], out=both)
                    np.minimum(best, both, out=best)
                self.split.into(base, best)
            now = before + kind(1)
            now[self.ends] = np.minimum(now[self.ends], kind(length))
            self.of_hubs.into(now, base)
            self.of_read.into(now, base)
            self.of_names.into(now, now)
            left.append(now[self.split_left])
            right.append(now[self.split_right])
        return int(now[self.goal, 0])


class _Least:
    """Rows that are the least of rows of another array, each plus a cost of its own; given as (row, other row, cost) by row."""

    #: Numbers of an intermediate array, so that memory beside the tables is bounded.
    CELLS = 1 << 20

    def __init__(self, given: list[tuple[int, int, int]]) -> None:
        rows = np.array([r for r, _, _ in given], np.intp)
        self.at = np.flatnonzero(np.diff(rows, prepend=-1))
        self.rows = rows[self.at]
        self.other = np.array([o for _, o, _ in given], np.intp)
        self.cost = np.array([c for _, _, c in given], np.int16)[:, None]
        self.free = not self.cost.any()

    def into(self, out: np.ndarray, other: np.ndarray) -> None:
        """Lowers the rows of out."""
        if not len(self.rows):
            return
        step = max(1, self.CELLS // len(self.other))
        for i in range(0, out.shape[1], step):
            got = other[self.other, i : i + step]
            if not self.free:
                got += self.cost
            out[self.rows, i : i + step] = np.minimum(out[self.rows, i : i + step], np.minimum.reduceat(got, self.at, 0))
