"""Table-driven recognition: grammars to LR tables, and parsing of token classes with shared stacks.

A grammar is text: ``Name: a b | c``. Symbols that start a rule are nonterminals, all others terminals. Suffixes on
names: ``?``, ``*``, ``+``, ``%,`` (list with commas) and ``%,,`` (the same, a last comma allowed). ``BAR`` stands
for the terminal ``|``. Tables are LR(0) automata with follow sets; where they leave a choice, the parser follows all
(generalised LR). Since only acceptance matters, equal stacks are one: stacks are numbered by (state, rest), so a set
of stacks is a small tuple, and what a token or a whole line of token classes does to it is remembered. Lines of code
repeat in shape, so most lines cost one look-up; the result is the same as that of parsing every token.
"""

from __future__ import annotations

import re

END = "\0"


class Grammar:
    """LR tables of a grammar. ``prefer``: pairs (a, b) of nonterminals; where both may start with one token, only a may."""

    def __init__(self, text: str, start: str, terminals: dict[str, str], prefer: tuple[tuple[str, str], ...] = ()):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.made: set[str] = set()
        heads = {m[1] for m in re.finditer(r"(?m)^([A-Z]\w*):", text)}
        self.heads, self.terminals = heads, terminals
        body = re.sub(r"\n[ \t]+", " ", text)
        for line in body.split("\n"):
            line = line.strip()
            if line:
                name, _, alts = line.partition(":")
                for alt in alts.split(" | "):
                    self.rules.append((name, tuple(self._symbol(s) for s in alt.split() if s != "EMPTY")))
        self.rules.append(("_Start", (start,)))
        self.nonterminals = {a for a, _ in self.rules}
        self._build(prefer)

    def _symbol(self, s: str) -> str:
        for suffix in ("%,,", "%,", "?", "*", "+"):
            if s.endswith(suffix) and len(s) > len(suffix) and s[0].isalpha():
                base = self._symbol(s[: -len(suffix)])
                name = f"{base}{suffix}"
                if name not in self.made:
                    self.made.add(name)
                    comma = self.terminals[","] if "%" in suffix else ""
                    self.rules += {
                        "?": [(name, ()), (name, (base,))],
                        "*": [(name, ()), (name, (name, base))],
                        "+": [(name, (base,)), (name, (name, base))],
                        "%,": [(name, (base,)), (name, (name, comma, base))],
                        "%,,": [(name, (f"{base}%,",)), (name, (f"{base}%,", comma))],
                    }[suffix]
                    if suffix == "%,,":
                        self._symbol(s[:-1])
                return name
        if s in self.heads:
            return s
        if s == "BAR":
            s = "|"
        if s not in self.terminals:
            raise ValueError(f"no terminal {s!r}")
        return self.terminals[s]

    def _build(self, prefer) -> None:
        rules, nts = self.rules, self.nonterminals
        by: dict[str, list[int]] = {}
        for i, (a, _) in enumerate(rules):
            by.setdefault(a, []).append(i)
        empty: set[str] = set()
        first: dict[str, set[str]] = {a: set() for a in nts}
        follow: dict[str, set[str]] = {a: set() for a in nts}
        follow["_Start"].add(END)
        changed = True
        while changed:
            changed = False
            for a, rhs in rules:
                n = len(first[a]) + (a in empty)
                for s in rhs:
                    first[a] |= first[s] if s in nts else {s}
                    if s not in empty:
                        break
                else:
                    empty.add(a)
                changed |= n != len(first[a]) + (a in empty)
        changed = True
        while changed:
            changed = False
            for a, rhs in rules:
                trail = set(follow[a])
                for s in reversed(rhs):
                    if s in nts:
                        n = len(follow[s])
                        follow[s] |= trail
                        changed |= n != len(follow[s])
                        trail = trail | first[s] if s in empty else set(first[s])
                    else:
                        trail = {s}
        closures: dict[str, list[tuple[int, int]]] = {}

        def closure_of(nt: str) -> list[tuple[int, int]]:
            if nt not in closures:
                seen, todo, out = {nt}, [nt], []
                while todo:
                    for r in by[todo.pop()]:
                        out.append((r, 0))
                        rhs = rules[r][1]
                        if rhs and rhs[0] in nts and rhs[0] not in seen:
                            seen.add(rhs[0])
                            todo.append(rhs[0])
                closures[nt] = out
            return closures[nt]

        start = frozenset({(len(rules) - 1, 0)})
        number, kernels = {start: 0}, [start]
        self.shift: list[dict[str, int]] = []
        self.goto: list[dict[str, int]] = []
        self.reduce: list[dict[str, tuple[tuple[str, int], ...]]] = []
        i = 0
        while i < len(kernels):
            items = set(kernels[i])
            for r, d in kernels[i]:
                rhs = rules[r][1]
                if d < len(rhs) and rhs[d] in nts:
                    items.update(closure_of(rhs[d]))
            move: dict[str, set[tuple[int, int]]] = {}
            red: dict[str, set[tuple[str, int]]] = {}
            for r, d in items:
                a, rhs = rules[r]
                if d < len(rhs):
                    move.setdefault(rhs[d], set()).add((r, d + 1))
                else:
                    for t in follow[a]:
                        red.setdefault(t, set()).add((a, len(rhs)))
            shift, goto = {}, {}
            for s, kernel in move.items():
                for a, b in prefer:
                    if s not in nts and any(rules[r][0] == a and d == 1 for r, d in kernel):
                        kernel = {(r, d) for r, d in kernel if not (rules[r][0] == b and d == 1)}
                k = frozenset(kernel)
                if k not in number:
                    number[k] = len(kernels)
                    kernels.append(k)
                (goto if s in nts else shift)[s] = number[k]
            self.shift.append(shift)
            self.goto.append(goto)
            self.reduce.append({t: tuple(x) for t, x in red.items()})
            i += 1


class Parser:
    """Sets of stacks of one grammar and what tokens do to them."""

    LIMIT = 400_000

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.reset()

    def reset(self) -> None:
        self.state, self.up = [0], [-1]
        self.node: dict[tuple[int, int], int] = {}
        self.steps: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}
        self.lines: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}
        self.start = (0,)

    def full(self) -> bool:
        return len(self.state) + len(self.steps) + len(self.lines) > self.LIMIT

    def push(self, parent: int, state: int) -> int:
        k = (parent, state)
        n = self.node.get(k)
        if n is None:
            n = self.node[k] = len(self.state)
            self.state.append(state)
            self.up.append(parent)
        return n

    def step(self, stacks: tuple[int, ...], token: str) -> tuple[int, ...]:
        """The stacks after a token; none if no stack takes it."""
        key = (stacks, token)
        out = self.steps.get(key)
        if out is not None:
            return out
        g, state, up = self.g, self.state, self.up
        work, seen, done = list(stacks), set(stacks), set()
        while work:
            s = work.pop()
            q = state[s]
            t = g.shift[q].get(token)
            if t is not None:
                done.add(self.push(s, t))
            for lhs, n in g.reduce[q].get(token, ()):
                p = s
                for _ in range(n):
                    p = up[p]
                to = g.goto[state[p]].get(lhs)
                if to is not None:
                    r = self.push(p, to)
                    if r not in seen:
                        seen.add(r)
                        work.append(r)
        out = self.steps[key] = tuple(sorted(done))
        return out

    def accepts(self, stacks: tuple[int, ...]) -> bool:
        """Whether the text may end here."""
        g, state, up = self.g, self.state, self.up
        work, seen = list(stacks), set(stacks)
        while work:
            s = work.pop()
            q = state[s]
            for lhs, n in g.reduce[q].get(END, ()):
                if lhs == "_Start":
                    return True
                p = s
                for _ in range(n):
                    p = up[p]
                to = g.goto[state[p]].get(lhs)
                if to is not None:
                    r = self.push(p, to)
                    if r not in seen:
                        seen.add(r)
                        work.append(r)
        return False

    def run(self, stacks: tuple[int, ...], line: str) -> tuple[int, ...]:
        """The stacks after a line of token classes."""
        key = (stacks, line)
        out = self.lines.get(key)
        if out is None:
            out = stacks
            for t in line:
                out = self.step(out, t)
                if not out:
                    break
            self.lines[key] = out
        return out
