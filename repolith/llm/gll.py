"""Generalised LL recognition with a graph-structured stack.

A grammar is compiled into slots. A descriptor is (slot, position, local stack,
stack node). While only one alternative fits the next token the recogniser just
walks on and keeps return slots on the descriptor's local stack. Where several
fit, it creates (or joins) the stack node of (nonterminal, position): the
alternatives run as descriptors of their own, every caller waits at the node, and
each end position found there is handed to all of them once. So a nonterminal is
never parsed twice at one place and the work stays polynomial for any grammar.

Dialects run together: a descriptor carries the set of dialects (a bit mask) for
which it holds, an alternative lets through those that have it, and stack nodes and
the ends found at them know theirs. Dialects part only where their grammars do.

Grammar text, one rule a line:  ``Name = alternative | alternative``; ``'x'`` and
UPPER names are terminals, ``X?``, ``X*`` and ``X+`` and groups in parentheses are
allowed; ``X%`` is one or more X with commas between them and perhaps one behind. One that starts with ``@ts``
belongs to the dialects with that mark only (``@-jsx``: to those without it).
Repetitions and options take what fits the next token (longest match) unless the
rule's name is followed by ``~``: then leaving them out is tried as well. Behind
``!`` only the first alternative that fits the next token counts. ``SEMI`` and
``SEP`` are statement and member ends that a line end may stand for.
"""

from __future__ import annotations

import re

END, SEMI, SEP = -1, -2, -3
_SYMBOL = re.compile(r"\s*('[^']+'|@-?\w+|[A-Za-z_]\w*|[()|?*+%~!])")


class Grammar:
    """``dialects``: the marks of each dialect, whose bit is its place; ``kinds``: terminal name -> number."""

    def __init__(self, text: str, kinds: dict[str, int], dialects: list[frozenset[str]]) -> None:
        self.kinds = kinds
        self.dialects = dialects
        self.every = (1 << len(dialects)) - 1
        self.rules: dict[str, list[tuple[int, list[str]]]] = {}
        self.doubtful: set[str] = set()
        self.ordered: set[str] = set()
        self._helpers = 0
        for line in re.sub(r"\n[ \t]+", " ", text).splitlines():
            line = line.partition("##")[0].strip()
            if line:
                name, _, body = line.partition(" = ")
                name = name.strip()
                if name.endswith(("~", "!")):
                    (self.doubtful if name[-1] == "~" else self.ordered).add(name[:-1])
                    name = name[:-1]
                tokens = _SYMBOL.findall(body)
                self.rules[name], rest = self._alternatives(tokens, name in self.doubtful)
                assert not rest, (name, rest)
        self._compile()

    def _alternatives(self, tokens: list[str], doubtful: bool) -> tuple[list[tuple[int, list[str]]], list[str]]:
        out: list[tuple[int, list[str]]] = []
        current: list[str] = []
        mask = self.every
        while tokens and tokens[0] != ")":
            token, tokens = tokens[0], tokens[1:]
            if token == "|":
                out.append((mask, current))
                current, mask = [], self.every
                continue
            if token.startswith("@"):
                mask &= sum(1 << d for d, marks in enumerate(self.dialects) if (token[2:] not in marks if token[1] == "-" else token[1:] in marks))
                continue
            if token == "(":
                inner, tokens = self._alternatives(tokens, doubtful)
                tokens = tokens[1:]
                token = self._helper(inner, doubtful)
            while tokens and tokens[0] in "?*+%":
                mark, tokens = tokens[0], tokens[1:]
                always = lambda *alts: [(self.every, list(x)) for x in alts]
                if mark == "?":
                    token = self._helper(always([token], []), doubtful)
                elif mark == "%":
                    more, following = self._helper([], doubtful), self._helper([], doubtful)
                    self.rules[more] = always(["','", following], [])
                    self.rules[following] = always([token, more], [])
                    token = self._helper(always([token, more]), doubtful)
                else:
                    loop = self._helper([], doubtful)
                    self.rules[loop] = always([token, loop], [])
                    token = loop if mark == "*" else self._helper(always([token, loop]), doubtful)
            current.append(token)
        out.append((mask, current))
        return out, tokens

    def _helper(self, alternatives: list[tuple[int, list[str]]], doubtful: bool) -> str:
        self._helpers += 1
        name = f"_{self._helpers}"
        self.rules[name] = alternatives
        if doubtful:
            self.doubtful.add(name)
        return name

    def _terminal(self, symbol: str) -> int | None:
        if symbol in self.rules:
            return None
        if symbol[0] == "'":
            return self.kinds[symbol[1:-1]]
        if symbol == "SEMI":
            return SEMI
        if symbol == "SEP":
            return SEP
        if symbol.isupper() or symbol in self.kinds:
            return self.kinds[symbol]
        return None

    def _compile(self) -> None:
        rules = {name: [(mask, [(t, None) if (t := self._terminal(s)) is not None else (None, s) for s in alt]) for mask, alt in alts] for name, alts in self.rules.items()}
        for name, alts in rules.items():
            for _, alt in alts:
                for terminal, symbol in alt:
                    assert terminal is not None or symbol in rules, (name, symbol)
        self.number = {name: i for i, name in enumerate(rules)}
        self.ops: list[int] = []
        entries: dict[str, list[int]] = {}
        for name, alts in rules.items():
            entries[name] = []
            for _, alt in alts:
                entries[name].append(len(self.ops))
                self.ops += [terminal if terminal is not None else -10 - self.number[symbol] for terminal, symbol in alt]
                self.ops.append(END)
        rows = [self._predict({n: [(alt, e) for (mask, alt), e in zip(alts, entries[n]) if mask >> d & 1] for n, alts in rules.items()}) for d in range(len(self.dialects))]
        self.table: list[list] = []
        for name in rules:
            row: list = []
            for kind in range(max(self.kinds.values()) + 1):
                masks: dict[int, int] = {}
                for d, predicted in enumerate(rows):
                    for e in predicted[name][kind]:
                        masks[e] = masks.get(e, 0) | 1 << d
                [alone] = masks if len(masks) == 1 else [None]
                row.append(None if not masks else alone if alone is not None and masks[alone] == self.every else tuple(masks.items()))
            self.table.append(row)

    def _predict(self, rules: dict[str, list]) -> dict[str, list[list[int]]]:
        """For one dialect: which alternatives of each nonterminal fit each token."""
        n_kinds = max(self.kinds.values()) + 1
        # A line end may stand for SEMI or SEP, so any token can follow there.
        anything = set(range(n_kinds))
        first: dict[str, set[int]] = {n: set() for n in rules}
        empty: dict[str, bool] = dict.fromkeys(rules, False)

        def first_of(alt) -> tuple[set[int], bool]:
            out: set[int] = set()
            for terminal, symbol in alt:
                if terminal is not None:
                    out |= anything if terminal < 0 else {terminal}
                    return out, False
                out |= first[symbol]
                if not empty[symbol]:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for name, alts in rules.items():
                for alt, _ in alts:
                    f, e = first_of(alt)
                    if not f <= first[name] or e and not empty[name]:
                        first[name] |= f
                        empty[name] = empty[name] or e
                        changed = True
        out: dict[str, list[list[int]]] = {}
        for name, alts in rules.items():
            firsts = [(e, *first_of(alt)) for alt, e in alts]
            out[name] = []
            for kind in range(n_kinds):
                fits = [e for e, f, _ in firsts if kind in f]
                if not fits or name in self.doubtful:
                    fits = fits + [e for e, _, blank in firsts if blank and e not in fits]
                out[name].append(fits[:1] if name in self.ordered else fits)
        return out

    def accepts(self, start: str, kinds, breaks=None, *, mask: int = 1, wanted: int | None = None) -> tuple[int, int]:
        """(the dialects of ``mask`` in which ``start`` derives all of ``kinds`` up to its end mark, furthest position reached).

        The last element of ``kinds`` must be the end mark (kind 0). ``breaks(i)``
        tells whether a line ends before token i. Once the dialects ``wanted``
        (all of ``mask`` if not given) are accepted the rest is not looked at.
        """
        ops, table = self.ops, self.table
        semicolon, comma, brace = self.kinds.get(";", -9), self.kinds.get(",", -9), self.kinds.get("}", -9)
        wanted = mask if wanted is None else wanted
        # A stack node: ends found (position -> dialects), waiting callers, dialects its alternatives run for.
        nodes: dict[tuple[int, int], list] = {}
        root: list = [{}, [], 0]
        cell = table[self.number[start]][kinds[0]]
        if cell is None:
            return 0, 0
        work = [(e, 0, None, root, m & mask) for e, m in (cell if type(cell) is tuple else ((cell, mask),)) if m & mask]
        furthest = accepted = 0
        while work:
            slot, at, stack, node, alive = work.pop()
            while True:
                op = ops[slot]
                if op >= 0:
                    if kinds[at] == op:
                        if op == 0:
                            accepted |= alive
                            if accepted & wanted == wanted:
                                return accepted, at
                            break
                        slot += 1
                        at += 1
                        continue
                    break
                if op <= -10:
                    n = -10 - op
                    cell = table[n][kinds[at]]
                    if cell is None:
                        break
                    if type(cell) is tuple:
                        live = [(e, m & alive) for e, m in cell if m & alive]
                        if not live:
                            break
                        if len(live) > 1:
                            if len(live) == 2 and not live[0][1] & live[1][1]:
                                # Every dialect goes its own way: no stack node is needed.
                                e, m = live[1]
                                work.append((e, at, stack if ops[slot + 1] == END else (slot + 1, stack), node, m))
                            else:
                                key = (n, at)
                                known = nodes.get(key)
                                if known is None:
                                    known = nodes[key] = [{}, [], 0]
                                new = alive & ~known[2]
                                if new:
                                    known[2] |= new
                                    for e, m in live:
                                        if m & new:
                                            work.append((e, at, None, known, m & new))
                                known[1].append((slot + 1, stack, node, alive))
                                for end, m in known[0].items():
                                    if m & alive:
                                        work.append((slot + 1, end, stack, node, m & alive))
                                break
                        cell, alive = live[0]
                    slot += 1
                    if ops[slot] != END:
                        stack = (slot, stack)
                    slot = cell
                    continue
                if op == END:
                    if stack is not None:
                        slot, stack = stack
                        continue
                    new = alive & ~node[0].get(at, 0)
                    if new:
                        node[0][at] = node[0].get(at, 0) | new
                        for s, st, owner, m in node[1]:
                            if m & new:
                                work.append((s, at, st, owner, m & new))
                    break
                kind = kinds[at]  # SEMI or SEP
                if kind == semicolon or op == SEP and kind == comma:
                    slot += 1
                    at += 1
                elif kind == brace or kind == 0 or breaks is not None and breaks(at):
                    slot += 1
                else:
                    break
            if at > furthest:
                furthest = at
        return accepted, furthest
