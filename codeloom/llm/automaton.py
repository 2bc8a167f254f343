"""Regular expressions compiled together into one minimal deterministic automaton over bytes.

Syntax: literals, escapes (\\d \\w \\s \\n \\t and escaped signs), ``.``, classes with ranges and ``^``, groups,
``(?:``, ``|``, ``* + ? {m} {m,} {m,n}`` and a leading ``(?i)``. A class matches one byte; bytes over 127 belong
to negated classes and ``.`` only. Matching is leftmost-longest.
"""

from __future__ import annotations

import numpy as np

from .shared import mix

_DIGIT = frozenset(b"0123456789")
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_SPACE = frozenset(b" \t\n\r\f\v")
_ALL = frozenset(range(255))  # 255 never occurs in UTF-8: it separates texts
_ESCAPES = {"d": _DIGIT, "w": _WORD, "s": _SPACE, "D": _ALL - _DIGIT, "W": _ALL - _WORD, "S": _ALL - _SPACE, "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
_MANY = 1000


class _Parser:
    """Pattern -> tree of ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.s, self.i = pattern[4:] if self.fold else pattern, 0
        self.tree = self._either()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {pattern!r}")

    def _more(self, signs: str) -> bool:
        return self.i < len(self.s) and self.s[self.i] in signs

    def _take(self) -> str:
        if self.i >= len(self.s):
            raise ValueError(f"pattern ends too early: {self.s!r}")
        self.i += 1
        return self.s[self.i - 1]

    def _either(self):
        parts = [self._sequence()]
        while self._more("|"):
            self.i += 1
            parts.append(self._sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self):
        node = self._atom()
        while self._more("*+?{"):
            c = self._take()
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(least), (int(most) if most else None) if comma else int(least)
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            if low > _MANY or (high is not None and (high > _MANY or high < low)):
                raise ValueError(f"bad repetition {{{low},{high}}}")
            node = ("rep", node, low, high)
        return node

    def _set(self, chars: frozenset[int]):
        if self.fold:
            chars |= frozenset(b for c in chars if chr(c).isalpha() and c < 128 for b in (ord(chr(c).lower()), ord(chr(c).upper())))
        return ("set", chars)

    def _literal(self, c: str):
        encoded = c.encode()
        return self._set(frozenset(encoded)) if len(encoded) == 1 else ("cat", [("set", frozenset([b])) for b in encoded])

    def _atom(self):
        c = self._take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            elif self._more("?"):
                raise ValueError("only (?: groups are known")
            node = self._either()
            if not self._more(")"):
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            return self._class()
        if c == ".":
            return ("set", _ALL - frozenset(b"\n"))
        if c == "\\":
            return self._escape()
        if c in "*+?{)^$":
            raise ValueError(f"unexpected {c!r}")
        return self._literal(c)

    def _escape(self):
        c = self._take()
        if c in _ESCAPES:
            return self._set(_ESCAPES[c])
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return self._literal(c)

    def _class(self):
        negated = self._more("^")
        self.i += negated
        chars: set[int] = set()
        first = True
        while first or not self._more("]"):
            first = False
            c = self._take()
            if c == "\\":
                _, got = self._escape()
            else:
                got = frozenset([ord(c)])
            if self._more("-") and self.s[self.i + 1 : self.i + 2] not in ("]", "") and len(got) == 1:
                self.i += 1
                low, end = min(got), self._take()
                high = ord(self._take() if end == "\\" else end)
                got = frozenset(range(low, high + 1))
            if max(got) > 254:
                raise ValueError("classes hold ASCII only")
            chars |= got
        self.i += 1
        kind, out = self._set(frozenset(chars))
        return (kind, _ALL - out) if negated else (kind, out)


class _Nfa:
    """States with edges over byte sets and empty edges."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


def _shortest_tail(node):
    """The pattern with its last repetition at its least: enough to see that a match has ended."""
    if node[0] == "rep":
        return ("rep", node[1], node[2], node[2])
    if node[0] == "cat":
        parts = list(node[1])
        while parts and parts[-1][0] == "rep" and parts[-1][2] == 0:
            parts.pop()
        return ("cat", [*parts[:-1], _shortest_tail(parts[-1])] if parts else [])
    return node


class Dfa:
    """A minimal automaton for several patterns.

    ``classes`` maps a byte to its class; ``next[state * width + class]`` is the next state times width. State 0
    is the start; ``accepts[state]`` holds a bit for each pattern that ends there. With ``search``, a match may
    start anywhere, or, for a pattern whose ``bounded`` is true, after a byte that isn't a letter, digit or
    underscore; the first end of a match is accepted, not every longer one. Without ``search``, a match starts
    at the start, and ``dead`` is the state times width from which nothing follows.
    """

    def __init__(self, patterns: list[str], search: bool, bounded: list[bool] | None = None, most_states: int = 100_000):
        nfa = _Nfa()
        always, after_break = nfa.state(), nfa.state()
        ends = {}
        for k, p in enumerate(patterns):
            own = nfa.state()
            nfa.empty[after_break if search and bounded and bounded[k] else always].append(own)
            tree = _Parser(p).tree
            ends[nfa.add(_shortest_tail(tree) if search else tree, own)] = k
        self.classes, members = self._byte_classes(nfa)
        width = self.width = len(members)
        closure = self._closures(nfa)
        step = [[0] * width for _ in nfa.moves]
        for s, edges in enumerate(nfa.moves):
            for chars, to in edges:
                for c, b in enumerate(members):
                    if b in chars:
                        step[s][c] |= closure[to]
        accepting = [(1 << s, 1 << k) for s, k in ends.items()]
        # only states with edges, or that accept, tell subsets apart
        useful = sum(1 << s for s, e in enumerate(nfa.moves) if e) | sum(1 << s for s in ends)
        first = (closure[always] | closure[after_break]) & useful
        again = [(closure[always] | (0 if b in _WORD else closure[after_break])) & useful if search else 0 for b in members]
        edges_of = sum(1 << s for s, e in enumerate(nfa.moves) if e)
        numbers, order, table = {first: 0}, [first], []
        at = 0
        while at < len(order):
            rest = order[at] & edges_of
            at += 1
            to_by_class = again.copy()
            while rest:
                low = rest & -rest
                rest ^= low
                for c, x in enumerate(step[low.bit_length() - 1]):
                    if x:
                        to_by_class[c] |= x
            row = []
            for to in to_by_class:
                to &= useful
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                    if len(order) > most_states:
                        raise ValueError(f"the patterns need more than {most_states} states")
                row.append(numbers[to])
            table.append(row)
        accepts = [sum(bit for s, bit in accepting if subset & s) for subset in order]
        self.subsets = len(order)
        self._minimise(np.array(table, np.int64), accepts)
        self.dead = None if search else self._dead()

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no set tells apart share a class; one member stands for each."""
        sets = list({chars for edges in nfa.moves for chars, _ in edges})
        seen: dict[tuple, int] = {}
        classes, members = np.zeros(256, np.uint8), []
        for b in range(256):
            key = (b == 255, b in _WORD, *(b in s for s in sets))
            if key not in seen:
                seen[key] = len(members)
                members.append(b)
            classes[b] = seen[key]
        return classes, members

    @staticmethod
    def _closures(nfa: _Nfa) -> list[int]:
        out = []
        for s in range(len(nfa.empty)):
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            out.append(sum(1 << t for t in seen))
        return out

    def _minimise(self, table: np.ndarray, accepts: list[int]) -> None:
        """Moore's partition refinement: states in one block accept the same and lead to the same blocks."""
        kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        block = np.array([kinds[a] for a in accepts])
        count = len(kinds)
        factors = np.random.default_rng(0).integers(1, 2**63, self.width + 1, dtype=np.uint64) | np.uint64(1)
        while True:
            # a row of block numbers by a 64-bit hash
            rows = block.astype(np.uint64) * factors[0]
            for c in range(self.width):
                rows ^= (block[table[:, c]].astype(np.uint64) + np.uint64(c + 1)) * factors[c + 1] << np.uint64(1) ^ (rows >> np.uint64(31))
            _, block = np.unique(mix(rows), return_inverse=True)
            if block.max() + 1 == count:
                break
            count = int(block.max()) + 1
        # the start's block gets number 0
        rename = np.arange(count)
        rename[0], rename[block[0]] = block[0], 0
        block = rename[block]
        _, one = np.unique(block, return_index=True)
        self.states = count
        self.next = (block[table[one]] * self.width).astype(np.int32).ravel()
        self.accepts = [accepts[i] for i in one]

    def _dead(self) -> int | None:
        rows = self.next.reshape(self.states, self.width)
        for s in range(self.states):
            if not self.accepts[s] and (rows[s] == s * self.width).all():
                return s * self.width
        return None


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """The state (times width) after each byte, in one pass over the bytes.

    The bytes are cut into lanes that step together. Each lane assumes that it begins in the start state; where
    the lane before ends otherwise, its beginning is run again until the states agree.
    """
    n = len(data)
    lanes = max(1, min(lanes, n // 64))
    length = -(-n // lanes)
    padded = np.full(lanes * length, 255, np.uint8)
    padded[:n] = data
    cls = np.ascontiguousarray(dfa.classes[padded].reshape(lanes, length).T)
    out = np.empty((length, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for i in range(length):
        np.add(state, cls[i], out=state)
        np.take(dfa.next, state, out=out[i])
        state[:] = out[i]
    states = np.ascontiguousarray(out.T)
    table, classes = dfa.next, dfa.classes.tolist()
    for lane in range(1, lanes):
        s = int(states[lane - 1, -1])
        if s:
            row = states[lane]
            for i, b in enumerate(padded[lane * length : (lane + 1) * length].tolist()):
                s = int(table[s + classes[b]])
                if row[i] == s:
                    break
                row[i] = s
    return states.reshape(-1)[:n]
