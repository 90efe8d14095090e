"""Cheapest edits of role and fault sequences, by grammar compression and min-plus matrices.

A sequence has one symbol per row.  Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair
comes twice, over many sequences at once, so that what they share is one rule.  Each symbol has a matrix from every state
before it to every state after it: the least cost of edits and, of the cheapest, the ASCII-least string of their initials.
A rule's matrix is the min-plus product of its two parts' matrices, so it is worked out once, however often and in however
many sequences it stands.

The strings are ropes that share the parts of their rules.  Of two strings for the same symbols between the same states
neither starts with the other unless one costs more (it would have insertions on top), so the least of the parts gives
the least of the whole.
"""

from __future__ import annotations

import numpy as np

#: States: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
#: The state after a row of each role, by the state before; other moves aren't allowed.
AFTER_USER, AFTER_ASSISTANT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Classes of roles by their initial; all others are ``OTHER``.
ROLE_U, ROLE_A, ROLE_S, OTHER = range(4)
#: Symbols: a row that must go, then two for each class of roles, whole and truncated.
MUST_GO, SYMBOLS = 0, 9

_MOD, _BASE = (1 << 61) - 1, 911_382_323
_LEAF = 64


def symbol(role: int, truncated: bool) -> int:
    return 1 + 2 * role + truncated


class Rope:
    """A string as a tree of shared parts, with a hash by which equal parts are passed over in comparisons."""

    __slots__ = ("hash", "left", "power", "right", "size", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.power = left.power * right.power % _MOD
            self.hash = (left.hash * right.power + right.hash) % _MOD
        else:
            self.size, self.power, self.hash = len(text), pow(_BASE, len(text), _MOD), 0
            for c in text.encode():
                self.hash = (self.hash * _BASE + c) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= _LEAF and self.text is not None and other.text is not None:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if x.text is None:
                stack += [x.right, x.left]
            else:
                out.append(x.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.text is None and (y.text is not None or x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            elif y.text is None:
                b += [y.right, y.left]
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                if y.size > n:
                    b.append(Rope(y.text[n:]))
        return not a and bool(b)


EMPTY = Rope("")
#: A matrix: (cost, rope) or None for each state before, times 4, plus the state after.
Matrix = list


def times(a: Matrix, b: Matrix, rows: int = 4) -> Matrix:
    """The min-plus product; ``rows`` 1 for a vector."""
    out: Matrix = [None] * (4 * rows)
    for i in range(rows):
        for j in range(4):
            best, parts = None, None
            for k in range(4):
                x, y = a[4 * i + k], b[4 * k + j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best or cost == best and x[1] + y[1] < parts[0] + parts[1]:
                    best, parts = cost, (x[1], y[1])
            if best is not None:
                out[4 * i + j] = best, parts[0] + parts[1]
    return out


def _insertions() -> Matrix:
    """What insertions alone reach: none, one or two of them; more come back to a state at a cost."""
    out: Matrix = [(0, EMPTY) if i % 5 == 0 else None for i in range(16)]
    one = AFTER_USER | AFTER_ASSISTANT
    for s in range(4):
        t = one[s]
        out[4 * s + t] = INSERT, Rope("I")
        if out[4 * s + one[t]] is None:
            out[4 * s + one[t]] = 2 * INSERT, Rope("II")
    return out


INSERTIONS = _insertions()


def _edits(code: int) -> Matrix:
    out: Matrix = [(DELETE, Rope("D")) if i % 5 == 0 else None for i in range(16)]
    if code != MUST_GO:
        role, more = (code - 1) // 2, TRUNCATED * ((code - 1) % 2)
        for state in range(4):
            for own, after in ((ROLE_U, AFTER_USER), (ROLE_A, AFTER_ASSISTANT)):
                if state in after:
                    out[4 * state + after[state]] = (more, Rope("K")) if role == own else (more + REROLE, Rope("R"))
        if role == ROLE_S:
            out[4 * NOTHING + SYSTEM] = more, Rope("K")
    return out


#: Of each symbol: insertions before the row, then its own edit.
BASE = [times(INSERTIONS, _edits(code)) for code in range(SYMBOLS)]


def re_pair(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules, the first of which is symbol ``SYMBOLS``, and the sequences in them; each round takes pairs that share no symbol."""
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64), -1) for s in sequences]) if sequences else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        width = SYMBOLS + len(rules)
        pairs = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * width + text[1:], -1)
        found, n = np.unique(pairs[pairs >= 0], return_counts=True)
        used, chosen = set(), {}
        for at in np.argsort(-n, kind="stable"):
            if n[at] < 2:
                break
            pair = divmod(int(found[at]), width)
            if used.isdisjoint(pair):
                used.update(pair)
                chosen[int(found[at])] = width + len(chosen)
                rules.append(pair)
        if not chosen:
            break
        keys = np.array(sorted(chosen))
        slot = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        at = np.flatnonzero(keys[slot] == pairs)
        # Of a run of the same symbol every second place starts a pair.
        starts = np.concatenate([[True], np.diff(at) > 1])
        at = at[(at - at[np.flatnonzero(starts)][np.cumsum(starts) - 1]) % 2 == 0]
        text[at] = np.array([chosen[k] for k in keys.tolist()])[slot[at]]
        text = np.delete(text, at + 1)
    return rules, np.split(text, np.flatnonzero(text < 0) + 1)[: len(sequences)]


def matrices(sequences: list[bytes]) -> dict[bytes, Matrix]:
    """The matrix of each distinct sequence."""
    distinct = sorted(set(sequences))
    rules, short = re_pair(distinct)
    of = list(BASE)
    for left, right in rules:
        of.append(times(of[left], of[right]))
    out = {}
    for key, symbols in zip(distinct, short, strict=True):
        symbols = symbols[symbols >= 0].tolist()
        m = of[symbols[0]]
        for s in symbols[1:]:
            m = times(m, of[s])
        out[key] = m
    return out


def finish(vector: Matrix) -> tuple[int, int, Rope, str]:
    """Cost, the state before the last insertions, all edits, and the last insertions, of the cheapest way to an accepted state."""
    best = None
    for state, x in enumerate(vector):
        for end in ACCEPTED:
            y = INSERTIONS[4 * state + end]
            if x is not None and y is not None:
                got = x[0] + y[0], x[1] + y[1]
                if best is None or got[0] < best[0] or got[0] == best[0] and got[1] < best[2]:
                    best = got[0], state, got[1], str(y[1])
    return best
