"""Cheapest edits of a conversation's turns, as an automaton over backward cost vectors.

A repaired conversation has the role initials ``(s?(ua)+)?``. Where one stands in it is one of four states; the cheapest
way to the end from each of them is a vector of four costs. One row changes that vector by a small min-plus step. Vectors
that differ by a constant ask for the same edits, so a vector is kept less its minimum, and the few that ever occur are remembered.
"""

from __future__ import annotations

START, S, U, A = range(4)
#: Fixed values of the task: costs, and the initials of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = b" \t\n\x0b\x0c\r"
ROLES = {U: b"user", A: b"assistant"}
_NEXT = (U, U, A, U)
_KEEPS = ({S, U}, {U}, {A}, {U})
_LEGAL = {(S, U), (U, A), (A, U)}

#: Codes of rows: kind of role (0 for any other initial), then two flags.
LOST, CUT = 4, 8

Vector = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return costs


_OPEN = 10**6
FINAL: Vector = tuple(_inserted([0, _OPEN, _OPEN, 0]))  # type: ignore[assignment]
GUESS: Vector = (0, 0, 0, 0)
_STEPS: dict[tuple[Vector, int], tuple[Vector, int]] = {}
_MOVES: dict[tuple[Vector, int, int], tuple[str, int]] = {}


def kind_of(role: bytes) -> int:
    return {b"s": S, b"u": U, b"a": A}.get(role[:1], 0)


def legal(before: int, after: int) -> bool:
    return (before, after) in _LEGAL


def step(after: Vector, code: int) -> tuple[Vector, int]:
    """The vector before a row, less its minimum, and that minimum."""
    known = _STEPS.get((after, code))
    if known is None:
        costs = _inserted([min(c for _, c, _ in _choices(after, code, q)) for q in range(4)])
        least = min(costs)
        known = _STEPS[after, code] = tuple(c - least for c in costs), least
    return known


def _choices(after: Vector, code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: initial, cost to the end, state afterwards."""
    found = [("D", DELETE + after[state], state)]
    if not code & LOST:
        more, kind = TRUNCATED if code & CUT else 0, code & 3
        if kind in _KEEPS[state]:
            found.append(("K", more + after[kind], kind))
        found.append(("R", REROLE + more + after[_NEXT[state]], _NEXT[state]))
    return found


def moves(after: Vector, code: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits at a row, insertions before it among them, and the state behind it."""
    known = _MOVES.get((after, code, state))
    if known is None:
        before, least = step(after, code)
        edits, q = "", state
        while True:
            best = before[q] + least
            fits = [("I", None)] if INSERT + before[_NEXT[q]] + least == best else []
            fits += [(e, to) for e, cost, to in _choices(after, code, q) if cost == best]
            edit, to = min(fits, key=lambda f: f[0])
            edits += edit
            if edit != "I":
                break
            q = _NEXT[q]
        known = _MOVES[after, code, state] = edits, to
    return known


def last_moves(state: int) -> str:
    """Insertions behind the last row."""
    edits = ""
    while FINAL[state]:
        edits, state = edits + "I", _NEXT[state]
    return edits


def backward(codes: bytes, end: Vector) -> tuple[list[Vector], int]:
    """Vectors behind each row, in the order of the rows and with the one before the first row in front, and the cost left out of it."""
    vectors, total, vector = [end], 0, end
    for code in reversed(codes):
        vector, least = step(vector, code)
        total += least
        vectors.append(vector)
    vectors.reverse()
    return vectors, total


def refitted(codes: bytes, old: Vector, new: Vector, begin: Vector) -> Vector:
    """The vector before ``codes`` for another end: both ends are followed until they differ only by a constant."""
    for code in reversed(codes):
        if old == new:
            return begin
        old, new = step(old, code)[0], step(new, code)[0]
    return new


def after_edit(edits: str, state: int) -> list[tuple[str, int]]:
    """Each edit with the kind of role it gives (for insertions and reroles), from a state on."""
    out = []
    for e in edits:
        if e in "IR":
            state = _NEXT[state]
        out.append((e, state))
    return out
