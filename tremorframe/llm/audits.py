"""Cheapest edits that bring a sequence of turns into order, as shared prefixes with an order."""

from __future__ import annotations

from tremorframe.llm.common import travels

travels(__name__)

# Costs of the edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What is already written: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a kept turn with this initial, by the state before it; others may not be kept.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after an inserted or rewritten turn: its role follows from what is written.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: States in which a conversation may end.
COMPLETE = (NOTHING, ASSISTANT)

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Trails:
    """Strings as nodes that share their prefixes.

    A node knows its parent, its last letter, its depth, a rolling hash of its string, and one farther ancestor. The
    farther ancestors follow the skew-binary numbers: nodes of equal depth have theirs at equal depth, so two
    strings are lifted together in doubling steps, with one link a node instead of a table of them.
    """

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.hash, self.far = [0], [""], [0], [0], [0]

    def add(self, node: int, letter: str) -> int:
        far, depth = self.far, self.depth
        f = far[node]
        even = depth[node] - depth[f] == depth[f] - depth[far[f]]
        self.parent.append(node)
        self.letter.append(letter)
        depth.append(depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        far.append(far[f] if even and node else node)
        return len(far) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def lifted(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.far[node] if self.depth[self.far[node]] >= depth else self.parent[node]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two strings of one length with equal hashes are equal: walked back to the node that they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's: by the first letter after their longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if self.hash[x] != self.hash[y]:
            while self.hash[self.parent[x]] != self.hash[self.parent[y]]:
                if self.hash[self.far[x]] != self.hash[self.far[y]]:
                    x, y = self.far[x], self.far[y]
                else:
                    x, y = self.parent[x], self.parent[y]
            if self.equal(self.parent[x], self.parent[y]):
                return self.letter[x] < self.letter[y]
        elif self.equal(x, y):
            return self.depth[a] < self.depth[b]
        return self.text(a) < self.text(b)  # two strings had one hash


Cells = dict[int, tuple[int, int]]


def _offer(trails: Trails, cells: Cells, state: int, cost: int, node: int, letter: str) -> bool:
    """Take node's string plus ``letter`` for ``state`` if it is cheaper than what is there, or as cheap and before it."""
    held = cells.get(state)
    if held is not None and held[0] < cost:
        return False
    grown = trails.add(node, letter)
    if held is not None and held[0] == cost and not trails.less(grown, held[1]):
        return False
    cells[state] = (cost, grown)
    return True


def _with_inserts(trails: Trails, cells: Cells) -> Cells:
    """Any number of insertions. Each costs something, so a state is never reached from itself."""
    open_ = list(cells)
    while open_:
        state = open_.pop()
        cost, node = cells[state]
        held = cells.get(NEXT[state])
        if (held is None or held[0] >= cost + INSERT) and _offer(trails, cells, NEXT[state], cost + INSERT, node, "I"):
            open_.append(NEXT[state])
    return cells


def _after(trails: Trails, cells: Cells, code: str) -> Cells:
    """One turn more: ``d`` must go; s, u, a or x (another initial) may stay, capitals with the cost of a truncated one."""
    out: Cells = {}
    initial, extra = code.lower(), TRUNCATED if code.isupper() else 0
    for state, (cost, node) in cells.items():
        _offer(trails, out, state, cost + DELETE, node, "D")
        if initial != "d":
            if state in KEPT.get(initial, ()):
                _offer(trails, out, KEPT[initial][state], cost + extra, node, "K")
            _offer(trails, out, NEXT[state], cost + REROLE + extra, node, "R")
    return _with_inserts(trails, out)


def block(codes: str, start: int) -> dict[int, tuple[int, str]]:
    """``{state: (cost, audit)}``: the cheapest edits of some turns from ``start`` to each state, the ASCII-least of equal ones.

    Two equally dear strings for one state are never prefixes of each other: both consumed the same turns, and a longer one
    has more insertions to pay for. So what follows cannot turn their order, and one string a state is enough.
    """
    trails = Trails()
    cells = _with_inserts(trails, {start: (0, 0)})
    for code in codes:
        cells = _after(trails, cells, code)
    return {state: (cost, trails.text(node)) for state, (cost, node) in cells.items()}


def best(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    found = block(codes, NOTHING)
    return min(found[s] for s in COMPLETE if s in found)


def _precedes(a: tuple, b: tuple) -> bool:
    """Order of two chains ``(chain before, state before, audit)`` of equally many blocks, from where they part."""
    left, right = [], []
    while a is not b:
        left.append(a[2])
        right.append(b[2])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def chained(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a conversation in consecutive blocks (``{(state before, state after): (cost, audit)}``), and ``(state before, audit)``
    of each. Only edits on a cheapest way are compared."""
    ahead = [{NOTHING: 0}]
    for b in blocks:
        reached: dict[int, int] = {}
        for (f, t), (cost, _) in b.items():
            if f in ahead[-1]:
                reached[t] = min(reached.get(t, ahead[-1][f] + cost), ahead[-1][f] + cost)
        ahead.append(reached)
    total = min(ahead[-1][s] for s in COMPLETE if s in ahead[-1])
    rest = {s: 0 for s in COMPLETE}
    behind = [rest]
    for b in reversed(blocks):
        rest = {}
        for (f, t), (cost, _) in b.items():
            if t in behind[-1]:
                rest[f] = min(rest.get(f, behind[-1][t] + cost), behind[-1][t] + cost)
        behind.append(rest)
    behind.reverse()
    root = (None, NOTHING, "")
    cells: dict[int, tuple] = {NOTHING: root}
    for number, b in enumerate(blocks):
        grown: dict[int, tuple] = {}
        for (f, t), (cost, audit) in b.items():
            if f in cells and t in behind[number + 1] and ahead[number][f] + cost + behind[number + 1][t] == total:
                chain = (cells[f], f, audit)
                if t not in grown or _precedes(chain, grown[t]):
                    grown[t] = chain
        cells = grown
    ends = [cells[s] for s in COMPLETE if s in cells and ahead[-1][s] == total]
    chain = ends[0] if len(ends) == 1 or _precedes(ends[0], ends[1]) else ends[1]
    out = []
    while chain is not root:
        out.append((chain[1], chain[2]))
        chain = chain[0]
    return total, out[::-1]
