"""Edit distance between schema trees (problem 7).

A schema is an unordered tree of fields. Its edit scripts add, remove, rename,
retype and relabel fields and move subtrees; the script of least cost keeps
ancestors above descendants and matches the children of matched fields by a
minimum-cost assignment. What the assignment leaves over is then searched for
moves, the largest equal subtrees first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Kinds of values, as bits.
TEXT, NUMBER, TRUTH, OBJECT, LIST = 1, 2, 4, 8, 16
#: Costs. A field matched with another one (relabelled) costs as much as one removal and one addition, so it only pays where fields below it stay.
ADD, REMOVE, RENAME, RETYPE, RELABEL, MOVE = 1.0, 1.0, 0.5, 0.25, 2.0, 0.75
SEP = "\x1f"


@dataclass(eq=False)
class Node:
    """A field: its key, the kinds of its values, its rank among the names of its identity, and its fields by identity."""

    label: str
    kinds: int
    rank: int = 0
    children: dict[str, Node] = field(default_factory=dict)


@dataclass(frozen=True, order=True)
class Edit:
    """path names a field by identities; source, for a moved or relabelled one, where it was."""

    path: str
    kind: str
    source: str = ""


def tree(fields: list[tuple[str, int]], aliases: dict[str, tuple[str, int]], deep: bool = False) -> Node:
    """Schema tree of a file's (path, kinds). A top field's identity is its canonical name, or its own; with deep, so is that of nested ones. Of several keys of one canonical column the lowest rank stays."""
    root, at = Node("", OBJECT), {}
    for path, kinds in sorted(fields, key=lambda f: (f[0].count(SEP), f[0])):
        parent, _, name = path.rpartition(SEP)
        if parent and parent not in at:
            continue
        above = at[parent] if parent else root
        canonical, rank = aliases.get(name, (name, 0)) if deep or not parent else (name, 0)
        node = at[path] = Node(name, kinds, rank)
        other = above.children.get(canonical)
        if other is None or name in aliases and (other.label not in aliases or rank < other.rank):
            above.children[canonical] = node
    return root


def size(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        n += 1
        todo += todo.pop().children.values()
    return n


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the greatest total gain; gains are at least 0, and pairs without gain are left out. Shortest augmenting paths with potentials."""
    rows, columns = gain.shape
    if rows > columns:
        return sorted((r, c) for c, r in assignment(gain.T))
    cost = gain.max(initial=0) - gain
    u, v, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for r in range(rows):
        distance, back, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, last, reached = r, -1, [(r, 0.0)]
        least = 0.0
        while True:
            step = least + cost[row] - u[row] - v
            better = ~done & (step < distance)
            distance[better], back[better] = step[better], last
            last = int(np.where(done, np.inf, distance).argmin())
            least = distance[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
            reached.append((row, least))
        for i, d in reached:
            u[i] += least - d
        v[done] -= least - distance[done]
        while last >= 0:
            before = int(back[last])
            owner[last] = owner[before] if before >= 0 else r
            last = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0 and gain[r, c] > 0)


class Distance:
    """Least costs of pairs of fields and the matchings that give them. The fields of `top` itself are matched by identity where both sides have it: what is in both there is stated, not inferred."""

    def __init__(self, top: Node):
        self.top = top
        self.known: dict[tuple[int, int], tuple[float, list[tuple[str, str]]]] = {}

    def below(self, a: Node, b: Node) -> tuple[float, list[tuple[str, str]]]:
        """Cost of turning a's fields into b's, and which of them are matched."""
        key = (id(a), id(b))
        if key in self.known:
            return self.known[key]
        both = [n for n in a.children if n in b.children]
        plain = [n for n in both if a is self.top or not a.children[n].children and not b.children[n].children]  # no other match of two leaves is cheaper
        left, right = [n for n in a.children if n not in set(plain)], [n for n in b.children if n not in set(plain)]
        pairs = [(n, n) for n in plain]
        if left and right:
            gain = np.array([[self._gain(x, a.children[x], y, b.children[y]) for y in right] for x in left])
            pairs += [(left[i], right[j]) for i, j in assignment(gain)]
        cost = sum(self.match(x, a.children[x], y, b.children[y]) for x, y in pairs)
        cost += sum(REMOVE * size(a.children[n]) for n in set(left) - {x for x, _ in pairs}) + sum(ADD * size(b.children[n]) for n in set(right) - {y for _, y in pairs})
        self.known[key] = (cost, pairs)
        return self.known[key]

    def match(self, x: str, a: Node, y: str, b: Node) -> float:
        own = (RENAME if a.label != b.label else 0.0) if x == y else RELABEL
        return own + (RETYPE if a.kinds and b.kinds and a.kinds != b.kinds else 0.0) + (self.below(a, b)[0] if a.children or b.children else 0.0)

    def _gain(self, x: str, a: Node, y: str, b: Node) -> float:
        if x != y and not (a.children and b.children):
            return 0.0  # nothing stays below
        return max(0.0, REMOVE * size(a) + ADD * size(b) - self.match(x, a, y, b))


def shape(node: Node) -> tuple:
    """What makes two subtrees equal, their own identity left to the caller."""
    return (node.label, node.kinds, tuple(sorted((n, shape(c)) for n, c in node.children.items())))


def identity_only(node: Node) -> tuple:
    """Leaves of one identity are equal, whatever their key and kinds; nothing else is."""
    return () if not node.children else (id(node),)


def _subtrees(path: str, node: Node):
    todo = [(path, node)]
    while todo:
        at, n = todo.pop()
        yield at, n
        todo += [(f"{at}{SEP}{name}", c) for name, c in n.children.items()]


def edit_script(old: Node, new: Node, alike=shape) -> tuple[float, list[Edit]]:
    """Cost and edits that turn one tree into the other.

    Kinds: added and removed (the top of a subtree), renamed, retyped, relabelled
    (matched with a field of another identity) and moved. Kinds of values differ
    only where both sides have non-null ones. `alike` tells which subtrees of one
    identity may move into each other's places.
    """
    distance, edits = Distance(old), []
    gone: list[tuple[str, Node]] = []
    come: list[tuple[str, Node]] = []
    cost = distance.below(old, new)[0]
    todo = [("", "", old, new)]
    while todo:
        was, at, a, b = todo.pop()
        join = lambda p, n: f"{p}{SEP}{n}" if p else n
        pairs = distance.below(a, b)[1]
        for x, y in pairs:
            m, n, path = a.children[x], b.children[y], join(at, y)
            if x != y:
                edits.append(Edit(path, "relabelled", join(was, x)))
            elif m.label != n.label:
                edits.append(Edit(path, "renamed"))
            if m.kinds and n.kinds and m.kinds != n.kinds and (x == y or a is not old):
                edits.append(Edit(path, "retyped"))
            todo.append((join(was, x), path, m, n))
        matched_a, matched_b = {x for x, _ in pairs}, {y for _, y in pairs}
        gone += [(join(was, n), c) for n, c in a.children.items() if n not in matched_a]
        come += [(join(at, n), c) for n, c in b.children.items() if n not in matched_b]
    # Moves: the largest equal subtrees first; of equals the one of lowest rank, then the nearest to the top.
    places: dict[tuple, list[tuple[str, Node]]] = {}
    for path, node in (s for p, n in gone for s in _subtrees(p, n)):
        places.setdefault((path.rpartition(SEP)[2], alike(node)), []).append((path, node))
    used_old, used_new = set(), set()
    within = lambda path, used: any(path == u or path.startswith(u + SEP) or u.startswith(path + SEP) for u in used)
    for path, node in sorted((s for p, n in come for s in _subtrees(p, n)), key=lambda s: (-size(s[1]), s[0])):
        if within(path, used_new):
            continue
        choices = sorted((n.rank, p.count(SEP), p) for p, n in places.get((path.rpartition(SEP)[2], alike(node)), []) if p.rpartition(SEP)[0] != path.rpartition(SEP)[0] and not within(p, used_old))
        if choices:
            source = choices[0][2]
            used_old.add(source), used_new.add(path)
            edits.append(Edit(path, "moved", source))
            cost += MOVE - size(node) * (ADD + REMOVE)
    edits += [Edit(p, "removed") for p, _ in gone if p not in used_old]
    edits += [Edit(p, "added") for p, _ in come if p not in used_new]
    return cost, sorted(edits)
