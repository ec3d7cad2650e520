"""An immutable text as a balanced tree: leaves cache how many units and code points they hold, branches the sums.

Splitting at a rank (of units or of code points) and joining two trees take a number of steps in proportion to their
height; no text is copied but that of the one leaf that is cut.
"""

from __future__ import annotations

import re

#: A unit: separators and the word after them; what separators are left at the end are one unit.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_UNIT_ENDS = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
#: Code points of a leaf, or more where its last unit goes on.
LEAF = 1024


class Leaf:
    __slots__ = ("text", "units", "chars")
    height = 0

    def __init__(self, text: str, units: int) -> None:
        self.text, self.units, self.chars = text, units, len(text)


class Branch:
    __slots__ = ("left", "right", "units", "chars", "height")

    def __init__(self, left: Rope, right: Rope) -> None:
        self.left, self.right = left, right
        self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)


Rope = Leaf | Branch
EMPTY = Leaf("", 0)


def grown(text: str, leaf: int = LEAF) -> Rope:
    """The rope of a text; leaves end where units do."""
    row: list[Rope] = []
    begin = 0
    while begin < len(text):
        end = _UNIT_ENDS.search(text, begin + leaf)
        part = text[begin : end.start() if end else len(text)]
        row.append(Leaf(part, len(UNIT.findall(part))))
        begin += len(part)
    while len(row) > 1:
        row = [Branch(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def _level(left: Rope, right: Rope) -> Rope:
    """A branch of two ropes whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Branch(left.left, Branch(left.right, right))
        return Branch(Branch(left.left, left.right.left), Branch(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Branch(Branch(left, right.left), right.right)
        return Branch(Branch(left, right.left.left), Branch(right.left.right, right.right))
    return Branch(left, right)


def joined(left: Rope, right: Rope) -> Rope:
    if not left.chars or not right.chars:
        return left if left.chars else right
    if left.height > right.height + 1:
        return _level(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _level(joined(left, right.left), right.right)
    return Branch(left, right)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points, ``by="chars"``) and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if isinstance(rope, Leaf):
        return _cut(rope, rank, by)
    first = getattr(rope.left, by)
    if rank <= first:
        a, b = split(rope.left, rank, by)
        return a, joined(b, rope.right)
    a, b = split(rope.right, rank - first, by)
    return joined(rope.left, a), b


def _cut(leaf: Leaf, rank: int, by: str) -> tuple[Leaf, Leaf]:
    if by == "units":
        at = next(m.end() for k, m in enumerate(UNIT.finditer(leaf.text), 1) if k == rank)
        return Leaf(leaf.text[:at], rank), Leaf(leaf.text[at:], leaf.units - rank)
    head, tail = leaf.text[:rank], leaf.text[rank:]
    return Leaf(head, len(UNIT.findall(head))), Leaf(tail, len(UNIT.findall(tail)))


def text_of(rope: Rope) -> str:
    parts, ahead = [], [rope]
    while ahead:
        node = ahead.pop()
        if isinstance(node, Leaf):
            parts.append(node.text)
        else:
            ahead += (node.right, node.left)
    return "".join(parts)
