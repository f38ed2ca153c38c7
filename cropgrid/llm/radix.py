"""An adaptive radix tree over byte strings: nodes of 4, 16, 48 or 256 places that grow as needed, with path compression.

A string may be the beginning of another one: what ends at a node is kept in the node.
"""

from __future__ import annotations

from collections.abc import Iterator

#: The places of the four layouts.
LAYOUTS = (4, 16, 48, 256)


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """`prefix` stands between the byte that led here and the node's own branches.

    With 4 and 16 places `index` holds the branches' bytes in order, beside `kids`; with 48 it holds for each of the 256 bytes the
    number of its kid, from 1; with 256 `kids` is looked up by the byte itself.
    """

    __slots__ = ("prefix", "ends", "places", "index", "kids")

    def __init__(self, prefix: bytes, ends: object = None):
        self.prefix, self.ends, self.places, self.index, self.kids = prefix, ends, LAYOUTS[0], bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.places <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.places == 48:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Set the kid of a byte, in the next larger layout if there is no place left."""
        if self.find(byte) is not None:
            if self.places <= 16:
                self.kids[self.index.find(byte)] = kid
            else:
                self.kids[byte if self.places == 256 else self.index[byte] - 1] = kid
            return
        if self.places < 256 and len(self.kids) == self.places:
            self.grow()
        if self.places <= 16:
            at = sum(b < byte for b in self.index)
            self.index.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.places == 48:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def grow(self) -> None:
        branches = list(self.branches())
        self.places = LAYOUTS[LAYOUTS.index(self.places) + 1]
        if self.places == 48:
            self.index, self.kids = bytearray(256), [kid for _, kid in branches]
            for number, (byte, _) in enumerate(branches, 1):
                self.index[byte] = number
        elif self.places == 256:
            self.index, self.kids = bytearray(), [None] * 256
            for byte, kid in branches:
                self.kids[byte] = kid

    def branches(self) -> Iterator[tuple[int, Node]]:
        """Bytes and kids, in order of the bytes."""
        if self.places <= 16:
            yield from zip(self.index, self.kids, strict=True)
        elif self.places == 48:
            yield from ((byte, self.kids[number - 1]) for byte, number in enumerate(self.index) if number)
        else:
            yield from ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, ends: object) -> None:
        node, above, at = self.root, None, 0
        while True:
            same = common(node.prefix, key[at:at + len(node.prefix)])
            if same < len(node.prefix):  # the path parts inside the compressed stretch
                upper = Node(node.prefix[:same])
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1:]
                if above is None:
                    self.root = upper
                else:
                    above.put(key[at - 1], upper)
                node = upper
            at += same
            if at == len(key):
                node.ends = ends
                return
            kid = node.find(key[at])
            if kid is None:
                node.put(key[at], Node(key[at + 1:], ends))
                return
            above, node, at = node, kid, at + 1
