"""An adaptive radix tree over byte strings: resizable node layouts and path compression."""

from __future__ import annotations

from bisect import bisect_left


class Few:
    """Up to 4, later 16, children: sorted key bytes beside a list of children."""

    __slots__ = ("keys", "kids", "room")

    def __init__(self, room: int = 4):
        self.keys, self.kids, self.room = bytearray(), [], room

    def get(self, key: int):
        i = self.keys.find(key)
        return self.kids[i] if i >= 0 else None

    def put(self, key: int, kid):
        """The layout that holds the child as well: this one, or a larger one."""
        i = bisect_left(self.keys, key)
        if i < len(self.keys) and self.keys[i] == key:
            self.kids[i] = kid
            return self
        if len(self.keys) == self.room:
            larger = Few(16) if self.room == 4 else Indexed()
            for k, old in self.items():
                larger = larger.put(k, old)
            return larger.put(key, kid)
        self.keys.insert(i, key)
        self.kids.insert(i, kid)
        return self

    def items(self):
        return zip(self.keys, self.kids, strict=True)


class Indexed:
    """Up to 48 children: a slot number for each of the 256 bytes."""

    __slots__ = ("slots", "kids")
    NONE = 255

    def __init__(self):
        self.slots, self.kids = bytearray([self.NONE] * 256), []

    def get(self, key: int):
        slot = self.slots[key]
        return None if slot == self.NONE else self.kids[slot]

    def put(self, key: int, kid):
        slot = self.slots[key]
        if slot != self.NONE:
            self.kids[slot] = kid
        elif len(self.kids) == 48:
            larger = Full()
            for k, old in self.items():
                larger.put(k, old)
            return larger.put(key, kid)
        else:
            self.slots[key] = len(self.kids)
            self.kids.append(kid)
        return self

    def items(self):
        return ((k, self.kids[s]) for k, s in enumerate(self.slots) if s != self.NONE)


class Full:
    """A child, or none, for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, key: int):
        return self.kids[key]

    def put(self, key: int, kid):
        self.kids[key] = kid
        return self

    def items(self):
        return ((k, kid) for k, kid in enumerate(self.kids) if kid is not None)


class Node:
    """``prefix``: the bytes that all below share, after the one that leads here. ``value``:
    what was put under the key that ends here."""

    __slots__ = ("prefix", "value", "kids")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.kids = prefix, value, Few()


def common(a: bytes, b: bytes) -> int:
    """How many first bytes two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # they share ``low`` bytes and differ within ``high``
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    def __init__(self):
        self.root = None

    def put(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        above, lead, node, at = None, 0, self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                shared = common(prefix, key[at : at + len(prefix)])
                split = Node(prefix[:shared])
                node.prefix = prefix[shared + 1 :]
                split.kids = split.kids.put(prefix[shared], node)
                if above is None:
                    self.root = split
                else:
                    above.kids = above.kids.put(lead, split)
                node, prefix = split, split.prefix
            at += len(prefix)
            if at == len(key):
                node.value = value
                return
            below = node.kids.get(key[at])
            if below is None:
                node.kids = node.kids.put(key[at], Node(key[at + 1 :], value))
                return
            above, lead, node, at = node, key[at], below, at + 1

    def upwards(self):
        """(node, bytes before it, bytes up to its end), children in order before their parent.

        The byte that leads to a node counts to the node; the root has -1 bytes before it.
        """
        if self.root is None:
            return
        stack = [(self.root, -1, len(self.root.prefix), False)]
        while stack:
            node, begin, end, seen = stack.pop()
            if seen:
                yield node, begin, end
                continue
            stack.append((node, begin, end, True))
            below = [(kid, end, end + 1 + len(kid.prefix), False) for _, kid in node.kids.items()]
            stack.extend(reversed(below))
