"""An adaptive radix tree over byte strings made of fixed-width items, and the item-aligned trie in it.

Inner nodes hold up to 4, 16, 48 or 256 children and grow from one layout to the next; a chain without
branches is one node with its bytes as ``prefix`` (path compression). Keys are whole items, so a key may
end at an inner node. :meth:`RadixTree.nodes` walks the tree as a trie of items: only byte depths that
are a multiple of the item width are trie nodes, several of them on one compressed path.
"""

from __future__ import annotations

from bisect import bisect_left


class Node:
    """Bytes of a path without branches, the keys that end after them, and children by next byte. The
    last six slots are sums over the subtree, set by a walk: ``below`` counts the trie nodes right below
    the last aligned depth, ``tops`` the first ones at or below this node's bytes."""

    __slots__ = ("prefix", "ends", "bytes", "index", "kids", "count", "least", "below", "tops", "leaves", "saved")

    def __init__(self, prefix: bytes):
        self.prefix, self.ends = prefix, []
        self.bytes = bytearray()  # sorted child bytes while there are at most 16
        self.index = None  # place by byte: 256 one-byte places (up to 48 children), or all children direct
        self.kids: list[Node | None] = []

    @property
    def layout(self) -> int:
        """Children that fit before the node grows."""
        if self.index is not None:
            return 48
        return 256 if len(self.kids) == 256 and not self.bytes else 4 if len(self.kids) <= 4 else 16

    def child(self, byte: int) -> Node | None:
        if self.index is not None:
            at = self.index[byte]
            return self.kids[at] if at < 48 else None
        if not self.bytes:
            return self.kids[byte] if self.kids else None
        at = bisect_left(self.bytes, byte)
        return self.kids[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, kid: Node) -> None:
        """Set the child of a byte, new or not; a full node takes the next layout first."""
        if self.index is not None:
            at = self.index[byte]
            if at < 48:
                self.kids[at] = kid
            elif len(self.kids) < 48:
                self.index[byte] = len(self.kids)
                self.kids.append(kid)
            else:
                wide: list[Node | None] = [None] * 256
                for b, at in enumerate(self.index):
                    if at < 48:
                        wide[b] = self.kids[at]
                wide[byte] = kid
                self.kids, self.index = wide, None
            return
        if not self.bytes and self.kids:
            self.kids[byte] = kid
            return
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
        elif len(self.bytes) < 16:
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)
        else:
            self.index = bytearray(b"\xff" * 256)
            for place, b in enumerate(self.bytes):
                self.index[b] = place
            self.index[byte] = len(self.kids)
            self.kids.append(kid)
            self.bytes = bytearray()

    def children(self):
        return (k for k in self.kids if k is not None)


def shared_bytes(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest prefix of ``a`` that ``b`` has from ``at`` on, by halving."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if b.startswith(a[:mid], at) else (low, mid - 1)
    return low


class RadixTree:
    """Keys (bytes, whole items of ``width``) with the caller's numbers of what holds them."""

    def __init__(self, width: int):
        self.width, self.root = width, Node(b"")

    def insert(self, key: bytes, holder: int) -> None:
        node, above, branch, at = self.root, None, 0, 0
        while True:
            same = shared_bytes(node.prefix, key, at)
            if same < len(node.prefix):  # the path forks inside this node
                fork = Node(node.prefix[:same])
                fork.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1:]
                if above is None:
                    self.root = fork
                else:
                    above.put(branch, fork)
                node = fork
            at += same
            if at == len(key):
                node.ends.append(holder)
                return
            above, branch = node, key[at]
            node = above.child(branch)
            at += 1
            if node is None:
                leaf = Node(key[at:])
                leaf.ends.append(holder)
                above.put(branch, leaf)
                return

    def _spans(self) -> list[tuple[Node, int, int]]:
        """(node, first, last): every node with its aligned byte depths, parents before children; first >
        last when it has none. The root's own depth 0 belongs to the root node."""
        out, stack = [], [(self.root, 0)]
        while stack:
            node, at = stack.pop()  # at: depth of the first byte depth that this node covers
            end = at + len(node.prefix)
            out.append((node, -(-at // self.width) * self.width, end // self.width * self.width))
            stack.extend((kid, end + 1) for kid in node.children())
        return out

    def nodes(self, holders: list, weights: list):
        """The trie's nodes, parents first, as tuples (own number, parent's number or -1, byte depth, least
        holder, members, children, leaves below or itself, saved, ends).

        ``holders[k]`` is what holder k sorts by, ``weights[k]`` the weights of its items; a node's weight
        is that of its last item, and ``saved`` sums (members - 1) * weight over its subtree."""
        spans = self._spans()
        width = self.width
        for node, first, last in reversed(spans):
            kids = list(node.children())
            node.count = len(node.ends) + sum(k.count for k in kids)
            node.least = min([*node.ends, *(k.least for k in kids)], key=holders.__getitem__)
            node.leaves = sum(k.leaves for k in kids) or 1
            node.saved = sum(k.saved for k in kids)
            node.below = sum(k.tops for k in kids)
            node.tops = 1 if first <= last else node.below
            if first <= last:
                own = weights[node.least]
                node.saved += (node.count - 1) * sum(own[x // width - 1] for x in range(max(first, width), last + 1, width))
        numbers, number = {id(self.root): -1}, 0
        for node, first, last in spans:
            above, saved, own = numbers.pop(id(node)), node.saved, weights[node.least]
            for x in range(first, last + 1, width):
                yield (number, above, x, node.least, node.count, 1 if x < last else node.below, node.leaves, saved,
                       node.ends if x == last else ())
                saved -= (node.count - 1) * own[x // width - 1] if x else 0
                above, number = number, number + 1
            for k in node.children():
                numbers[id(k)] = above
