"""Sorting contexts of anchors, with the longest common prefix of each with the one before.

Two orders are offered: deep-shallow sorting (a multikey quicksort to a shallow depth,
then blind tries for groups whose common prefix is longer), and prefix-partitioned
suffix trees (groups split by prefixes as long as it takes to fit a size, then a tree
for each group). Both give the order of the rows within their group and the prefix
lengths: where two neighbours part, that is the depth of the inner node they meet in.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct texts and the common prefix of each with the one before.

    Inner nodes hold only a depth and the branching symbols. A text goes down by its
    own symbols, blindly, to some leaf; one comparison with that leaf gives the depth
    at which it branches off. The symbol of a text that ends is -1.
    """
    if len(texts) == 1:
        return [0], [0]
    symbol = lambda t, d: t[d] if d < len(t) else -1
    root: list | int = 0
    for i in range(1, len(texts)):
        t, node = texts[i], root
        while isinstance(node, list):
            s = symbol(t, node[0])
            node = node[1][s] if s in node[1] else next(iter(node[1].values()))
        depth = common_prefix(t, texts[node])
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][symbol(t, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][symbol(t, depth)] = i
            continue
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        new = [depth, {symbol(texts[leaf], depth): node, symbol(t, depth): i}]
        if above is None:
            root = new
        else:
            above[1][symbol(t, above[0])] = new
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, list):
            children = [node[1][s] for s in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], shared)]
        else:
            order.append(node)
            lcp.append(shared)
    return order, lcp


#: The quicksort goes so many bytes beyond what a group is known to share; blind tries order what still ties.
SHALLOW = 16
WORD = 8


def multikey_quicksort(group: np.ndarray, texts: list[bytes], depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (group, `shallow` bytes from depth on), and where rows that tie begin; group is sorted already.

    The characters are words of eight bytes (zero beyond the end of a text, which leaves
    a tie). Each round takes every segment that is not done, its middle row's word as the
    pivot, and parts it into less, equal and greater; the equal part goes on one word
    deeper, until it is `shallow` bytes deep. All segments are partitioned at once.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(WORD), np.uint8)
    place = np.arange(WORD)

    def word(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        spot = np.minimum(start[rows] + at, len(data) - WORD)
        found = np.where(at[:, None] + place < size[rows][:, None], data[spot[:, None] + place], 0)
        return found.astype(np.uint8).view(">u8").ravel().astype(np.uint64)

    order = np.arange(n)
    head = np.ones(n, bool)  # of segments
    head[1:] = group[1:] != group[:-1]
    deep = np.full(n, depth, np.int64)  # of the segment at a place
    while True:
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, n))
        open_ = (sizes > 1) & (deep[first] < depth + shallow)
        if not open_.any():
            return order, first
        first, sizes = first[open_], sizes[open_]
        segment = np.repeat(np.arange(len(first)), sizes)
        spots = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        rows = order[spots]
        words = word(rows, deep[spots])
        pivot = words[np.concatenate([[0], np.cumsum(sizes)[:-1]]) + sizes // 2][segment]
        side = (words > pivot).astype(np.int8) - (words < pivot)
        by = np.argsort(segment * 3 + side + 1, kind="stable")
        order[spots] = rows[by]
        side = side[by]
        head[spots[1:]] |= (side[1:] != side[:-1]) & (segment[1:] == segment[:-1])
        deep[spots] += np.where(side == 0, WORD, 0)


def deep_shallow(group: np.ndarray, texts: list[bytes], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by (group, text) and prefix lengths; group is sorted already.

    Rows of a group are known to share their first `shared` bytes, so the quicksort
    begins there (at 0 if a collision of hashes put others together). Rows that tie at
    its depth go through a blind trie, which compares whole texts.
    """
    n = len(texts)
    first, head_text = None, b""
    for g, t in zip(group.tolist(), texts):
        if g != first:
            first, head_text = g, t[:shared]
        elif t[:shared] != head_text:
            shared = 0
            break
    order, head = multikey_quicksort(group, texts, shared)
    same_group = np.concatenate([[False], group[order[1:]] == group[order[:-1]]])
    lcp = np.zeros(n, np.int64)
    out = order.copy()
    ends = np.append(head[1:], n)
    for lo, hi in zip(head.tolist(), ends.tolist()):
        if hi - lo > 1:
            rows = order[lo:hi].tolist()
            distinct: dict[bytes, list[int]] = {}
            for r in rows:
                distinct.setdefault(texts[r], []).append(r)
            keys = list(distinct)
            ranked, prefix = blind_trie(keys)
            at = lo
            for j, s in zip(ranked, prefix):
                same = distinct[keys[j]]
                out[at : at + len(same)] = same
                lcp[at] = s
                lcp[at + 1 : at + len(same)] = len(keys[j])
                at += len(same)
    for at in head[same_group[head]].tolist():
        lcp[at] = common_prefix(texts[out[at - 1]], texts[out[at]])
    return out, lcp


class _Node:
    __slots__ = ("depth", "leaf", "children")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, {}


def suffix_tree(texts: list[bytes], width: int, depth: int = 0) -> tuple[list[int], list[int]]:
    """Order and common prefixes (bytes) of distinct texts of width-byte symbols, from a compact tree.

    Edges are spans of a text that passes there; a text walks down edge by edge,
    splits the edge where it leaves it, and becomes a leaf.
    """
    symbol = lambda t, d: t[d : d + width]  # noqa: E731  empty at the end, which sorts first
    root = _Node(depth, 0)
    for i, t in enumerate(texts):
        node = root
        while True:
            s = symbol(t, node.depth)
            child = node.children.get(s)
            if child is None:
                node.children[s] = _Node(len(t), i)
                break
            end = min(child.depth, len(t))
            if child.depth <= len(t) and texts[child.leaf][node.depth : end] == t[node.depth : end] and child.children:
                node = child
                continue
            other = texts[child.leaf]
            shared = node.depth + common_prefix(other[node.depth : child.depth], t[node.depth :]) // width * width
            if shared == child.depth and child.children:
                node = child
                continue
            middle = _Node(shared, child.leaf)
            middle.children[symbol(other, shared)] = child
            node.children[s] = middle
            if symbol(t, shared) in middle.children:  # the end of both: not of distinct texts
                break
            middle.children[symbol(t, shared)] = _Node(len(t), i)
            break
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node.children:
            children = [node.children[s] for s in sorted(node.children)]
            stack += [(c, node.depth) for c in reversed(children[1:])] + [(children[0], shared)]
        else:
            order.append(node.leaf)
            lcp.append(shared)
    return order, lcp


def prefix_trees(group: np.ndarray, texts: list[bytes], width: int, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by (group, text) and prefix lengths in bytes; group is sorted already.

    A group of more than `most` distinct texts is split by a prefix longer by one
    symbol, again and again, until each part fits; each part is one suffix tree.
    """
    out: list[int] = []
    lcp: list[int] = []

    def place(items: list[tuple[bytes, list[int]]]) -> None:
        parts = [(items, 0, 0)]  # rows, depth of their common prefix, prefix shared with the rows before
        while parts:
            items, depth, shared = parts.pop()
            if len(items) > most:
                symbol = lambda x: x[0][depth : depth + width]  # noqa: E731, B023
                items.sort(key=symbol)
                found = [list(part) for _, part in groupby(items, key=symbol)]
                longer = [(part, depth + width if len(part[0][0]) > depth else depth, depth) for part in found]
                longer[0] = (*longer[0][:2], shared)
                parts += reversed(longer)
                continue
            keys = [k for k, _ in items]
            ranked, prefix = suffix_tree(keys, width, depth) if len(keys) > 1 else ([0], [shared])
            prefix[0] = shared
            for j, s in zip(ranked, prefix):
                rows = items[j][1]
                out.extend(rows)
                lcp.append(s)
                lcp.extend([len(keys[j])] * (len(rows) - 1))

    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(group)).tolist()):
        distinct: dict[bytes, list[int]] = {}
        for r in range(lo, hi):
            distinct.setdefault(texts[r], []).append(r)
        place(list(distinct.items()))
    return np.array(out, np.int64), np.array(lcp, np.int64)
