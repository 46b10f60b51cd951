"""Deep-shallow sorting of byte strings that are suffixes cut to a fixed width.

Multikey quicksort orders the strings by words of eight bytes down to a shallow depth.  Groups that are
still equal there have a long common prefix; a blind trie orders each of them, comparing a string in
full with one other only.  Both also give the common prefix of neighbours in the order.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which multikey quicksort goes.
SHALLOW = 32


def multikey_quicksort(words: np.ndarray, index: np.ndarray, depth: int, last: int) -> list[np.ndarray]:
    """Groups of index in ascending order of words[:, depth:last]; the strings of a group are equal there."""
    out, stack = [], [(index, depth)]
    while stack:
        idx, d = stack.pop()
        if len(idx) < 2 or d == last:
            out.append(idx)
            continue
        w = words[idx, d]
        some = np.sort(w[:: max(1, len(w) // 31)])
        pivot = some[len(some) // 2]
        less, more = w < pivot, w > pivot
        # what comes last in the order goes on the stack first
        if more.any():
            stack.append((idx[more], d))
        stack.append((idx[~less & ~more], d + 1))
        if less.any():
            stack.append((idx[less], d))
    return out


class BlindTrie:
    """Trie of strings of one width that stores branching depths and first bytes only."""

    def __init__(self, strings, width: int):
        self.strings, self.width = strings, width
        self.root = None  # a leaf is the list of its strings' numbers, an inner node is (depth, children)

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        s, node = self.strings[k], self.root
        while type(node) is tuple:  # blindly down to some leaf
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = self.strings[node[0]]
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        if not differ:
            node.append(k)
            return
        same = self.width - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while type(node) is tuple and node[0] < same:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == same:
            node[1][s[same]] = [k]
            return
        split = (same, {other[same]: node, s[same]: [k]})
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers of the strings in ascending order, and the common prefix of each with the one before."""
        order, common, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if type(node) is tuple:
                keys = sorted(node[1], reverse=True)
                stack.extend((node[1][c], before if c == keys[-1] else node[0]) for c in keys)
            else:
                order.extend(node)
                common.extend([before] + [self.width] * (len(node) - 1))
        return order, common


def deep_shallow(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (bytes, zero beyond ``lengths``) within each ``group``, and the
    common prefix of each with the one before (-1 at the start of a group).  ``skip``: a multiple of 8,
    bytes that all strings of a group share."""
    n, width = strings.shape
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    a, b = skip // 8, min(words.shape[1], (skip + SHALLOW) // 8)
    by_group = np.argsort(group, kind="stable")
    starts = np.concatenate([np.flatnonzero(np.diff(group[by_group], prepend=group[by_group[0]] - 1)), [n]])
    raw = [r.tobytes() for r in strings]
    order: list[np.ndarray] = []
    for x, y in zip(starts, starts[1:]):
        for part in multikey_quicksort(words, by_group[x:y], a, b):
            if len(part) > 2:
                trie = BlindTrie(raw, width)
                for k in part.tolist():
                    trie.add(k)
                part = np.array(trie.ordered()[0])
            elif len(part) == 2 and raw[part[1]] < raw[part[0]]:
                part = part[::-1]
            order.append(part)
    got = np.concatenate(order)
    differ = words[got[1:]] != words[got[:-1]]
    first = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    at = np.minimum(first, words.shape[1] - 1)
    x = words[got[1:], at] ^ words[got[:-1], at]
    same = np.where(first < words.shape[1], 8 * first + (x[:, None] < (np.uint64(1) << np.arange(56, 0, -8, dtype=np.uint64))).sum(1), width)
    common = np.full(n, -1, np.int64)
    common[1:] = np.where(group[got[1:]] == group[got[:-1]], np.minimum(same, np.minimum(lengths[got[1:]], lengths[got[:-1]])), -1)
    return got, common
