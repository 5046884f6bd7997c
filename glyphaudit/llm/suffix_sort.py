"""Deep-shallow sorting of byte strings.

Shallow: multikey quicksort with 8-byte characters; a round parts all groups of equal prefix by their next character at once, groups of
one are done. Deep: groups still together after ``SHALLOW`` characters share a long prefix; each is ordered by a blind trie, whose nodes
hold only the place of the branching byte: a string descends unread, is compared once with the leaf it reaches, and is put in where they
first differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3


def shallow(words: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place in the order) by group and the first ``depth`` columns of ``words``."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    for d in range(depth):
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        alone = first & np.concatenate([first[1:], [True]]) if len(group) else first
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        key = words[order[open_], d]
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, g = key[by], group[open_]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        starts = first.copy()
        starts[open_] |= new
        group = np.cumsum(starts)
    return order, group


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    low, high = start, end
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes], depth: int) -> list[int]:
    """Order of strings that share their first ``depth`` bytes; a prefix comes first, equal strings in given order."""
    root: list = [-1, [0]]  # a leaf is [-1, members]; an inner node is [place, {byte or -1 at the end: child}]
    for i in range(1, len(strings)):
        s = strings[i]
        node, path = root, []
        while node[0] >= 0:
            at = node[0]
            child = node[1].get(s[at] if at < len(s) else -1)
            path.append(node)
            node = child or next(iter(node[1].values()))
        other = strings[node[1][0]]
        same = common(s, other, depth)
        if same == len(s) == len(other):
            node[1].append(i)
            continue
        mine, its = (x[same] if same < len(x) else -1 for x in (s, other))
        parent = None
        for inner in path:
            if inner[0] >= same:
                break
            parent = inner
        else:
            inner = node
        if inner[0] == same:
            inner[1][mine] = [-1, [i]]
            continue
        fresh = [same, {its: inner, mine: [-1, [i]]}]
        if parent is None:
            root = fresh
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before; -1 at the first of a group) of zero-padded byte rows within groups."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = -(-width // 8) * 8
    filled = np.zeros((n, wide), np.uint8)
    filled[:, :width] = rows
    order, part = shallow(filled.view(">u8").astype(np.uint64), group, min(depth, wide // 8))
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(starts[:-1][np.diff(starts) > 1].tolist(), starts[1:][np.diff(starts) > 1].tolist()):
        members = order[a:b]
        # a padded string may be shorter than the shallow depth: then compare from the start
        known = min(8 * depth, int(lengths[members].min()))
        sorted_ = blind_trie([rows[m, :lengths[m]].tobytes() for m in members.tolist()], known)
        order[a:b] = members[sorted_]
    above, below = rows[order[:-1]], rows[order[1:]]
    differs = above != below
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    same = np.minimum(same, np.minimum(lengths[order[:-1]], lengths[order[1:]]))
    same[group[order[:-1]] != group[order[1:]]] = -1
    return order, np.concatenate([[-1], same])
