"""Deep-shallow sorting of suffixes in memory, and what it says of windows around an anchor. numpy and plain Python.

Suffixes are first sorted by a multikey quicksort whose characters are words of eight bytes, to a
shallow depth. Groups that are still equal have long common prefixes; each is put in order by a blind trie: a
Patricia trie that is searched without looking at skipped bytes, so that each suffix costs one comparison of texts.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at.
SHALLOW = 64


def multikey_quicksort(words: np.ndarray) -> list[np.ndarray]:
    """Row numbers of an (n, k) matrix of words in ascending order, rows that are equal in one array."""
    out: list[np.ndarray] = []
    stack = [(np.arange(len(words)), 0)] if len(words) else []
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1 or depth == words.shape[1]:
            out.append(rows)
            continue
        column = words[rows, depth]
        pivot = np.sort(column[[0, len(column) // 2, -1]])[1]
        below, above = column < pivot, column > pivot
        for part, d in ((rows[above], depth), (rows[~(below | above)], depth + 1), (rows[below], depth)):
            if len(part):
                stack.append((part, d))
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def blind_trie(texts: list[bytes]) -> list[int]:
    """Numbers of texts in ascending order; equal ones in their given order. A text's end is the branch -1."""
    root: _Node | None = None
    leaves: dict[int, list[int]] = {}

    def branch(t: bytes, depth: int) -> int:
        return t[depth] if depth < len(t) else -1

    for i, t in enumerate(texts):
        if root is None:
            root = _Node(len(t))
            root.children[-1] = i
            leaves[i] = [i]
            continue
        node: _Node | int = root
        while isinstance(node, _Node):  # blind: any leaf below shares as much with t as the trie can tell
            found = node.children.get(branch(t, node.depth))
            node = next(iter(node.children.values())) if found is None else found
        own = texts[node]
        depth = _common(t, own)
        if depth == len(t) == len(own):
            leaves[node].append(i)
            continue
        leaves[i] = [i]
        parent, key, at = None, None, root
        while isinstance(at, _Node) and at.depth < depth:
            parent, key = at, branch(t, at.depth)
            at = at.children[key]
        if isinstance(at, _Node) and at.depth == depth:
            at.children[branch(t, depth)] = i
            continue
        new = _Node(depth)
        new.children[branch(own, depth)], new.children[branch(t, depth)] = at, i
        if parent is None:
            root = new
        else:
            parent.children[key] = new
    out: list[int] = []
    stack: list[_Node | int] = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(node.children[k] for k in sorted(node.children, reverse=True))
        else:
            out.extend(leaves[node])
    return out


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts in ascending order, and the length of what each shares with the one before it (0 for the first)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    width = max(SHALLOW, -(-int(sizes.max()) // 8) * 8)
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
    words = np.ascontiguousarray(grid[:, :SHALLOW]).view(">u8").astype(np.uint64)
    order: list[np.ndarray] = []
    for group in multikey_quicksort(words):
        order.append(group if len(group) == 1 else group[blind_trie([texts[i] for i in group])])
    ranks = np.concatenate(order)
    shared = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        left, right = ranks[a - 1 : b - 1], ranks[a:b]
        differ = grid[left] != grid[right]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[a:b] = np.minimum(first, np.minimum(sizes[left], sizes[right]))
    return ranks, shared


def repeated_windows(groups: np.ndarray, texts: list[bytes], anchors: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each context, which of its windows another context of its group has too.

    Context i holds counts[i] windows of size bytes, the first at 0, the next at 1, and so on; its anchor is at anchors[i]. Windows
    are equal only where they lie alike around their anchors: those with d bytes before it are equal if the contexts agree on d bytes
    to the left and size - d to the right. Both come from the two suffix orders, outwards from the anchors.
    """
    n = len(texts)
    found = [np.zeros(c, bool) for c in counts.tolist()]
    if n < 2:
        return found

    def ordered(sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Groups one after the other, each in its suffix order; what neighbours share, -1 between groups."""
        ranks, shared = suffix_order(sides)
        place = np.empty(n, np.int64)
        place[ranks] = np.arange(n)
        by = np.lexsort((place, groups))
        # neighbours within a group share the least of what lies between them in the whole order
        p = place[by]
        least = np.full(n, -1, np.int64)
        same = np.flatnonzero(groups[by][1:] == groups[by][:-1]) + 1
        near = same[p[same] - p[same - 1] == 1]
        least[near] = shared[p[near]]
        for k in same[p[same] - p[same - 1] > 1].tolist():
            least[k] = int(shared[p[k - 1] + 1 : p[k] + 1].min())
        return by, least

    right, shared_right = ordered([t[a:] for t, a in zip(texts, anchors.tolist(), strict=True)])
    left, shared_left = ordered([t[:a][::-1] for t, a in zip(texts, anchors.tolist(), strict=True)])
    low = anchors - counts + 1  # the last window has so many bytes before the anchor
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(anchors.max()) + 1):
        valid = np.flatnonzero((low <= d) & (d <= anchors))
        if len(valid) < 2:
            continue
        class_right[right] = np.cumsum(shared_right < size - d)
        class_left[left] = np.cumsum(shared_left < d)
        both = class_right[valid] * (n + 1) + class_left[valid]
        _, inverse, number = np.unique(both, return_inverse=True, return_counts=True)
        for i in valid[number[inverse] > 1].tolist():
            found[i][anchors[i] - d] = True
    return found
