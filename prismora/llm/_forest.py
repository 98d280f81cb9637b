"""Connected nodes of a task's own links."""

from __future__ import annotations

import numpy as np

_FLUSH = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least reachable node of each of n nodes over the edges a-b."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        differ = a != b
        a, b = a[differ], b[differ]
    return root


class Forest:
    """The least reachable node of each of n nodes, over edges that come some at a time and aren't held."""

    def __init__(self, n: int):
        self._root, self._held, self._size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self._root[a], self._root[b]
        differ = a != b
        self._held.append((a[differ], b[differ]))
        self._size += int(differ.sum())
        if self._size >= _FLUSH:
            self.roots()

    def roots(self) -> np.ndarray:
        if self._size:
            a, b = (np.concatenate(x) for x in zip(*self._held))
            self._root = forest(self._root[a], self._root[b], len(self._root))[self._root]
        self._held, self._size = [], 0
        return self._root


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links than nodes that connect what the links u-v do: each node with the least it reaches."""
    nodes, back = np.unique(np.r_[u, v], return_inverse=True)
    root = forest(back[: len(u)], back[len(u) :], len(nodes))
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]
