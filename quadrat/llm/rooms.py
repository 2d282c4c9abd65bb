"""Remaining capacities of open bins in a balanced search tree (a treap with fixed priorities)."""

from __future__ import annotations

import random


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key, rank):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class Rooms:
    """Ordered (room, bin) pairs: insert, and take out the least room that holds a size."""

    def __init__(self) -> None:
        self._root: _Node | None = None
        self._random = random.Random(0)

    def push(self, room: float, b: int) -> None:
        node = _Node((room, b), self._random.random())
        low, high = _split(self._root, node.key)
        self._root = _merge(_merge(low, node), high)

    def pop_least(self, size: float) -> tuple[float, int] | None:
        """The tightest bin with at least ``size`` left (the lowest number among equals), or None."""
        at, key = self._root, None
        while at is not None:
            if at.key[0] >= size:
                key, at = at.key, at.left
            else:
                at = at.right
        if key is None:
            return None
        low, rest = _split(self._root, key)
        _, high = _split(rest, (key[0], key[1] + 1))
        self._root = _merge(low, high)
        return key


def _split(node, key):
    """Nodes below ``key``, and the others."""
    if node is None:
        return None, None
    if node.key < key:
        low, high = _split(node.right, key)
        node.right = low
        return node, high
    low, high = _split(node.left, key)
    node.left = high
    return low, node


def _merge(low, high):
    if low is None or high is None:
        return low or high
    if low.rank > high.rank:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high
