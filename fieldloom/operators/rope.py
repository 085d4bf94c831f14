"""A list of many changes: blocks of elements under a Fenwick tree of their sizes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Rope:
    """Places are found by descent in the tree; an insertion or deletion moves at most a block's elements. Out of range is IndexError."""

    SIZE = 512

    def __init__(self, items: Iterable):
        items = list(items)
        self.blocks = [items[i : i + self.SIZE] for i in range(0, len(items), self.SIZE)] or [[]]
        self.length = len(items)
        self._index()

    def _index(self) -> None:
        n = len(self.blocks)
        self.tree = [0, *map(len, self.blocks)]
        for i in range(1, n + 1):
            up = i + (i & -i)
            if up <= n:
                self.tree[up] += self.tree[i]
        self.top = 1 << (n.bit_length() - 1)

    def _find(self, at: int) -> tuple[int, int]:
        """Block and place in it; the end is behind the last block's last element."""
        k, step = 0, self.top
        while step:
            if k + step < len(self.tree) and self.tree[k + step] <= at:
                k += step
                at -= self.tree[k]
            step >>= 1
        return (k, at) if k < len(self.blocks) else (k - 1, len(self.blocks[-1]))

    def _grow(self, k: int, by: int) -> None:
        self.length += by
        k += 1
        while k < len(self.tree):
            self.tree[k] += by
            k += k & -k

    def __len__(self) -> int:
        return self.length

    def __iter__(self) -> Iterator:
        for b in self.blocks:
            yield from b

    def insert(self, at: int, value) -> None:
        if not 0 <= at <= self.length:
            raise IndexError("no such position")
        k, i = self._find(at)
        self.blocks[k].insert(i, value)
        self._grow(k, 1)
        if len(self.blocks[k]) > 2 * self.SIZE:
            self.blocks[k : k + 1] = [self.blocks[k][: self.SIZE], self.blocks[k][self.SIZE :]]
            self._index()

    def _place(self, at: int) -> tuple[int, int]:
        if not 0 <= at < self.length:
            raise IndexError("no such position")
        return self._find(at)

    def delete(self, at: int) -> None:
        k, i = self._place(at)
        del self.blocks[k][i]
        self._grow(k, -1)

    def set(self, at: int, value) -> None:
        k, i = self._place(at)
        self.blocks[k][i] = value
