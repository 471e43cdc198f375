"""Grouped blocks of sorted partitions, and linked components inside one block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition sorted by integer ``keys``, each as one table; a group may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(int(c[start]) for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)


class Links:
    """Components among ``n`` rows of a block; the links arrive as arrays and are not kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        root = self.root
        while len(left):
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """One link from every row that is not a root to its root."""
        rows = np.flatnonzero(self.root != np.arange(len(self.root)))
        return rows, self.root[rows]
