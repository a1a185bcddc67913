"""Links within one block of comparisons, reduced to what keeps its rows connected."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union of nodes 0 .. n-1; ``join`` keeps only the links that connect something new."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, node: int, partners: np.ndarray) -> None:
        labels, first = np.unique(self.label[partners], return_index=True)
        own = self.label[node]
        new = labels != own
        if new.any():
            self.links += [(node, int(p)) for p in partners[first[new]]]
            self.label[np.isin(self.label, labels[new])] = own
