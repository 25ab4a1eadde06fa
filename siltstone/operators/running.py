"""The best rows of many lists at once, kept while a task goes through its batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """Of every query and group the ``k`` rows of the largest rank value, ties to the smaller id, out of all batches so far.

    A task that ends with this sends on ``k`` rows a query and group, however many it read.
    """

    def __init__(self, k: int, queries: int):
        self.k, self.queries = k, queries
        self.groups: dict[str | None, int] = {}
        self.least = np.full((0, queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        self.pending = self.standing = 0

    def add(self, group: str | None, corpora: pa.Array, ids: pa.Array, ranked: np.ndarray, shown: np.ndarray) -> None:
        """Rows of one group: ``ranked`` (rows, queries) is what they are ranked by, -inf for no hit, ``shown`` what is returned."""
        g = self.groups.setdefault(group, len(self.groups))
        if g == len(self.least):
            self.least = np.vstack([self.least, np.full((1, self.queries), -np.inf)])
        taken = (ranked >= self.least[g]) & (ranked > -np.inf)
        if len(ranked) > self.k and taken.sum() > self.k:
            order = pc.sort_indices(ids).to_numpy()  # ties go to the smaller id
            corpora, ids, ranked, shown, taken = corpora.take(pa.array(order)), ids.take(pa.array(order)), ranked[order], shown[order], taken[order]
            last = np.partition(ranked.T, len(ranked) - self.k, axis=1)[:, len(ranked) - self.k]
            above, equal = ranked > last, ranked == last
            taken &= above | (equal & (np.cumsum(equal, axis=0) <= self.k - above.sum(axis=0)))
            self.least[g] = np.maximum(self.least[g], last)
        query, row = np.nonzero(taken.T)
        if len(query):
            self.held.append((g * self.queries + query, ranked[row, query], shown[row, query], ids.take(pa.array(row)), corpora.take(pa.array(row))))
            self.pending += len(query)
        if self.pending > 100_000 + self.standing:
            self._cut()

    def _cut(self) -> None:
        if not self.held:
            return
        lists, ranked, shown = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        ids, corpora = (pa.concat_arrays([h[i] for h in self.held]) for i in (3, 4))
        table = pa.table({"list": lists, "ranked": ranked, "id": ids})
        order = pc.sort_indices(table, sort_keys=[("list", "ascending"), ("ranked", "descending"), ("id", "ascending")]).to_numpy()
        lists, ranked, shown = lists[order], ranked[order], shown[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        last = place == self.k - 1
        self.least[lists[last] // self.queries, lists[last] % self.queries] = np.maximum(self.least[lists[last] // self.queries, lists[last] % self.queries], ranked[last])
        kept = place < self.k
        self.held = [(lists[kept], ranked[kept], shown[kept], ids.take(pa.array(order[kept])), corpora.take(pa.array(order[kept])))]
        self.pending, self.standing = 0, int(kept.sum())

    def rows(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray] | None:
        """(query, corpus, id, shown) of what was kept."""
        self._cut()
        if not self.held:
            return None
        lists, _, shown, ids, corpora = self.held[0]
        return lists % self.queries, corpora, ids, shown
