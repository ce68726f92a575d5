"""Exact nearest neighbours by cosine over an inverted index with block maxima.

Examples are ordered (similar ones next to each other) and cut into blocks. Each term has a cell for every
block that holds it, with its postings there and the largest weight among them. The sum of a query's weights
times these maxima bounds what any example of a block can score; blocks are opened in order of their bounds,
more at a time as it goes on, until no bound exceeds the k-th best score found, so the result is that of
comparing with all examples. Only cells that hold something take room. Terms that more than ``COMMON`` of the
examples have would open every block; they are a dense matrix instead, multiplied for many queries at once, and
the largest such score in a block is a part of its bound.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
COMMON = 0.05


Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of all runs of length ``n``, one after another."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


class BlockMaxIndex:
    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK) -> None:
        """``vectors``: unit vectors as term to weight, or terms and weights, none empty."""
        pairs = [(np.array(list(v), np.int64), np.array(list(v.values()))) if isinstance(v, dict) else v for v in vectors]
        lead = [[(int(t[j]), float(w[j])) for j in np.argsort(-w, kind="stable")[:3]] for t, w in pairs]
        self.order = np.array(sorted(range(len(pairs)), key=lambda i: (lead[i], i)), np.int64)
        self.block, self.n = block, len(pairs)
        self.n_blocks = max(1, -(-self.n // block))
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        place = np.repeat(place, [len(t) for t, _ in pairs])
        terms = np.concatenate([t for t, _ in pairs])
        weight = np.concatenate([w for _, w in pairs])
        self.common = np.full(n_terms, -1)
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) > COMMON * self.n)
        self.common[often] = np.arange(len(often))
        dense = self.common[terms] >= 0
        self.dense = np.zeros((len(often), self.n_blocks * block))
        self.dense[self.common[terms[dense]], place[dense]] = weight[dense]
        terms, place, weight = terms[~dense], place[~dense], weight[~dense]
        sort = np.lexsort((place, terms))
        key = (terms * self.n_blocks + place // block)[sort]
        self.slot = (place % block)[sort].astype(np.int32)
        self.weight = weight[sort]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.block_of = (key[start] % self.n_blocks).astype(np.int32)
        self.edge = np.searchsorted(key[start] // self.n_blocks, np.arange(n_terms + 1))
        self.first = np.append(start, len(key))

    def common_scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms of each query (row) score in every place."""
        asked = np.zeros((len(queries), len(self.dense)))
        for row, (terms, weights) in zip(asked, queries):
            at = self.common[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return asked @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples with a positive similarity; ties to the earlier example. ``base``: its common scores."""
        base = (self.common_scores([(terms, weights)])[0] if base is None else base).reshape(self.n_blocks, self.block)
        rare = self.common[terms] < 0
        terms, weights = terms[rare], weights[rare]
        n = self.edge[terms + 1] - self.edge[terms]
        cells, weights = _spans(self.edge[terms], n), np.repeat(weights, n)
        blocks = self.block_of[cells]
        bounds = np.bincount(blocks, weights * self.most[cells], self.n_blocks) + base.max(axis=1)
        sort = np.argsort(blocks, kind="stable")
        cells, weights = cells[sort], weights[sort]
        cut = np.searchsorted(blocks[sort], np.arange(self.n_blocks + 1))
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        todo, at, step = np.argsort(-bounds, kind="stable"), 0, 1
        while at < len(todo):
            some = todo[at:at + step]
            some = some[(bounds[some] > 0) & ((len(best_s) < k) | (bounds[some] >= (best_s[-1] if len(best_s) else 0) - 1e-12))]
            if not len(some):
                break
            held = cut[some + 1] - cut[some]
            mine = _spans(cut[some], held)
            n = self.first[cells[mine] + 1] - self.first[cells[mine]]
            span = _spans(self.first[cells[mine]], n)
            slot = self.slot[span] + np.repeat(np.repeat(np.arange(len(some)) * self.block, held), n)
            scores = np.bincount(slot, self.weight[span] * np.repeat(weights[mine], n), len(some) * self.block) + base[some].reshape(-1)
            hit = np.flatnonzero(scores > 0)
            ids = np.concatenate((best_i, self.order[some[hit // self.block] * self.block + hit % self.block]))
            sims = np.concatenate((best_s, scores[hit]))
            keep = np.lexsort((ids, -sims.round(12)))[:k]
            best_i, best_s = ids[keep], sims[keep]
            at, step = at + step, 2 * step
        return best_i, best_s
