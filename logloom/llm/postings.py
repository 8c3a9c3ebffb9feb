"""Inverted indexes with block maxima: all entries above a threshold, or the nearest ones.

Entries are numbered so that like ones are near each other, and `BLOCK` consecutive
numbers form a block, the same for every term. A term's list holds its largest weight in
each block it occurs in. Block-max WAND is evaluated block by block: the query terms'
maxima are added up per block, blocks whose sum stays below the threshold are skipped
whole, and only the lists' entries in the blocks left are scored.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8
#: Against rounding in sums taken in another order.
SLACK = 1e-9
#: Bounds (of groups and blocks) that are held at once.
BOUNDS = 1 << 20


def _gather(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    return np.repeat(starts - offsets, sizes) + np.arange(int(sizes.sum()))


class Postings:
    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int, block: int = BLOCK):
        order = np.lexsort((entries, terms))
        terms, self.entries, self.weights = terms[order], entries[order], weights[order].astype(np.float64)
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        self.block, self.n_blocks, self.n_entries = block, -(-n_entries // block), n_entries
        place = terms * max(1, self.n_blocks) + self.entries // block
        cells, first = np.unique(place, return_index=True)
        self.cells = cells % max(1, self.n_blocks)
        self.maxima = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.cell_starts = np.searchsorted(cells // max(1, self.n_blocks), np.arange(n_terms + 1))
        self.cell_entries = np.append(first, len(terms))
        #: Largest weight of each term in all entries.
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, terms, self.weights)

    def bounds(self, terms: np.ndarray, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Per block an upper bound of its entries' scores; the cells that it was added up from."""
        starts, ends = self.cell_starts[terms], self.cell_starts[terms + 1]
        cells = _gather(starts, ends)
        by = None if query is None else np.repeat(query, ends - starts)
        maxima = self.maxima[cells] if by is None else self.maxima[cells] * by
        return np.bincount(self.cells[cells], maxima, self.n_blocks), cells, by

    def scores(self, open_blocks: np.ndarray, cells: np.ndarray, by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) of the blocks marked in `open_blocks`."""
        use = open_blocks[self.cells[cells]]
        cells = cells[use]
        starts, ends = self.cell_entries[cells], self.cell_entries[cells + 1]
        at = _gather(starts, ends)
        weights = self.weights[at]
        if by is not None:
            weights = weights * np.repeat(by[use], ends - starts)
        if self.n_entries <= 16 * len(at):
            sums = np.bincount(self.entries[at], weights, self.n_entries)
            entries = np.flatnonzero(sums)
            return entries, sums[entries]
        entries, inverse = np.unique(self.entries[at], return_inverse=True)
        return entries, np.bincount(inverse, weights, len(entries))

    def above_groups(self, groups: np.ndarray, terms: np.ndarray, n_groups: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, entry, score) of what above() finds for each group of terms.

        `groups` ascends, and has each of its terms once. Bounds of all groups and blocks are
        added up at once, BOUNDS of them at a time; lists are only read in the blocks left.
        """
        out = []
        step = max(1, BOUNDS // max(1, self.n_blocks))
        for low in range(0, n_groups, step):
            own = slice(*np.searchsorted(groups, [low, low + step]))
            few, n = terms[own], min(step, n_groups - low)
            starts, ends = self.cell_starts[few], self.cell_starts[few + 1]
            cells = _gather(starts, ends)
            place = np.repeat(groups[own] - low, ends - starts) * self.n_blocks + self.cells[cells]
            bounds = np.bincount(place, self.maxima[cells], n * self.n_blocks)
            use = bounds[place] >= least - SLACK
            cells, of = cells[use], place[use] // self.n_blocks
            starts, ends = self.cell_entries[cells], self.cell_entries[cells + 1]
            at = _gather(starts, ends)
            keys, inverse = np.unique(np.repeat(of, ends - starts) * self.n_entries + self.entries[at], return_inverse=True)
            scores = np.bincount(inverse, self.weights[at], len(keys))
            hit = scores >= least - SLACK
            out.append((keys[hit] // self.n_entries + low, keys[hit] % self.n_entries, scores[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def above(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Entries whose weights over `terms` (distinct) add up to `least` or more."""
        bounds, cells, by = self.bounds(terms)
        open_blocks = bounds >= least - SLACK
        if not open_blocks.any():
            return []
        entries, scores = self.scores(open_blocks, cells, by)
        hit = scores >= least - SLACK
        return list(zip(entries[hit].tolist(), scores[hit].tolist()))

    def nearest(self, terms: np.ndarray, query: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries of highest score whose `counts` add up to `k`, with all that tie with the last.

        Blocks are opened by descending bound, in growing numbers, until no block left can
        reach the score of the last entry kept.
        """
        bounds, cells, by = self.bounds(terms, query)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        entries, scores = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 16
        while at < len(order):
            few = order[at : at + step]
            open_blocks = np.zeros(self.n_blocks, bool)
            open_blocks[few] = True
            new, own = self.scores(open_blocks, cells, by)
            entries, scores = np.concatenate([entries, new]), np.concatenate([scores, own])
            at, step = at + step, step * 2
            keep = np.argsort(-scores, kind="stable")
            entries, scores = entries[keep], scores[keep]
            full = np.searchsorted(np.cumsum(counts[entries]), k)
            if full < len(entries):
                last = scores[full] - SLACK
                n = int(np.searchsorted(-scores, -last, side="right"))
                entries, scores = entries[:n], scores[:n]
                if at < len(order) and bounds[order[at]] < last:
                    break
        return entries, scores


class HeadedPostings:
    """An index for nearest(), whose longest lists, the heads, are kept as blocks of a table.

    Terms with a weight in at least a `share` of the entries are heads. The other, short
    lists are read whole, which gives each entry's sum over them; a block's bound is the
    largest such sum in it and what its maxima of the heads can add.
    """

    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int, block: int = BLOCK, share: float = 0.1):
        self.block, self.n_blocks = block, -(-n_entries // block)
        heads = np.flatnonzero(np.bincount(terms, minlength=n_terms) >= max(1.0, share * n_entries))
        #: Place of each term among the heads, or -1.
        self.place = np.full(n_terms, -1, np.int64)
        self.place[heads] = np.arange(len(heads))
        own = self.place[terms] >= 0
        table = np.zeros((self.n_blocks * block, len(heads)))
        table[entries[own], self.place[terms[own]]] = weights[own]
        self.table = table.reshape(self.n_blocks, block, len(heads))
        self.maxima = self.table.max(axis=1) if self.n_blocks else np.zeros((0, len(heads)))
        order = np.flatnonzero(~own)[np.argsort(terms[~own], kind="stable")]
        self.entries, self.weights = entries[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, query: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of highest score above 0 (leaving out `but`), with all that tie with the last.

        Blocks are opened by descending bound, in growing numbers, until no block left can
        reach the score of the last entry kept.
        """
        place = self.place[terms]
        head = place >= 0
        asked = np.zeros(self.table.shape[2])
        asked[place[head]] = query[head]
        starts, ends = self.starts[terms[~head]], self.starts[terms[~head] + 1]
        at = _gather(starts, ends)
        sums = np.bincount(self.entries[at], self.weights[at] * np.repeat(query[~head], ends - starts), self.n_blocks * self.block)
        sums = sums.reshape(self.n_blocks, self.block).astype(np.float64)
        bounds = sums.max(axis=1, initial=0.0) + self.maxima @ asked
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        entries, scores = np.empty(0, np.int64), np.empty(0)
        at, step = 0, max(16, 4 * k // self.block)
        while at < len(order):
            few = order[at : at + step]
            own = (sums[few] + self.table[few] @ asked).ravel()
            new = (few[:, None] * self.block + np.arange(self.block)).ravel()
            keep = (own > 0) & (new != but)
            entries, scores = np.concatenate([entries, new[keep]]), np.concatenate([scores, own[keep]])
            at, step = at + step, step * 2
            if len(scores) >= k:
                last = np.partition(scores, -k)[-k] - SLACK
                keep = scores >= last
                entries, scores = entries[keep], scores[keep]
                if at < len(order) and bounds[order[at]] < last:
                    break
        keep = np.lexsort((entries, -scores))
        return entries[keep], scores[keep]
