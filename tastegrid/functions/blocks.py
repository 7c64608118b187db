"""Numpy helpers for one tile of vectors; they run inside Spark tasks.

A tile is a few thousand vectors per side. Its scores are computed in bands of
``BAND_ROWS`` x ``BAND_COLS`` and cut down before the next band, so a task never
holds the scores of a whole tile.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BAND_ROWS, BAND_COLS = 256, 4096
# Scores are rounded to this many decimals, so that equal vectors tie exactly
# wherever they fall in a product.
DECIMALS = 9
SLACK = 10.0 ** -DECIMALS
NO_ID = np.iinfo(np.int32).max


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """A list column with lists of one length as a double matrix."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths, or null: {lengths[:5]}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def bands(n: int, step: int) -> Iterator[slice]:
    for start in range(0, n, step):
        yield slice(start, min(start + step, n))


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the true cells, in the order of memory."""
    if not mask.flags.c_contiguous:
        columns, rows = cells(mask.T)
        return rows, columns
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Best:
    """The ``k`` best partners of each of ``n`` rows, over all bands offered.

    Bands must come in ascending order of partner id: a later partner then has to
    score higher than the last one kept, which settles ties towards small ids.
    """

    def __init__(self, n: int, k: int, above: float = -np.inf):
        self.scores = np.full((n, k), above)
        self.ids = np.full((n, k), NO_ID, dtype=np.int32)

    def offer(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        n, k = self.scores[rows].shape
        # A score has to be half a step above the last one kept to round to more.
        better = scores > self.scores[rows][:, -1:] + 0.4 * SLACK
        found = np.count_nonzero(better)
        if not found:
            return
        if found > 4 * n * k and scores.shape[1] > k:
            better &= self.among_best(scores, k)
        r, c = cells(better)
        self.offer_cells(rows.start + r, scores[r, c], ids[c])

    @staticmethod
    def among_best(scores: np.ndarray, k: int) -> np.ndarray:
        """Cells that can be among the ``k`` best of their row, partner ids ascending.

        Where equal vectors tie by the thousand, only the first ``k`` ties stay.
        """
        kth = np.partition(scores, -k, axis=1)[:, -k, None]
        near = scores >= kth - SLACK
        if np.count_nonzero(near) <= 4 * near.shape[0] * k:
            return near
        rounded, kth = np.round(scores, DECIMALS), np.round(kth, DECIMALS)
        ties = rounded == kth
        return (rounded > kth) | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k))

    def offer_cells(self, row: np.ndarray, score: np.ndarray, partner: np.ndarray) -> None:
        """Offer single cells, in any order of partners: equal scores are settled by id."""
        k = self.scores.shape[1]
        held, row = np.unique(row, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(held)), k), row])
        score = np.concatenate([self.scores[held].ravel(), np.round(score, DECIMALS)])
        partner = np.concatenate([self.ids[held].ravel(), partner])
        order = np.lexsort((partner, -score, row))
        starts = np.searchsorted(row[order], np.arange(len(held)))
        first = order[(starts[:, None] + np.arange(k)).ravel()]
        self.scores[held] = score[first].reshape(-1, k)
        self.ids[held] = partner[first].reshape(-1, k)

    def rows(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own id, partner id, score) of everything kept."""
        kept = self.ids != NO_ID
        r, _ = np.nonzero(kept)
        return own[r], self.ids[kept], self.scores[kept]
