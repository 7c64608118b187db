"""Groups of sorted rows inside a task, without a call of Spark for each group."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], column: int,
           most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of about ``most_bytes`` bytes of the text in ``column``, one
    row at least; so what a task holds follows neither the batch nor the table."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        at = 0
        while at < len(batch):
            to = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
            to = min(max(to, at + 1), len(batch))
            yield batch.slice(at, to - at)
            at = to


def runs(parts: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of equal key, a group at a time. Each part is a tuple of arrays with the
    keys first; rows come in order of the key, and a group may lie in several parts."""
    held = None
    for part in parts:
        if not len(part[0]):
            continue
        if held is not None:
            part = tuple(np.concatenate(pair) for pair in zip(held, part))
        cuts = np.flatnonzero(part[0][1:] != part[0][:-1]) + 1
        start = 0
        for end in cuts:
            yield tuple(array[start:end] for array in part)
            start = end
        held = tuple(array[start:] for array in part)
    if held is not None:
        yield held


def roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the smallest place that each place can reach."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        low = np.minimum(low, label)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low
