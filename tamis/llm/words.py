"""Words of whole texts as numpy arrays, a bounded stretch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8_000_000  # of text whose words are held together; a longer text is held alone


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in stretches of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows])) if batch.num_rows else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in order, and where each text's words begin (one more than texts).

    Words are runs of anything but space and U+0009 to U+000D; a null text has none.
    """
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for n, text in enumerate(texts.cast(pa.binary())):
        words += (text.as_py() or b"").split()
        starts[n + 1] = len(words)
    return words, starts


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in order of appearance, and the place of each word among them."""
    distinct = dict.fromkeys(words)
    index = dict(zip(distinct, range(len(distinct)), strict=True))
    return list(distinct), np.fromiter(map(index.__getitem__, words), np.int64, len(words))
