"""Word counts of whole columns of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of runs of other than ASCII white space in each text; 0 for null. Works on the column's bytes."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    word = ~SPACE[body]
    offsets = offsets - offsets[0]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[heads] = word[heads]
    total = np.concatenate([[0], np.cumsum(starts)])
    return total[offsets[1:]] - total[offsets[:-1]]
