"""Words of record batches as arrays: runs of bytes of one kind, with A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Each byte, A-Z in lower case. Other letters keep their case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def letters(but: bytes) -> np.ndarray:
    """Which bytes words are made of: all but these."""
    out = np.ones(256, bool)
    out[np.frombuffer(but, np.uint8)] = False
    return out


class Runs:
    """The words of some texts, runs of ``kind`` after lowering: the words themselves, their place among the bytes, and each text's first and last.

    A null text has no words. No word goes over the end of a text.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.low = LOWER[raw]
        at -= at[0]
        inside = kind[self.low]
        before = np.append(False, inside[:-1])[: len(inside)]
        edges = at[at < len(inside)]
        before[edges] = False
        after = np.append(inside[1:], False)[: len(inside)]
        after[edges[edges > 0] - 1] = False
        self.start, self.end = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
        self.size = self.end - self.start
        ends = np.append(0, np.cumsum(self.size)).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(self.size), pa.py_buffer(ends), pa.py_buffer(self.low[inside]))
        self.first = np.searchsorted(self.start, at[:-1])
        self.last = np.searchsorted(self.start, at[1:])

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first)), self.last - self.first)
