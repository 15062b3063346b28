"""Counts of byte classes for the words of whole batches, for the feature columns of the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from payguard.llm import words as W
from payguard.llm.common import CHUNK_BYTES, text_buffer

#: Look-alikes that stand for letters in obfuscated words; fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LETTER = np.zeros(256, np.bool_)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = W._LOWER.copy()
for _k, _v in LOOKALIKES.items():
    _PLAIN[ord(_k)] = ord(_v)


class Batch:
    """Words of a batch of texts and running counts over its bytes."""

    def __init__(self, text: pa.Array) -> None:
        self.buffer, self.offsets = text_buffer(text)
        self.starts, self.ends, self.rows = W.split(self.buffer, self.offsets)
        self.n = np.diff(self.rows)

    def count(self, low: int, high: int) -> np.ndarray:
        """Bytes of low..high in each word."""
        return self.within((self.buffer >= low) & (self.buffer <= high))

    def within(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.ends] - total[self.starts]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of the words' values over each row."""
        total = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=total[1:])
        return total[self.rows[1:]] - total[self.rows[:-1]]

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buffer, starts and ends of the words in lower case without anything but letters.

        Look-alikes count as letters between letters; decoration after a word does not.
        """
        letter = _LETTER[self.buffer]
        keep = letter.copy()
        if len(keep) > 2:
            other = (_PLAIN[self.buffer] != self.buffer) & ~letter
            keep[1:-1] |= other[1:-1] & letter[:-2] & letter[2:]
        total = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        return _PLAIN[self.buffer[keep]], total[self.starts], total[self.ends]


def column_of(function: Callable[[pa.Array], np.ndarray]):
    """An Arrow UDF from text to an array of doubles; function maps a few MB of texts to a matrix, a row each."""

    def run(text: pa.Array) -> pa.Array:
        out, start = [], 0
        offsets = text_buffer(text)[1]
        while start < len(text):
            stop = min(max(int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1, start + 1), len(text))
            rows = function(text.slice(start, stop - start))
            out.append(pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel().astype(np.float64)), rows.shape[1]).cast(pa.list_(pa.float64())))
            start = stop
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")
