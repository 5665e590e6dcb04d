"""Lines of places in a text: its line ends are indexed once, and each place is found by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class LineIndex:
    """Where the lines of a text end, in characters."""

    def __init__(self, text: str):
        self.ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10)

    def lines(self, places: np.ndarray) -> np.ndarray:
        """The line, from 1, that each place is on; a line end is on the line it ends."""
        return np.searchsorted(self.ends, places) + 1


def lines_of(text: Column, places: Column) -> Column:
    """The lines of an array of places, counted from 0; null for a null text or null places."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted in batches:
            out = [LineIndex(t).lines(np.array(p, np.int64)) if t is not None and p is not None else None for t, p in zip(texts.to_pylist(), wanted.to_pylist())]
            yield pa.array(out, pa.list_(pa.int32()))

    return run(text, places)
