"""Words of texts as flat numpy arrays: the JVM splits, numpy works on whole Arrow batches.

A word is a maximal run of letters, digits and underscores, lower-cased. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | Column) -> Column:
    """array<string> of a text column; an empty array for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal inputs stay equal, near inputs become unrelated."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two columns of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x632BE59BD9B4E019))


class Flat:
    """The lists of one Arrow column laid end to end.

    n: length of each list; start: where each begins; doc: the row of each element; codes: index of each element in `uniques`.
    """

    def __init__(self, lists: pa.Array):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        self.n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        coded = lists.flatten().dictionary_encode()
        self.uniques: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each element, the same in every batch."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.uniques.to_pylist()), np.uint64, len(self.uniques))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def occurrences(self) -> np.ndarray:
        """How many equal elements come before each one in its list."""
        order = np.lexsort((self.codes, self.doc))
        d, c = self.doc[order], self.codes[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
        at = np.arange(len(order))
        out = np.empty(len(order), np.int64)
        out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        return out


def list_array(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths over a flat array."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values, kind))


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose lists in `column` have about `most` elements together; a longer list is a part of its own."""
    n = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
