"""Whole texts as arrays of word codes, for the operators that run numpy inside tasks.

Words are `[^\\x20\\x09-\\x0D]+`. Every Arrow batch is handled in slices of bounded
size, so a task's memory does not depend on how many long texts meet in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give memory that is free in this worker back to the system.

    Workers go on from task to task and would otherwise keep the most they ever had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch` with at most SLICE_BYTES of text, or one row."""
    if not batch.num_rows:
        return
    release()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and total + size > SLICE_BYTES:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    yield batch.slice(start)


@dataclass
class Coded:
    """Words of several texts: text i has `codes[bounds[i]:bounds[i + 1]]`."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: list[bytes]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, in order."""
        known = np.fromiter(
            map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary)
        )
        return known[self.codes]


def coded(texts: pa.Array, lower: bool = False) -> Coded:
    """Split texts into words; a null has none. `lower` changes A-Z only."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    vocabulary = flat.dictionary.cast(pa.binary()).to_pylist()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    if b"" in vocabulary:
        real = codes != vocabulary.index(b"")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return Coded(codes, bounds, vocabulary)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a finaliser with two multiplications)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes, over the whole array."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for offset in range(size):
        total = total * _STEP + words[offset : offset + count]
    return mixed(total + np.uint64(size))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle, none has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(size, len(words))))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal `keys` of a partition sorted by them, a group at a time.

    Only the group at the end of a batch is carried to the next one.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for start, end in zip(starts, starts[1:]):
            yield table.slice(start, end - start)
        rest = table.slice(starts[-1])
        release()
    if rest is not None:
        yield rest


def binary_rows(column: pa.ChunkedArray | pa.Array) -> list[memoryview]:
    return [memoryview(x) for x in column.to_pylist()]
