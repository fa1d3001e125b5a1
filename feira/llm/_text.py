"""Arrow/numpy text helpers for the operators that run Python inside tasks.

Everything here works on one bounded slice of rows at a time (``slices``), so
memory follows the slice, not the partition; a single very long text is a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
SLICE_ROWS = 50_000


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most SLICE_ROWS rows holding about ``max_bytes`` of ``column``."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // max_bytes
    part = np.arange(batch.num_rows) // SLICE_ROWS
    cuts = np.flatnonzero((np.diff(block) > 0) | (np.diff(part) > 0)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mixer (splitmix constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v, seed) for v in values), np.uint64, len(values))


def plain(texts: pa.Array) -> pa.Array:
    """A text column without nulls (null: empty) and without an offset: some
    kernels of the installed Arrow return wrong offsets for sliced arrays."""
    whole = texts.take(pa.array(np.arange(len(texts)), pa.int64()))
    return pc.fill_null(whole.cast(pa.large_string()), "")


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs of anything but ASCII white space) of each text; null: none.

    Returns (code of each word, number of words of each text, the distinct
    words). ``lower`` maps A-Z only.
    """
    texts = plain(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.not_equal(flat, "")
    flat = flat.filter(real)
    row = row[real.to_numpy(zero_copy_only=False)]
    counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, encoded.dictionary


def rolling(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive words inside each text.

    Returns (hash, text index, first word of the run within its text).
    """
    n = len(hashes) - width + 1
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += hashes[k:n + k]
    inside = text[:n] == text[width - 1:]
    at = np.flatnonzero(inside)
    return mix(h[at]), text[at], at - first[text[at]]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)
