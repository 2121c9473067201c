"""Words, hashes and batch handling that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from foldstone.session import ship

#: Bytes of text handled at once; Arrow batches may hold far more.
SLICE_BYTES = 4_000_000

#: Bytes that end a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become a space, all others stay.
_PLAIN = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text after A-Z became lower case."""
    return text.lower().translate(_PLAIN).split()


def space_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() takes exactly these six bytes as white space."""
    return text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), elementwise."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes, by the place where it starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out ^ hashes[i : i + n])
    return out


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text, so that memory does not follow the batch."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    part = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def per_slice(df: DataFrame, handle: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """``handle`` over every slice of ``df``, which must have a string column ``text``."""
    ship(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=size):
                yield handle(part)

    return df.mapInArrow(over, schema)
