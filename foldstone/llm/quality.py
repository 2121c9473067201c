"""Quality rules: counts of repetition, and compression bands.

A text compresses too well when it repeats itself and too badly when it is noise. The zstandard ratio (bytes over
compressed bytes) is taken of the whole text and of fixed chunks, each held against limits for its length, since short
texts carry the frame's overhead and long ones share more.

Defined cases: a null or empty text has no words and fails the word count; white space alone likewise; very long texts are counted
and packed whole; a ratio at a limit is within it. Repeated rows are judged alike, row by row, and rows without id like others;
an empty table gives no rows. Other columns pass through untouched, whatever their names and nulls.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from foldstone.llm.text import as_bytes, per_slice, slices, space_words, windows, word_hashes
from foldstone.session import ship

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of ``from_bytes`` or more, up to the next band."""

    from_bytes: int
    least: float
    most: float


@dataclass(frozen=True)
class Limits:
    """``bands`` for whole texts, ``chunk_bands`` for chunks; a text goes when more than ``bad_share`` of its chunk
    bytes lie outside theirs. The lower limits lie above random base64 and printable ASCII (1.25 to 1.33 at most) and below
    training documents labelled good (1.38 from 200 bytes, 1.72 from 1,000, 2.11 from 4,000 at least)."""

    min_words: int = 50
    repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 4096
    bad_share: float = 0.5
    bands: tuple[Band, ...] = field(
        default=(Band(0, 0.0, 99.0), Band(200, 1.28, 2.8), Band(1000, 1.40, 3.4), Band(4000, 1.45, 4.2), Band(16000, 1.45, 5.0), Band(64000, 1.45, 6.0))
    )
    chunk_bands: tuple[Band, ...] = field(default=(Band(0, 0.0, 99.0), Band(512, 1.36, 3.2), Band(2048, 1.42, 3.8)))


def _outside(bands: tuple[Band, ...], size: int, ratio: float) -> bool:
    band = bands[bisect_right([b.from_bytes for b in bands], size) - 1]
    return not band.least <= ratio <= band.most


def compression_verdict(text: bytes, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(whole-text ratio, share of bytes in chunks out of band, within all bands)."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(text) / len(packer.compress(text))
    step, bad = limits.chunk_bytes, 0
    for i in range(0, len(text), step) if len(text) > step else ():
        piece = text[i : i + step]
        if _outside(limits.chunk_bands, len(piece), len(piece) / len(packer.compress(piece))):
            bad += len(piece)
    share = bad / len(text)
    return ratio, share, not _outside(limits.bands, len(text), ratio) and share <= limits.bad_share


def repeated_words(groups: list[list[bytes]], width: int = 3) -> np.ndarray:
    """For each list of words, how many lie in windows of ``width`` words that it holds twice or more."""
    sizes = np.array([len(g) for g in groups], np.int64)
    flat = [w for g in groups for w in g]
    out = np.zeros(len(groups), np.int64)
    if len(flat) < width:
        return out
    owner = np.repeat(np.arange(len(groups)), sizes)
    keys = windows(word_hashes(flat), width)
    whole = owner[: len(keys)] == owner[width - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.lexsort((keys[at], owner[at]))]
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(flat), bool)
    for i in range(width):
        covered[order[twice] + i] = True
    np.add.at(out, owner[covered], 1)
    return out


def measure(texts: list[bytes], limits: Limits) -> dict[str, list]:
    packer = zstandard.ZstdCompressor(level=limits.level)
    words = [space_words(t) for t in texts]
    repeats = repeated_words(words)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share")}
    for text, ws, repeat in zip(texts, words, repeats.tolist()):
        chars = len(text.decode("utf-8", "replace"))
        seen: set[bytes] = set()
        dups = 0
        for line in text.split(b"\n"):
            if line.strip(_SPACES):
                dups += line in seen
                seen.add(line)
        failed = len(ws) < limits.min_words or 100 * repeat > limits.repeat_percent * len(ws)
        ratio, share, fits = compression_verdict(text, limits, packer)
        for key, value in zip(out, (len(ws), chars - len(text) + len(text.translate(None, _SPACES)), len(text.translate(None, _NOT_SYMBOLS)), dups, repeat, failed, fits and not failed, ratio, share)):
            out[key].append(value)
    return out


_COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
_ARROW = pa.schema(
    [pa.field("doc_id", pa.int64())]
    + [pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [pa.field("base_failed", pa.bool_()), pa.field("kept", pa.bool_()), pa.field("ratio", pa.float64()), pa.field("bad_chunk_share", pa.float64())]
)


def measure_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: its counts, its ratios and the verdict. One scan, no shuffle."""

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        found = {"doc_id": part.column("doc_id"), **measure(as_bytes(part.column("text")), limits)}
        return pa.RecordBatch.from_pydict(found, schema=_ARROW)

    return per_slice(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), handle, _COLUMNS)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. One scan, no shuffle."""
    ship(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(measure(as_bytes(part.column("text")), limits)["kept"], pa.bool_()))

    return docs.mapInArrow(over, docs.schema)
