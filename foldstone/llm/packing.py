"""Best-fit packing of token sequences under several capacities at once.

A document's ids are cut only if they do not fit a sequence: into full pieces, with the shorter one first. Pieces go by
decreasing length into the open sequence that fits best: every residual capacity (tokens, documents, attention cost as
the sum of squared lengths) must hold the piece, and among those the smallest weighted norm of what remains, or the
largest weighted dot product of piece and residual, wins. An empty sequence takes any piece of at most its tokens; the cost
limits what may join it. Full pieces are sequences of their own.

The cost of a sequence is never above its tokens squared, so the default of 95 % of that keeps short pieces from sequences that
one long piece almost fills, and 64 documents keep piles of near-empty texts apart; both cost few sequences (README).

Ids are those of the vocabulary file of the ``tokenizers`` library; they are made from its tokens and merge ranks by
``tiktoken``, several times as fast and equal (tests hold one against the other). Strings of special tokens in a text
are ordinary text.

Only lengths and checksums leave the scan of the texts. Pieces are dealt by a hash of their place to groups of about ``group``
pieces, each packed by one task, so no task's work follows the input; a group leaves at most a few sequences part empty.

Defined cases: a null or empty text is the end id alone; very long texts are cut as above; pieces of equal length go in the
order of their columns; repeated rows are packed each on its own, and rows without id like others; an empty table gives no
rows. Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.text import fresh, per_slice
from foldstone.session import materialize, ship


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence, and the weights of the three dimensions in the choice."""

    tokens: int = 2048
    documents: int = 64
    cost: float = 0.95 * 2048.0**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    choose: str = "norm"  # or "dot"


def best_fit(lengths: np.ndarray, bins: Bins = Bins()) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, pieces of 1 to ``bins.tokens`` tokens."""
    capacity = np.array([bins.tokens, bins.documents, bins.cost], float)  # below 0: a piece that alone costs more
    weights = np.array(bins.weights) / capacity**2
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, max(n, 1)))
    ids = np.empty(max(n, 1), np.int64)
    used = made = 0
    order = np.argsort(-lengths, kind="stable")
    if n and ((lengths < 1) | (lengths > bins.tokens)).any():
        raise ValueError("a piece does not fit an empty sequence")
    smallest = int(lengths.min()) if n else 0
    for place, i in enumerate(order.tolist()):
        size = int(lengths[i])
        need = (size, 1.0, float(size) * size)
        view = left[:, :used]
        fits = np.flatnonzero((view[0] >= need[0]) & (view[1] >= 1.0) & (view[2] >= need[2]))
        if len(fits):
            held = view[:, fits]
            if bins.choose == "norm":
                value = sum(w * (h - x) ** 2 for w, h, x in zip(weights, held, need))
            else:
                value = -sum(w * h * x for w, h, x in zip(weights, held, need))
            at = int(fits[int(np.argmin(value))])
        else:
            at = used
            left[:, at] = capacity
            ids[at] = made
            used, made = used + 1, made + 1
        sequence[i], offset[i] = ids[at], bins.tokens - int(left[0, at])
        left[:, at] -= need
        if not place % 256:  # sequences that hold no further piece leave the search
            live = np.flatnonzero((left[0, :used] >= smallest) & (left[1, :used] >= 1.0) & (left[2, :used] >= smallest * smallest))
            left[:, : len(live)], ids[: len(live)], used = left[:, live], ids[live], len(live)
    return sequence, offset


def pieces_of(count: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``count`` ids: full ones, the first one with what they leave."""
    first = count % most or min(count, most)
    return [(0, first), *((s, most) for s in range(first, count, most))] if count else []


@lru_cache(maxsize=2)
def fast_encoder(path: str, pattern: str):
    """Encoders of the vocabulary at ``path``: for any text, and for texts whose white space is single characters."""
    import tiktoken
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in vocabulary.items() if all(c in alphabet for c in token)}
    ranks = {t: r for t, r in ranks.items() if r < 50256}
    make = lambda name, pat: tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    return make("full", pattern), make("single", pattern.replace(r"\s+(?!\S)|", ""))


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print are themselves,
    the others follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def token_pieces(docs: DataFrame, path: str, pattern: str, end_id: int = 0, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document. One scan, no shuffle."""
    from foldstone.llm.bpe import _lines

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        from foldstone.llm.packing import fast_encoder  # the worker's own, kept from task to task

        full, single = fast_encoder(path, pattern)
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            text = text or ""
            ids = (full if _lines(text) is None else single).encode_ordinary(text)
            packed = np.array(ids, "<u4").tobytes() + end
            for k, (start, length) in enumerate(pieces_of(len(packed) // 4, most)):
                cut = packed[4 * start : 4 * (start + length)]
                row = (doc_id, k, start, length, zlib.crc32(cut), *([np.frombuffer(cut, "<i4")] if with_ids else ()))
                for column, value in zip(out.values(), row):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return per_slice(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), handle, ddl)


def pack(pieces: DataFrame, bins: Bins = Bins(), group: int = 16_384) -> DataFrame:
    """``pieces`` (with ``length``) and the ``sequence_id`` and ``offset`` of each."""
    pieces = materialize(pieces, "pieces")
    (group_,) = fresh(pieces, "group")
    ship(pieces.sparkSession)
    groups = max(1, -(-pieces.where(F.col("length") < bins.tokens).count() // group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            keys = batch.column(group_).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != of:
                    yield from answer(held, of)
                    held = []
                of = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer(held, of)

    def answer(held: list[pa.RecordBatch], of: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        sequence, offset = best_fit(rows.column("length").to_numpy(), bins)
        rows = rows.drop_columns([group_]).append_column("sequence_id", pa.array((of << 32) + sequence)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    whole = F.col("length") == bins.tokens
    single = pieces.where(whole).withColumn("sequence_id", F.lit(1 << 62).cast("long") + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = [c for c in pieces.columns if c in ("doc_id", "piece", "start", "ids_crc32")]
    place = F.xxhash64(F.monotonically_increasing_id())  # of a written table: rows alike in all columns part here
    dealt = pieces.where(~whole).withColumn(group_, F.pmod(place, F.lit(groups)).cast("int"))
    packed = dealt.repartitionByRange(groups, group_).sortWithinPartitions(group_, *names).mapInArrow(over, schema)
    return packed.unionByName(single)


def pack_documents(docs: DataFrame, path: str, pattern: str, bins: Bins = Bins(), with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return pack(token_pieces(docs, path, pattern, most=bins.tokens, with_ids=with_ids), bins)
