"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last ``WINDOW`` lines decides after which lines a chunk ends, so inserted or deleted
lines move no boundary beyond their neighbours. A line of ``LONG`` words or more is a chunk by itself. Chunks of two lines
or more, and long lines, are looked up over the whole corpus: where one stands in several places, the first (by doc_id, text
hash and place) stays, and the others go once 256-bit digests of their bytes have been compared with it.

With ``passages`` (the query and the pipeline), so are the shortest windows of whole lines that reach ``LONG`` words from
each line on and back from each line. Every line of a repeated passage of ``LONG`` words lies in one that the passage holds,
so the passage goes whole, however its lines are chunked. A line goes with an earlier copy of itself, so one copy stays.

Only 128-bit hashes and places are shuffled to find repeats; digests travel for repeated chunks alone; the texts are
shuffled once, to meet their marks. A chunk that half of all documents share is counted map-side, and joined as a skewed key.
Two tables are written on the way, ``chunks`` and ``marked``; a worker holds one text's chunks and ``MOST_ROWS`` rows at a time.

Defined cases: null texts stay null, empty texts empty; chunks of fewer than ``LEAST`` words stay; a document of which
nothing is left has an empty text; rows of equal id and text are one document and keep the same lines, while rows of one id with
different texts, or without id, are documents of their own; very long texts are taken whole; an empty table gives no rows.
Other columns stay as they are whatever their names, ``n_chars`` unless lines go.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.text import as_bytes, fresh, slices
from foldstone.session import materialize, release, ship

WINDOW, DIVISOR, LONG, LEAST, MOST_LINES = 2, 3, 50, 10, 64
MOST_ROWS = 20_000
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def chunk_ends(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, words) of each chunk."""
    counts = [len(x.split()) for x in lines]
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    out, begin, rolled, oldest = [], 0, 0, pow(_BASE, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * _BASE + h - (hashes[i - WINDOW] * oldest if i >= WINDOW else 0)) & _M
        long_next = i + 1 < len(lines) and counts[i + 1] >= LONG
        ends = (rolled ^ rolled >> 29) * _BASE >> 40 & _M
        if counts[i] >= LONG or long_next or ends % DIVISOR == 0 or i + 1 - begin >= MOST_LINES or i + 1 == len(lines):
            out.append((begin, i + 1, sum(counts[begin : i + 1])))
            begin = i + 1
    return out


def removable(begin: int, end: int, words: int) -> bool:
    return words >= LONG or end - begin > 1 and words >= LEAST


def least_windows(lines: list[bytes]) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest windows of ``LONG`` words or more from each line, and up to each."""
    counts = [len(x.split()) for x in lines]
    out, total, begin = set(), 0, 0
    for i, c in enumerate(counts):
        total += c
        while total - counts[begin] >= LONG:
            total -= counts[begin]
            begin += 1
        if c and total >= LONG:
            out.add((begin, i + 1))
    total, end = 0, len(lines)
    for i in range(len(lines) - 1, -1, -1):
        total += counts[i]
        while total - counts[end - 1] >= LONG:
            end -= 1
            total -= counts[end]
        if counts[i] and total >= LONG:
            out.add((i, end))
    return out


def looked_up(lines: list[bytes], passages: bool) -> list[tuple[int, int]]:
    found = {(a, b) for a, b, words in chunk_ends(lines) if removable(a, b, words)}
    return sorted(found | least_windows(lines) if passages else found)


def _hash(data: bytes, bits: int) -> bytes:
    return (xxhash.xxh3_128_intdigest(data) >> 128 - bits).to_bytes(16, "big")


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long"), F.xxhash64("text")]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, MOST_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _chunk_rows(part: pa.RecordBatch, bits: int, passages: bool) -> Iterator[tuple]:
    for doc, key, text in zip(part.column("id").to_pylist(), part.column("text_key").to_pylist(), as_bytes(part.column("text"))):
        lines = text.split(b"\n")
        for a, b in looked_up(lines, passages):
            yield _hash(b"\n".join(lines[a:b]), bits), doc, key, a, b - a


def _chunks(docs: DataFrame, bits: int, passages: bool) -> DataFrame:
    schema = pa.schema([("hash", pa.binary()), ("id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("size", pa.int32())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from _batches(_chunk_rows(part, bits, passages), schema)

    key = _key()
    return docs.select(key[0].alias("id"), key[1].alias("text_key"), "text").mapInArrow(over, "hash binary, id long, text_key long, place int, size int")


def _marked(docs: DataFrame, names: list[str], bits: int, passages: bool) -> DataFrame:
    """``docs`` with ``names``: its id, text key and, where it has chunks that stand in several places, marks with their place,
    hash, whether this is the first of them and whether it overlaps the first, as in a run of like lines."""
    id_, key, marks_, _ = names
    chunks = materialize(_chunks(docs, bits, passages), "chunks")
    here = F.struct("id", "text_key", "place", "size")
    several = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min(here).alias("first")).where("c > 1")
    several = several.select(F.concat("hash", F.lit(b"")).alias("repeated"), "first")  # dealt anew: the join may split a chunk with many places
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("place") < F.col("first.place") + F.col("first.size"))
    marks = chunks.join(several, F.col("hash") == F.col("repeated")).select("id", "text_key", F.struct("place", "size", "hash", here.eqNullSafe(F.col("first")).alias("first"), overlaps.alias("overlaps")).alias("mark"))
    marks = marks.groupBy("id", "text_key").agg(F.collect_set("mark").alias(marks_))
    keyed = docs.withColumns(dict(zip((id_, key), _key())))
    met = keyed.join(marks, keyed[id_].eqNullSafe(marks["id"]) & (keyed[key] == marks["text_key"]), "left")
    found = materialize(met.select(*[keyed[f"`{c}`"] for c in keyed.columns], marks[marks_]), "marked", "zstd")
    release(chunks)
    return found


def _digests(part: pa.RecordBatch) -> Iterator[tuple]:
    for doc, key, marks, text in zip(part.column("id").to_pylist(), part.column("text_key").to_pylist(), part.column("marks"), as_bytes(part.column("text"))):
        lines = text.split(b"\n")
        for m in marks.as_py():
            data = b"\n".join(lines[m["place"] : m["place"] + m["size"]])
            yield m["hash"], m["first"], doc, key, m["place"], m["size"], blake2b(data, digest_size=32).digest()


def _refuted(marked: DataFrame) -> DataFrame | None:
    """(bad_id, bad_key, places) of rows (id, text_key, marks, text) whose marked chunks' bytes are not those of the first with
    their hash; None where there are none: then the least and the largest digest of each hash are one."""
    schema = pa.schema([("hash", pa.binary()), ("first", pa.bool_()), ("id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from _batches(_digests(part), schema)

    rows = marked.where("marks is not null").mapInArrow(over, "hash binary, first boolean, id long, text_key long, place int, size int, digest binary")
    if not rows.groupBy("hash").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").count():
        return None
    rows = materialize(rows, "places")
    firsts = materialize(rows.where("first").groupBy("hash").agg(F.min("digest").alias("kept")), "firsts")
    unlike = rows.where("not first").join(firsts, "hash").where("digest <> kept")
    found = materialize(unlike.groupBy(F.col("id").alias("bad_id"), F.col("text_key").alias("bad_key")).agg(F.collect_set(F.struct("place", "size")).alias("places")), "refuted")
    release(rows, firsts)
    return found


def remove_repeats(docs: DataFrame, extra: bool = False, bits: int = 128, passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks gone from ``text`` and ``n_chars`` to match; with ``extra``, also ``n_lines``,
    ``n_removed`` lines. ``passages`` removes repeated windows of lines too. ``bits`` below 128 weaken the hash, for tests
    of the comparison."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    id_, key, marks_, unlike_ = own = fresh(docs, "id", "text_key", "marks", "unlike")
    marked = _marked(docs, own, bits, passages)
    refuted = _refuted(marked.select(F.col(id_).alias("id"), F.col(key).alias("text_key"), F.col(marks_).alias("marks"), "text"))
    given = [marked[f"`{c}`"] for c in names]
    if refuted is not None:
        met = marked[id_].eqNullSafe(refuted["bad_id"]) & (marked[key] == refuted["bad_key"])
        marked = marked.join(refuted, met, "left").select(*given, marked[marks_], refuted["places"].alias(unlike_))
    else:
        marked = marked.select(*given, marks_, F.lit(None).cast("array<struct<place:int,size:int>>").alias(unlike_))
    if extra:
        schema = schema.add("n_lines", "long").add("n_removed", "long")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, before, gone = part.column("text").to_pylist(), [], []
                for i, (text, marks, unlike) in enumerate(zip(texts, part.column(marks_), part.column(unlike_))):
                    lines = (text or "").encode().split(b"\n")
                    before.append(len(lines) if text else 0)
                    spans = {(m["place"], m["size"]) for m in marks.as_py() or () if not m["first"] and not m["overlaps"]}
                    drop = {k for place, size in spans.difference((u["place"], u["size"]) for u in unlike.as_py() or ()) for k in range(place, place + size)}
                    keep = [line for k, line in enumerate(lines) if k not in drop]
                    gone.append(len(lines) - len(keep))
                    if drop:
                        texts[i] = b"\n".join(keep).decode()
                columns = {c: part.column(c) for c in names}
                columns["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in columns and not extra:
                    lengths = np.array([len(t or "") for t in texts])
                    touched = pa.array(np.array(gone) > 0)
                    columns["n_chars"] = pc.if_else(touched, pa.array(lengths).cast(columns["n_chars"].type), columns["n_chars"])
                if extra:
                    columns |= {"n_lines": pa.array(before, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return marked.mapInArrow(over, schema)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for each row of ``docs``."""
    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), extra=True, passages=True)
