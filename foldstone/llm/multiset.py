"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two. So it does not depend on their order, and inserting or deleting a paragraph
adds or subtracts one vector. The vector has two parts:

* ``EXACT`` lanes of 64 bits, a BLAKE2b digest of the paragraph: equality of the multisets;
* ``SKETCH`` lanes of 16 bits, the sum of a signed unit vector for each run of ``WIDTH`` words of the paragraph (all its
  words as one run if fewer). The squared length of the difference of two sketches estimates how many runs they do not
  share, from which ``likeness`` follows.

Defined cases: a null text is an empty one; an empty text is one empty paragraph; very long texts are summed whole. Two texts
without any word are alike 1 if their fingerprints are equal and 0 otherwise. Equal texts have equal fingerprints wherever
they stand. Rows without a doc_id come before all others (as the smallest number); rows of one doc_id are ordered by a hash of
the text, so that ranges may cut between them, then by text. A table of one row has itself as the next one; an empty one gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.text import mix, word_hashes
from foldstone.session import ship

EXACT, SKETCH, WIDTH = 8, 256, 3
_TAIL = np.uint64(SKETCH - 1)


def paragraphs(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def vectors(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of paragraphs, the sums (exact lanes, sketch lanes) and the number of word runs."""
    n = len(documents)
    exact = np.zeros((n, EXACT), np.uint64)
    words: list[bytes] = []
    line_of: list[int] = []
    owners: list[int] = []
    for i, lines in enumerate(documents):
        if lines:
            digests = b"".join([hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in lines])
            exact[i] = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0)
        for x in lines:
            found = x.split()
            if found:
                words.extend(found)
                line_of.append(len(found))
                owners.append(i)
    lengths, owner = np.array(line_of, np.int64), np.array(owners, np.int64)
    if not len(lengths):
        return exact, np.zeros((n, SKETCH), np.int16), np.zeros(n, np.int64)
    hashes = word_hashes(words)
    line = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[line] - place  # words from here to the end of the line
    key = hashes.copy()
    for step in range(1, WIDTH):
        more = np.flatnonzero(left > step)
        key[more] = mix(key[more] ^ hashes[more + step])
    runs = (left >= WIDTH) | (place == 0)
    key, of = mix(key[runs]), owner[line[runs]]
    sign = np.where(key >> np.uint64(63), 1.0, -1.0)
    lane = of * SKETCH + (key & _TAIL).astype(np.int64)
    sketch = np.bincount(lane, sign, minlength=n * SKETCH).astype(np.int64).reshape(n, SKETCH).astype(np.int16)
    return exact, sketch, np.bincount(of, minlength=n)


class Fingerprint:
    """The running fingerprint of one document, for insertions and deletions of paragraphs."""

    def __init__(self, lines: list[bytes]) -> None:
        self.exact, self.sketch, self.runs = (x[0] for x in vectors([lines]))

    def insert(self, line: bytes) -> None:
        e, s, r = vectors([[line]])
        self.exact, self.sketch, self.runs = self.exact + e[0], self.sketch + s[0], self.runs + r[0]

    def delete(self, line: bytes) -> None:
        e, s, r = vectors([[line]])
        self.exact, self.sketch, self.runs = self.exact - e[0], self.sketch - s[0], self.runs - r[0]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.text() == other.text()

    def text(self) -> str:
        return encode(self.exact[None], self.sketch[None], np.array([self.runs]))[0]


def encode(exact: np.ndarray, sketch: np.ndarray, runs: np.ndarray) -> list[str]:
    """Each fingerprint in hexadecimal: number of runs modulo 2 ** 32, exact lanes, sketch lanes."""
    whole = np.concatenate([runs.astype("<u4")[:, None].view(np.uint8), np.ascontiguousarray(exact.astype("<u8")).view(np.uint8), np.ascontiguousarray(sketch.astype("<i2")).view(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in whole]


def decode(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[4 : 4 + 8 * EXACT], "<u8"), np.frombuffer(raw[4 + 8 * EXACT :], "<i2"), int.from_bytes(raw[:4], "little")


def likeness(one: tuple, other: tuple) -> np.ndarray:
    """The estimated share of word runs in common, |A & B| / |A | B|, for rows of (exact, sketch, runs)."""
    equal = (one[0] == other[0]).all(axis=1)
    apart = (one[1].astype(np.int32) - other[1]).astype(np.int16).astype(np.float64)
    odd = (apart**2).sum(axis=1)
    total = (one[2] + other[2]).astype(np.float64)
    union = (total + odd) / 2
    value = np.divide((total - odd) / 2, union, out=np.zeros(len(total)), where=union > 0)
    return np.where(equal, 1.0, np.clip(value, 0.0, 1.0))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_batch(texts: list[str], following: list[str]) -> dict[str, list]:
    """Fingerprints of texts, of their edited texts, and likenesses. The edited fingerprint is the text's, less the
    paragraphs that the edit ends, plus those that it brings."""
    changed, gone, come = [_edited(a, b) for a, b in zip(texts, following)], [], []
    for a, b in zip(texts, changed):
        keep = a.rfind("\n", 0, len(a) - len(a) // 4) + 1
        gone.append(paragraphs(a[keep:].encode()))
        come.append(paragraphs(b[keep:].encode()))
    own = vectors([paragraphs(t.encode()) for t in texts])
    minus, plus = vectors(gone), vectors(come)
    new = own[0] - minus[0] + plus[0], own[1] - minus[1] + plus[1], own[2] - minus[2] + plus[2]
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": encode(*own),
        "edited_fingerprint": encode(*new),
        "near_edited": likeness(own, new).tolist(),
        "own": own,
    }


def row_cuts(rows: DataFrame, parts: int, each: int = 64) -> list[tuple[int, int]]:
    """Up to ``parts - 1`` pairs (at, key) that cut ``rows`` into ranges of like numbers of rows: quantiles of a sample by hash of
    about ``each`` pairs a part, counted before they are gathered. They decide the balance, never a result."""
    step = max(1, rows.count() // (parts * each))
    picked = rows.where(F.pmod(F.xxhash64("at", "key"), F.lit(step)) == 0).groupBy("at", "key").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["at"], r["key"], r["n"]) for r in picked.collect())
    whole, done, cuts = sum(n for *_, n in found), 0, []
    for at, key, n in found:
        if done * parts >= (len(cuts) + 1) * whole:
            cuts.append((at, key))
        done += n
    return cuts


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint_documents(docs: DataFrame, slice_chars: int = 3_000_000) -> DataFrame:
    """One row per document, each held against the next one in ascending doc_id.

    The table is dealt into ranges of (doc_id, text hash), one shuffle of the text. The first row of every range (a list as long
    as the number of ranges) is also sent, as a guest, to the end of the range before it, so that no row is collected and no
    window runs over the whole table.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.xxhash64(text).alias("key"), text.alias("text"))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.select(_place_in(row_cuts(source.select("at", "key"), parts)).alias("part"), F.lit(0).alias("guest"), "at", "key", "doc_id", "text")
    first = dealt.groupBy("part").agg(F.min(F.struct("at", "key")).alias("row")).orderBy("part").collect()
    if first:
        before = [(r["part"], first[i - 1]["part"], *r["row"]) for i, r in enumerate(first)]
        hosts = spark.createDataFrame(before, "part int, host int, at long, key long")  # as many rows as ranges
        guests = dealt.join(F.broadcast(hosts), ["part", "at", "key"]).groupBy("host").agg(F.min(F.struct("text", "doc_id", "at", "key")).alias("row"))
        dealt = dealt.unionByName(guests.select(F.col("host").alias("part"), F.lit(1).alias("guest"), "row.at", "row.key", "row.doc_id", "row.text"))
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", "at", "key", "text").select("part", "guest", "doc_id", "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int | None, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= slice_chars and len(held) > 1:
                    yield from answer(held)
                    held, size = held[-1:], len(row[3])
        yield from answer(held)

    def answer(rows: list[tuple[int, int, int | None, str]]) -> Iterator[pa.RecordBatch]:
        """A row's next one is the row after it; a range's last row is a guest, which has no answer of its own."""
        if len(rows) < 2:
            return
        texts = [r[3] for r in rows]
        found = fingerprint_batch(texts, [*texts[1:], ""])
        own = found.pop("own")
        after = [np.concatenate([x[1:], x[:1]]) for x in own]
        found |= {"doc_id": [r[2] for r in rows], "near_next": likeness(own, after).tolist()}
        live = [i for i in range(len(rows) - 1) if not rows[i][1]]
        yield pa.RecordBatch.from_pydict({f.name: pa.array([found[f.name][i] for i in live], f.type) for f in _ARROW}, schema=_ARROW)

    return ordered.mapInArrow(over, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _place_in(cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``cuts`` are at or below a row's (at, key): a search by halving in two literal arrays, so that the
    expression does not grow with the cuts."""
    if not cuts:
        return F.lit(0)
    ends = [F.split(F.lit(",".join(map(str, column))), ",").cast("array<bigint>") for column in zip(*cuts)]
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def reached(n: Column) -> Column:
        """Whether the ``n``-th cut is there, and at or below the row."""
        at, key = (F.get(e, n - 1) for e in ends)
        return F.coalesce((at < F.col("at")) | (at == F.col("at")) & (key <= F.col("key")), F.lit(False))

    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(reached(found + step), found + step).otherwise(found))
