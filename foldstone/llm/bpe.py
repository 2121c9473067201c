"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece's bytes there is one token that the prefix's encoding ends with. It is the one token ending
there that the encoding of the shorter prefix may precede, that is, whose pair with that encoding's last token is not
merged across by BPE. Storing that token for each prefix gives the encoding by walking back from the end, makes an append
exact (earlier prefixes stand), and lets an edit be encoded anew only until the stored tokens agree again.

Pieces come from the vocabulary's pattern. A text without double, leading or trailing spaces and without other white space
than spaces and line ends splits at these: no piece reaches across, so its words are encoded once and kept. Other texts
go through the pattern whole. What is kept is bounded by ``CACHE`` words and ``PAIRS`` pairs a worker.

Defined cases: null and empty texts have no ids; very long texts and pieces are encoded whole; repeated rows, rows of one id and
rows without id give a row each; an empty table gives no rows. Bytes decode to the text again. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foldstone.llm.text import SLICE_BYTES, per_slice

CACHE, PAIRS = 1_000_000, 1_000_000
#: Pieces up to so many bytes are encoded many at a time.
SHORT = 32
#: An odd multiplier for hashes of byte strings, and two for places in the vocabulary's tables.
_BASE, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


#: White space of Unicode, and what str.split takes for it, other than space and line end.
_ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", " \n", "\n ", "\n\n")


def _lines(text: str) -> list[tuple[str, list[str]]] | None:
    """Each line's first word and its other words; None if white space is anything but single spaces and line ends
    between words."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS) or any(x in text for x in _ODD_SPACES):
        return None
    return [(words[0], words[1:]) for words in map(_SPLIT, text.split("\n"))]


_SPLIT = methodcaller("split", " ")


class Vocabulary:
    """Token ids by the hash of their bytes, for whole arrays: each token has one of two places. What is found by its hash is
    compared byte by byte."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.powers = _BASE ** np.arange(SHORT + 1, dtype=np.uint64)
        short = [(t, r) for t, r in ranks.items() if len(t) <= SHORT]
        keys = np.array([int(self.prefix_hashes(np.frombuffer(t, np.uint8)[None])[0, -1]) for t, _ in short], np.uint64)
        ids = np.array([r for _, r in short], np.int64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have the same hash")
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes = np.zeros((len(self.sizes), SHORT), np.uint8)
        for token, rank in short:
            self.sizes[rank] = len(token)
            self.bytes[rank, : len(token)] = np.frombuffer(token, np.uint8)
        self.tables = []
        for multiplier in (_FIRST, _SECOND):
            slots = self._slots(keys, multiplier)
            table = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.uint64)
            _, first = np.unique(slots, return_index=True)
            table[0][slots[first]], table[1][slots[first]] = ids[first], keys[first]
            self.tables.append((multiplier, *table))
            keys, ids = np.delete(keys, first), np.delete(ids, first)
        self.rest = dict(zip(keys.tolist(), ids.tolist()))

    def _slots(self, keys: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * multiplier >> np.uint64(64 - self.BITS)).astype(np.int64)

    def prefix_hashes(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + rows[:, i] + np.uint64(1)
        return out

    def are(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each token's bytes are those of its row."""
        return (self.sizes[ids] == rows.shape[1]) & (self.bytes[ids, : rows.shape[1]] == rows).all(axis=1)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The ids of tokens with these hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for multiplier, ids, held in self.tables:
            slots = self._slots(keys, multiplier)
            same = held[slots] == keys
            out[same] = ids[slots[same]]
        for key, token in self.rest.items():
            out[keys == np.uint64(key)] = token
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes pieces by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, bool] = {}
        self.vocabulary = Vocabulary(ranks)
        self.known_keys, self.known_fits = np.empty(0, np.int64), np.empty(0, bool)
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """Plain BPE: the adjacent pair of the lowest rank becomes one, leftmost first, until none is in the vocabulary."""
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` in an encoding; -1 before stands for the start."""
        key = (before + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            one, two = self.tokens[before] if before >= 0 else b"", self.tokens[token]
            wanted = [one, two] if one else [two]
            known = self._merged([bytes([b]) for b in one + two]) == wanted
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
                self.known_keys, self.known_fits = self.known_keys[:0], self.known_fits[:0]
            self.pairs[key] = known
        return known

    def last_token(self, piece: bytes, end: int, last: list[int]) -> int:
        """The token that the encoding of ``piece[:end]`` ends with; ``last`` has those of all shorter prefixes."""
        get, fits = self.ranks.get, self.fits
        for start in range(max(0, end - self.longest), end):
            token = get(piece[start:end])
            if token is not None and fits(last[start], token):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def prefixes(self, piece: bytes) -> list[int]:
        """The last token of every prefix; -1 for the empty one."""
        last = [-1]
        for end in range(1, len(piece) + 1):
            last.append(self.last_token(piece, end, last))
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.prefixes(piece))

    def fits_many(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``fits`` for arrays: pairs in the sorted array are looked up, others once each in ``pairs``."""
        keys = (before + 1) << 32 | token
        if not len(self.known_keys):
            known, out = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        else:
            at = np.minimum(np.searchsorted(self.known_keys, keys), len(self.known_keys) - 1)
            known, out = self.known_keys[at] == keys, self.known_fits[at]
        if not known.all():
            new, inverse = np.unique(keys[~known], return_inverse=True)
            out[~known] = np.fromiter((self.fits((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))[inverse]
        return out

    def _sort_pairs(self) -> None:
        """Bring ``pairs`` into the sorted array once it has grown by a tenth."""
        if 10 * len(self.pairs) > 11 * len(self.known_keys):
            keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
            order = np.argsort(keys)
            self.known_keys, self.known_fits = keys[order], np.fromiter(self.pairs.values(), bool, len(keys))[order]

    def _pack_equal(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces that have one length, by the dynamic programme over all of them at once."""
        n, width = len(pieces), len(pieces[0])
        rows = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)
        hashes, powers = self.vocabulary.prefix_hashes(rows), self.vocabulary.powers
        last = np.full((n, width + 1), -1, np.int64)
        begins = np.zeros((n, width + 1), np.int64)
        for end in range(1, width + 1):
            open_rows = np.arange(n)
            for start in range(end):
                ids = self.vocabulary.look_up(hashes[open_rows, end] - hashes[open_rows, start] * powers[end - start])
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    hit = hit[self.vocabulary.are(ids[hit], rows[open_rows[hit], start:end])]
                    held = open_rows[hit]
                    good = self.fits_many(last[held, start], ids[hit])
                    hit, held = hit[good], held[good]
                    last[held, end], begins[held, end] = ids[hit], start
                    open_rows = np.delete(open_rows, hit)
                    if not len(open_rows):
                        break
        at, columns, live = np.full(n, width), [], np.ones(n, bool)
        while live.any():
            row = np.flatnonzero(live)
            column = np.full(n, -1, np.int64)
            column[row] = last[row, at[row]]
            at[row] = begins[row, at[row]]
            columns.append(column)
            live = at > 0
        grid = np.stack(columns[::-1], axis=1)
        flat = grid[grid >= 0].astype("<u4").tobytes()
        ends = np.cumsum((grid >= 0).sum(axis=1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def pack_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of each piece."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = struct.pack("<I", whole)
            elif len(data) > SHORT:
                ids = self.walk(self.prefixes(data))
                out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                by_length.setdefault(len(data), []).append((piece, data))
        for _, group in sorted(by_length.items()):
            self._sort_pairs()
            out.update(zip([p for p, _ in group], self._pack_equal([d for _, d in group])))
        return out

    def _fill(self, kept: dict[str, bytes], words: set[str], before: str) -> None:
        split = {w: self.pattern.findall(before + w) for w in words}
        packed = self.pack_pieces({p for pieces in split.values() for p in pieces})
        kept.update((w, b"".join([packed[p] for p in pieces])) for w, pieces in split.items())

    def _pack(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        packed = self.pack_pieces(set(pieces))
        return b"".join([packed[p] for p in pieces])

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. New words of all texts are encoded together,
        in rounds of at most half of what is kept."""
        begin = 0
        while begin < len(texts):
            heads: set[str] = set()
            tails: set[str] = set()
            split: list[list[tuple[str, list[str]]] | None] = []
            for text in texts[begin:]:
                if len(heads) + len(tails) >= CACHE // 2:
                    break
                lines = _lines(text)
                split.append(lines)
                for first, rest in lines or ():
                    heads.add(first)
                    tails.update(rest)
            for kept, words, before in ((self.heads, heads, ""), (self.tails, tails, " ")):
                missing = words.difference(kept)
                if len(kept) + len(missing) > CACHE:
                    kept.clear()
                    missing = words
                self._fill(kept, missing, before)
            line_end, head, tail = self._pack("\n"), self.heads.__getitem__, self.tails.__getitem__
            for at, lines in enumerate(split, begin):
                if lines is None:
                    yield self._pack(texts[at])
                else:
                    yield line_end.join([head(first) + b"".join(map(tail, rest)) for first, rest in lines])
            begin += len(split)

    def encode_packed(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The stored last tokens of one byte string taken as a single piece, for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b"") -> None:
        self.encoder, self.data = encoder, data
        self.last = encoder.prefixes(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.encoder.last_token(self.data, end, self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for ``data[start:stop]``; the number of prefixes encoded anew. Behind the edit, once the stored
        tokens agree over as many places as the longest token has bytes, all later ones agree."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        last, agreed = old[: start + 1], 0
        for end in range(start + 1, len(self.data) + 1):
            token = self.encoder.last_token(self.data, end, last)
            last.append(token)
            behind = end - start - len(new)
            agreed = agreed + 1 if behind > 0 and old[end - shift] == token else 0
            if agreed >= self.encoder.longest:
                self.last = last + old[end - shift + 1 :]
                return end - start
        self.last = last
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> PrefixEncoder:
    """One encoder a worker and vocabulary file; the file must be at ``path`` on every machine."""
    return PrefixEncoder(read_ranks(path), pattern)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: how many ids, their digest, and the digest of the bytes they decode to (and, if asked, the
    ids themselves). One scan, no shuffle."""
    schema = _ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _ARROW

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        from foldstone.llm.bpe import encoder_of  # the worker's own, kept from task to task

        encoder = encoder_of(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for packed in encoder.encode_many([x or "" for x in part.column("text").to_pylist()]):
            ids = memoryview(packed).cast("I").tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(ids)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return per_slice(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), handle, ddl, 2 * SLICE_BYTES)
