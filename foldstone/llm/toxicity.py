"""Toxicity: a character n-gram linear classifier under naive Bayes log-count ratios.

Features are the hashed character n-grams that a lower-cased text holds (presence, not counts). Each is scaled by its
log-count ratio between the two classes and the scaled features of a text to unit length, so that a long text is judged like
a short one; a logistic model is fitted on them. The counts come from all training rows, map-side first, as at most
``2 ** bits`` rows; of the features that enough texts hold, those whose shares in the two classes differ by ``least_z``
standard errors are kept, the most different ones first. The weights are fitted on at most ``max_rows`` training rows (those with the lowest hashes), the documented bound
of what the driver gathers. Scoring is one scan: the weights are a fixed-size table.

Defined cases: null and empty texts have no features and score by the intercept alone; very long texts are read whole; labels
without a document, or null labels, are left out, and so are rows without id from learning; repeated documents count and are
scored each; with one class or no label at all every score is the share of label 1 (0 where there is none); an empty table gives
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.text import mix, per_slice, slices
from foldstone.session import materialize, ship


#: Bytes of text handled at once: arrays of their n-grams stay in a core's cache.
SLICE = 500_000


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5)
    bits: int = 20
    features: int = 8192
    min_texts: int = 5
    least_z: float = 4.0
    alpha: float = 1.0
    l2: float = 0.1
    steps: int = 200
    max_rows: int = 12_000


@dataclass(frozen=True)
class Model:
    """``weight`` (the log-count ratio is multiplied in) and ``square`` (of that ratio, for a text's length) by feature
    bucket, both 0 where not kept."""

    weight: np.ndarray
    square: np.ndarray
    intercept: float
    settings: Settings


def gram_places(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature bucket) of every character n-gram, repeats included."""
    lowered = [" " + t.lower() + " " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    mask, owners, buckets = np.uint64((1 << settings.bits) - 1), [], []
    for n in settings.orders:
        m = len(points) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + points[i : i + m]
        inside = owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][inside])
        buckets.append((mix(key[inside]) & mask).astype(np.int32))
    if not owners:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(owners), np.concatenate(buckets)


def _present(owner: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, bucket) once, in order."""
    keys = (owner.astype(np.int64) << bits) | bucket
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return keys >> bits, (keys & ((1 << bits) - 1)).astype(np.int32)


def _texts(part: pa.RecordBatch) -> list[str]:
    return [x or "" for x in part.column("text").to_pylist()]


def class_counts(train: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(texts of label 0, texts of label 1) that hold each bucket, over all rows of ``train`` (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << settings.bits), np.int64)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                label = np.asarray(part.column("label").to_pylist(), np.int64)
                owner, bucket = _present(*gram_places(_texts(part), settings), settings.bits)
                for y in (0, 1):
                    total[y] += np.bincount(bucket[label[owner] == y], minlength=total.shape[1])
        held = np.flatnonzero(total.sum(axis=0))
        for i in range(0, len(held), 50_000):
            at = held[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "clean": pa.array(total[0, at], pa.int64()), "toxic": pa.array(total[1, at], pa.int64())})

    ship(train.sparkSession)
    sums = train.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= settings.min_texts)
    found = sums.toArrow()
    out = np.zeros((2, 1 << settings.bits), np.int64)
    at = found.column("bucket").to_numpy()
    out[0, at], out[1, at] = found.column("clean").to_numpy(), found.column("toxic").to_numpy()
    return out[0], out[1]


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, settings: Settings) -> tuple[np.ndarray, float]:
    """L2 logistic regression on a sparse matrix, by accelerated gradient steps; the intercept is not shrunk."""
    n = len(y)
    square = np.bincount(rows, values**2, minlength=n).max(initial=0.0)
    step = 4.0 / (square + 1.0 + 4.0 * settings.l2 / max(n, 1))
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(settings.steps):
        z = np.bincount(rows, values * vw[columns], minlength=n) + vb
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        nw = vw - step * (np.bincount(columns, values * error[rows], minlength=width) + settings.l2 / n * vw)
        nb = vb - step * error.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def bounded_sample(train: DataFrame, count: int, most: int) -> DataFrame:
    """All rows of ``train``, or those with the lowest hashes of id and text: ``most`` at the most."""
    if count <= most:
        return train
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    cut = int((1 << 40) * 0.9 * most / count)
    while train.where(place < cut).count() > most:  # only repeated rows can make this necessary
        cut //= 2
    return train.where(place < cut)


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """The classifier from ``train`` (doc_id, text, label 0 or 1)."""
    train = materialize(train, "toxicity-train")
    clean, toxic = class_counts(train, settings)
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    weight, square = np.zeros(1 << settings.bits, np.float32), np.zeros(1 << settings.bits, np.float32)
    if not n0 or not n1:
        share = 1.0 if n1 else 0.0
        return Model(weight, square, 40.0 if share else -40.0, settings)
    ratio = np.log((toxic + settings.alpha) / (n1 + 2 * settings.alpha)) - np.log((clean + settings.alpha) / (n0 + 2 * settings.alpha))
    held = np.flatnonzero(clean + toxic >= settings.min_texts)
    share = (clean + toxic)[held] / (n0 + n1)
    error = np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    apart = np.abs(toxic[held] / n1 - clean[held] / n0) / np.maximum(error, 1e-12)
    strong, held = -apart[apart >= settings.least_z], held[apart >= settings.least_z]
    kept = np.sort(held[np.lexsort((held, strong))[: settings.features]])
    place = np.full(1 << settings.bits, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def held_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                owner, bucket = gram_places(_texts(part), settings)
                at = place[bucket]
                owner, at = _present(owner[at >= 0], at[at >= 0], settings.bits)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_pydict({"label": part.column("label").cast(pa.int32()), "features": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32()))})

    got = bounded_sample(train, n0 + n1, settings.max_rows).mapInArrow(held_features, "label int, features array<int>").toArrow().combine_chunks()
    lists, y = got.column("features").combine_chunks(), np.asarray(got.column("label").to_numpy(), float)
    columns = np.asarray(lists.flatten())
    rows = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths()))
    scale = ratio[kept]
    weight[kept], square[kept] = scale, scale**2
    values = scale[columns] / _length(rows, square[kept][columns], len(y))[rows]
    w, b = fit_logistic(rows, columns, values, y, len(kept), settings)
    weight[kept] *= w
    return Model(weight, square, float(b), settings)


def _length(owner: np.ndarray, squares: np.ndarray, texts: int) -> np.ndarray:
    """The length of each text's vector, 1 where it has no feature."""
    found = np.sqrt(np.bincount(owner, squares, minlength=texts))
    return np.where(found > 0, found, 1.0)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    owner, bucket = gram_places(texts, model.settings)
    live = model.square[bucket] > 0
    owner, bucket = _present(owner[live], bucket[live], model.settings.bits)
    z = np.bincount(owner, model.weight[bucket], minlength=len(texts)) / _length(owner, model.square[bucket], len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``. One scan, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats, whatever the input

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        score = score_texts(_texts(part), sent.value)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), "text")
    return per_slice(source, handle, "doc_id long, held_out boolean, score double, predicted int", SLICE)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that are not held out. A repeated label counts once, as its
    largest; repeated documents stay. Labels grow with the documents, so they are never broadcast: the join is planned
    alike at every size, and the labels are written first so that it may split an id of many rows."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    marks = materialize(marks, "toxicity-labels")
    return docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(marks.hint("merge"), "doc_id")
