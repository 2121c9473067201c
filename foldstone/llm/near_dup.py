"""MinHash near-duplicates, verified by odd sketches and then on full sets.

1. A scan gives each document its set of word shingles as a 128-bit set hash, ``ROWS * BANDS`` MinHash samples folded into
   band keys, and an odd sketch: every sample flips one bit of a bitmap, so the bits that differ between two documents
   count the samples that differ.
2. Documents of one set are a class; only classes go on, so a group of copies, however large, is one row.
3. Classes that share a band key, a bucket, are candidates. First each is held against the smallest class of each of its
   buckets, by size and sketch, and against the most alike of these on the full sets. That is one pair a class, and it joins
   most of every group: a forest, whose trees' roots name the parts.
4. Then the buckets whose classes are not yet in one component are worked through whole. They are dealt into blocks of
   bounded size; pairs of blocks are tasks, but for two blocks of the component that most of the bucket is in. Sketches
   alone travel first. Where few pairs of different components may be alike, a task names these, and each pair meets its two full
   sets once, whatever buckets it shares. Where they outnumber the classes in them, these classes travel again with their full
   sets; the most alike are taken first, confirmed unless already linked, and the task returns a spanning forest.
5. The links that step 4 confirms are links of parts; the components of these, few beside the classes, are the answer.

So work follows the sizes of buckets that hold different components, not those of the chains that buckets form. A pair at exactly
0.75 shares no band with probability (1 - 0.75 ** 5) ** 40, about 2e-5, and less above; the sketch's limit lies five
standard deviations from it. Sets are held as 64-bit shingle hashes: "full sets" are equal up to collisions of these, and
classes and buckets of equal members up to collisions of 128 bits.

Defined cases: a text without words has the empty set and is linked with nothing; with fewer words than a shingle the whole
sequence is the one shingle; very long texts are taken whole, and weigh in a block by their shingles; rows of equal id and
text stand or fall together in ``near_duplicates``, while ``keep_one`` keeps one row of a group; rows without id take part, and
a component's id is the smallest id there is; an empty table gives no rows. ``keep_one`` leaves other columns as they are
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.components import connected_components, forest_roots
from foldstone.llm.text import as_bytes, fresh, mix, per_slice, slices, space_words, windows, word_hashes
from foldstone.session import materialize, release, ship

WORDS, PERCENT = 5, 75
ROWS, BANDS, SKETCH_BITS = 5, 40, 512
LANES = SKETCH_BITS // 64
#: Pairs whose sketches differ in more bits cannot reach the similarity (five standard deviations from its mean of 83).
MOST_APART = 145
#: A block has about so many classes and shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 384, 1_500_000
#: Pairs of one class that meet its set in one task.
PAIRS_A_TASK = 2048

_random = np.random.default_rng(20_24)
_TIMES = _random.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def shingle_sets(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): each text's distinct shingles, sorted, from ``starts[i]`` to ``starts[i + 1]``."""
    groups = [space_words(t.lower()) for t in texts]
    sizes = np.array([len(g) for g in groups], np.int64)
    owner = np.repeat(np.arange(len(groups)), sizes)
    flat = word_hashes([w for g in groups for w in g])
    keys = windows(flat, width)
    inside = owner[: len(keys)] == owner[width - 1 :] if len(keys) else np.empty(0, bool)
    keys, owners = keys[inside], owner[: len(keys)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        begin = np.cumsum(sizes) - sizes
        own = sizes[short].astype(np.uint64)
        for i in range(width - 1):
            more = sizes[short] > i
            own[more] = mix(own[more] ^ flat[begin[short[more]] + i])
        keys, owners = np.concatenate([keys, own]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
    ends = np.searchsorted(owners, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(ends, ends[1:]):
        keys[a:b].sort()  # text by text, in place
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[new], owners[new]
    return keys, np.searchsorted(owners, np.arange(len(texts) + 1))


def signatures(keys: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Set hashes, sketches and band keys of the non-empty sets, and which texts they are of."""
    live = np.flatnonzero(np.diff(starts) > 0)
    begin = starts[:-1][live]
    out = {"at": live, "h1": np.empty(0, np.int64), "h2": np.empty(0, np.int64), "sketch": np.empty((0, LANES), np.int64), "bands": np.empty((0, BANDS), np.int64)}
    if not len(live):
        return out
    out["h1"] = np.add.reduceat(mix(keys), begin).view(np.int64)
    out["h2"] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), begin).view(np.int64)
    half = (keys >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((len(live), ROWS * BANDS), np.uint32)
    for k, (a, b) in enumerate(zip(_TIMES, _PLUS)):
        samples[:, k] = np.minimum.reduceat(half * a + b, begin)
    numbered = samples.astype(np.uint64) | (np.arange(ROWS * BANDS, dtype=np.uint64) << np.uint64(32))
    bit = (mix(numbered) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(live))[:, None] * SKETCH_BITS
    flips = np.bincount(bit.ravel(), minlength=len(live) * SKETCH_BITS).astype(np.uint8) & 1
    out["sketch"] = np.packbits(flips.reshape(len(live), SKETCH_BITS), axis=1).view(np.int64)
    band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(live), axis=0)
    for r in range(ROWS):
        band = mix(band ^ samples[:, r::ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["bands"] = band.view(np.int64)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _sign(part: pa.RecordBatch) -> pa.RecordBatch:
    keys, starts = shingle_sets(as_bytes(part.column("text")))
    found = signatures(keys, starts)
    place = np.full(part.num_rows, -1)
    place[found["at"]] = np.arange(len(found["at"]))
    pick = pa.array(place, pa.int64(), mask=place < 0)
    lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
    columns = [pa.array(found["h1"]), pa.array(found["h2"]), lists(found["sketch"]), lists(found["bands"])]
    more = [c for c in part.schema.names if c not in ("doc_id", "text")]
    schema = pa.schema([*_SIGNED, *(pa.field(c, pa.int64()) for c in more)])
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts), pa.int64()), *(c.take(pick) for c in columns), *(part.column(c) for c in more)], schema=schema)


def _alike(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= PERCENT * (len(one) + len(other) - common)


def candidates(low: np.ndarray, high: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(bits apart, a, b) of the pairs of a row of ``low`` and one of ``high`` (index arrays; the same one: each pair once)
    that lie in different groups and may reach the similarity by their sketches and sizes."""
    same, found = low is high, []
    step = max(1, 400_000 // max(len(high), 1))
    for i in range(0, len(low), step):
        some = low[i : i + step]
        apart = np.bitwise_count(sketches[some][:, None] ^ sketches[high][None]).sum(axis=2, dtype=np.int32)
        least, most = np.minimum(sizes[some][:, None], sizes[high][None]), np.maximum(sizes[some][:, None], sizes[high][None])
        a, b = np.nonzero((apart <= MOST_APART) & (100 * least >= PERCENT * most) & (group[some][:, None] != group[high][None]))
        if same:
            a, b = a[b > a + i], b[b > a + i]
        found.append(np.stack([apart[a, b], some[a], high[b]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), int)


def spanning_links(pairs: np.ndarray, nodes: np.ndarray, group: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, between groups, of the pairs that hold on the full sets; the most alike are tried first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for _, a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        ra, rb = root(int(group[a])), root(int(group[b]))
        if ra != rb and _alike(sets[a], sets[b]):
            parent[max(ra, rb)] = min(ra, rb)
            links.append((int(nodes[a]), int(nodes[b])))
    return links


def _per_task(answer):
    """For rows sorted by (band, lo, hi): ``answer(rows)`` of each such group."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(keys[:, a].tolist())
                if held and now != key:
                    yield answer(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    return over


def _pairs_of(rows: pa.Table) -> np.ndarray:
    block = rows.column("block").to_numpy()
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    low = np.flatnonzero(block == lo)
    high = low if lo == hi else np.flatnonzero(block == hi)
    sketches = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
    return candidates(low, high, sketches, rows.column("n").to_numpy(), rows.column("part").to_numpy())


_DEALT = "band long, lo int, hi int, block int, node long, part long, n long, sketch array<long>"


def _flagged(rows: pa.Table) -> pa.RecordBatch:
    """The candidate pairs of a task (``node`` and ``other``, with their parts), if they are no more than the rows in them; else
    these rows, whose ``other`` is null. So what leaves a task never outgrows what came."""
    pairs = _pairs_of(rows)[:, 1:]
    held = np.unique(pairs)
    node = rows.column("node").to_numpy()
    if len(pairs) <= len(held):
        turned = (node[pairs[:, 0]] > node[pairs[:, 1]])[:, None]
        ends = np.where(turned, pairs[:, ::-1], pairs)
        found, other = rows.take(pa.array(ends[:, 0])), rows.select(["node", "part"]).take(pa.array(ends[:, 1])).columns
    else:
        found, other = rows.take(pa.array(held)), [pa.nulls(len(held), pa.int64())] * 2
    found = found.append_column("other", other[0]).append_column("other_part", other[1]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in found.columns], names=found.column_names)


def _confirmed(rows: pa.Table) -> pa.RecordBatch:
    """The links of parts that a task confirms."""
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    part = rows.column("part").to_numpy()
    links = spanning_links(_pairs_of(rows), part, part, sets)
    return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with sets su and sv those whose sets are alike, without these."""
    for batch in batches:
        alike = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("su"), batch.column("sv"))]
        yield batch.drop_columns(["su", "sv"]).filter(pa.array(alike, pa.bool_()))


def _sets_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the classes ``wanted`` (node, at, h1, h2), from the texts of ``source`` (doc_id, k1, text); ``at``
    is the id and text key of one of a class's rows."""
    met = source["doc_id"].eqNullSafe(wanted["at.doc_id"]) & source["k1"].eqNullSafe(wanted["at.k1"])
    texts = source.join(wanted, met).select("text", "node", "h1", "h2")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, starts = shingle_sets(as_bytes(part.column("text")))
                found = set_hashes(keys, starts)
                own = (found[0] == part.column("h1").to_numpy()) & (found[1] == part.column("h2").to_numpy())
                sets = [keys[a:b].tobytes() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(pa.array(own))

    # repeated rows of one id and text give one row
    return texts.mapInArrow(with_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _open_tasks(met: DataFrame, parts: DataFrame, marks: DataFrame) -> DataFrame:
    """The block tasks (``_DEALT``) of all buckets of ``met`` (band, node) that hold classes of several components."""
    rows = met.join(parts, "node", "left").select("band", "node", F.coalesce("label", "node").alias("part"))
    rows = materialize(rows.join(marks, "node"), "open")
    per = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"))
    top = F.max(F.struct("c", "w", "part")).alias("top")
    bands = per.groupBy("band").agg(top, F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("parts"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).where("parts > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK_CLASSES), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    bands = bands.select("band", "x1", "x2", "c", F.col("top.part").alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("mains"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("others"))
    # buckets of the same classes are one
    bands = bands.groupBy("x1", "x2", "c").agg(F.min(F.struct("band", "main", "mains", "others")).alias("b")).select("b.*")
    bands = materialize(bands, "bands")  # so that the join may split a bucket of many classes
    dealt = rows.join(bands, "band")
    place, is_main = F.xxhash64("node"), F.col("part") == F.col("main")
    block = F.when(is_main, F.pmod(place, F.col("mains"))).otherwise(F.col("mains") + F.pmod(place, F.col("others"))).cast("int")
    last = F.col("mains") + F.col("others") - 1
    other = F.explode(F.when(is_main, F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0), last))).alias("other")
    dealt = dealt.select("band", "node", "part", "n", "sketch", block.alias("block"), other)
    return dealt.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "part", "n", "sketch")


def _parts(source: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of each of ``classes`` that has a link to its pivot (node, part; any other is a part by itself), and the label of
    each part that has links to others (part, label): equal labels are components of all linked pairs."""
    bands = classes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    buckets = materialize(buckets, "buckets")  # so that the join may split a bucket of many classes
    met = materialize(bands.join(buckets, "band"), "met")
    release(buckets)
    marks = classes.select("node", "n", "sketch")
    sets = materialize(_sets_of(source, classes.join(met.select("node").distinct(), "node").select("node", "at", "h1", "h2")), "sets")

    pivots = materialize(marks.join(met.select(F.col("pivot").alias("node")).distinct(), "node").select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("sketch").alias("ps")), "pivots")
    ties = met.where("node <> pivot").select("node", "pivot").repartition("node").distinct()  # a class has at most BANDS rows
    ties = ties.join(marks, "node").join(pivots, "pivot")
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("ps")[i])) for i in range(1, LANES)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("ps")[0])))
    near = ties.withColumn("apart", apart).where((F.col("apart") <= MOST_APART) & (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")))
    best = materialize(near.groupBy("node").agg(F.min(F.struct("apart", "pivot"))["pivot"].alias("v")).withColumnRenamed("node", "u"), "best")

    def alike(pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (u, v, further columns) those that hold on the full sets, as (u, v, further ones). A v of many pairs, as the pivot
        of a large group is, sends its set to several tasks, each of which takes about ``PAIRS_A_TASK`` of them."""
        parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("parts"))
        parts = materialize(parts, "pair-parts")  # so that the join may split it
        dealt = pairs.join(parts, "v").select(*pairs.columns, F.pmod(F.xxhash64("u"), "parts").cast("int").alias("salt"))
        sent = sets.withColumnRenamed("node", "v").join(parts, "v").select("v", F.col("shingles").alias("sv"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        both = dealt.join(sent, ["v", "salt"]).join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
        return both.select(*pairs.columns, "su", "sv").mapInArrow(_hold, ", ".join(f"{c} long" for c in pairs.columns))

    parts = forest_roots(alike(best))  # a pivot is the smallest of its bucket
    dealt = _open_tasks(met.select("band", "node"), parts, marks)
    in_order = lambda df: df.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    flagged = materialize(in_order(dealt).mapInArrow(_per_task(_flagged), _DEALT + ", other long, other_part long"), "flagged")
    tried = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    named = flagged.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"), F.col("part").alias("pu"), F.col("other_part").alias("pv"))
    pairs = materialize(named.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    crowds = flagged.where("other is null").drop("other", "other_part")
    crowds = in_order(crowds.join(sets, "node").select(*crowds.columns, "shingles")).mapInArrow(_per_task(_confirmed), "u long, v long")
    links = alike(pairs).select(F.col("pu").alias("u"), F.col("pv").alias("v")).unionByName(crowds)
    labels = connected_components(links)
    release(met, sets, best, pivots, flagged, pairs)
    return parts.withColumnRenamed("label", "part"), labels.withColumnRenamed("node", "part")


def _linked(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``keyed`` (doc_id, text, k1: a key of the text, and further long columns, which stay), and its sets:
    h1, h2, doc_id (the smallest) and label, equal for linked sets."""
    ship(keyed.sparkSession)
    source = keyed.select("doc_id", "k1", "text")
    more = "".join(f", {c} long" for c in keyed.columns if c not in ("doc_id", "text"))
    signed = materialize(per_slice(keyed, _sign, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>, bands array<long>" + more), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "k1")).alias("at"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts, labels = _parts(source, classes)
    named = classes.select("node", "h1", "h2", "doc_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = named.join(labels, "part", "left").withColumn("label", F.coalesce("label", "part")).drop("part")
    return signed, materialize(named, "labelled")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    signed, named = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("k1")))
    first = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")
    answer = named.join(first, "label").select("h1", "h2", "component_id")
    rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(answer, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def set_hashes(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two set hashes of every text, 0 where the set is empty."""
    h1, h2 = np.zeros(len(starts) - 1, np.int64), np.zeros(len(starts) - 1, np.int64)
    live = np.flatnonzero(np.diff(starts) > 0)
    if len(live):
        begin = starts[:-1][live]
        h1[live] = np.add.reduceat(mix(keys), begin).view(np.int64)
        h2[live] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), begin).view(np.int64)
    return h1, h2


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id (rows without id come last); all
    columns as they were. Rows are told apart by id and two hashes of the text; of rows equal in these any one stays."""
    names = fresh(docs, "id", "k1", "k2", "id_of", "k1_of", "k2_of", "stays")
    own, of, stays = names[:3], names[3:6], names[6]
    values = dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))))
    keyed = docs.withColumns(values)
    signed, named = _linked(keyed.select(F.col(own[0]).alias("doc_id"), "text", F.col(own[1]).alias("k1"), F.col(own[2]).alias("k2")))
    rows = signed.where("n_shingles > 0").groupBy("doc_id", "k1", "k2", "h1", "h2").agg(F.count(F.lit(1)).alias("c"))
    rows = materialize(rows.join(named.select("h1", "h2", "label"), ["h1", "h2"]).drop("h1", "h2"), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    firsts = materialize(rows.groupBy("label").agg(F.min(rank).alias("first")), "firsts")
    found = rows.join(firsts, "label").withColumn(stays, rank.eqNullSafe(F.col("first"))).where(F.expr(f"not `{stays}` or c > 1"))
    found = materialize(found.select(*[F.col(k).alias(n) for k, n in zip(("doc_id", "k1", "k2"), of)], stays), "found")
    release(rows, firsts, signed, named)
    same = reduce(lambda a, b: a & b, [keyed[a].eqNullSafe(found[b]) for a, b in zip(own, of)])
    out = keyed.join(found, same, "left_anti")
    repeated = found.where(F.col(stays))
    if repeated.limit(1).count():
        again = reduce(lambda a, b: a & b, [keyed[a].eqNullSafe(repeated[b]) for a, b in zip(own, of)])
        out = out.unionByName(keyed.join(repeated, again, "left_semi").dropDuplicates(own))
    return out.drop(*own)


def oracle() -> str:
    """DuckDB SQL for ``near_duplicates``: every pair of sets that share a shingle, compared in full."""
    return r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
h as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
l as (select x, y from h union all select y, x from h),
r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on l.x = r.y),
m as (select x doc_id, min(y) component_id from r group by x)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, d.doc_id = component_id kept from documents d left join n using (doc_id) join m using (doc_id)"""
