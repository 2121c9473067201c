"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards own ``vnodes`` points each on a ring of 2 ** 32 places; a row's place is the hash of its text, so equal texts stand
together, and the first point clockwise owns it. No shard takes more than its bound: with ``rows`` the bounds are the floor or
ceiling of the mean, so counts are at most one apart. What overflows a full shard, from the end of its own arcs, goes on
clockwise to the next shard with room; all other rows stay where the ring puts them.

Equal bounds have a price, on the tables of sf0.1: of 583 groups of equal texts 2 stand on two shards, since a full shard's
overflow cuts them, and a 41st shard moves 4.2 % of the rows where a ring without bounds would move 2.4 %. ``slack`` lowers both.

The rows of an arc are counted in cells, a number of them in proportion to the arc's rows (a text that holds a third of all
rows spreads over many cells). The driver plans on the counts alone: at most ``shards * vnodes + cells`` rows, fixed by
parameters whatever the input. The texts are read once, for a narrow table that all counts
and ranks are taken from; rows take their rank in their cell, and no text is shuffled.

Defined cases: a null text has size 16, checksum 0 and the place of the empty text; very long texts count by their bytes, hashed
whole; rows without doc_id are placed like others; ties in place are ranked by checksum, size and id, and repeated rows take ranks
of their own; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstone.session import materialize

RING = 1 << 32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order. A shard's points do not depend on how many shards there are."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") % RING, s) for s in range(shards) for v in range(vnodes))


def plan(points: list[tuple[int, int]], cells: list[tuple[int, int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the rows of each cell go.

    ``cells``: (arc, cell, rows); arc i is owned by ``points[i]``. Returns (arc, cell, from rank, to rank, shard, slot of the
    first), ranks from 0 and the end exclusive.
    """
    by_arc: dict[int, list[tuple[int, int]]] = {}
    for arc, cell, rows in sorted(cells):
        by_arc.setdefault(arc, []).append((cell, rows))
    taken = [0] * len(bounds)
    out: list[tuple[int, int, int, int, int, int]] = []
    over: list[tuple[int, int, int, int]] = []  # (arc, cell, from, to) beyond the owner's bound

    def put(arc: int, cell: int, start: int, stop: int, shard: int) -> int:
        n = min(stop - start, bounds[shard] - taken[shard])
        if n > 0:
            out.append((arc, cell, start, start + n, shard, taken[shard]))
            taken[shard] += n
        return start + max(n, 0)

    for arc, parts in by_arc.items():
        for cell, rows in parts:
            at = put(arc, cell, 0, rows, points[arc][1])
            if at < rows:
                over.append((arc, cell, at, rows))
    for arc, cell, start, stop in over:
        step = arc
        while start < stop:
            step = (step + 1) % len(points)
            start = put(arc, cell, start, stop, points[step][1])
    return out


def balanced_bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def loose_bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Bounds of (1 + slack) times the mean: fewer rows move when shards come or go."""
    return [-(-int(rows * (1 + slack) + 1) // shards)] * shards


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 128, slack: float = 0.0, cells: int = 60_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``; with ``slack`` 0 counts are at most one apart."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(RING)).alias("place"),
        F.xxhash64("doc_id").alias("salt"),
    )
    rows = materialize(rows, "ring")
    arc_of = spark.createDataFrame(_ranges(points), "bucket int, low long, high long, arc int")
    rows = rows.withColumn("bucket", F.shiftright("place", 20).cast("int"))
    # 4,096 buckets of the ring with the arcs that reach into each: a table fixed by shards * vnodes
    rows = rows.join(F.broadcast(arc_of), "bucket").where((F.col("place") > F.col("low")) & (F.col("place") <= F.col("high"))).drop("bucket", "low", "high")
    in_arc = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(in_arc.values())
    split = [(arc, max(1, -(-n * cells // max(total, 1)) if n * cells > 64 * total else 1)) for arc, n in sorted(in_arc.items())]
    if not split:
        split = [(0, 1)]
    rows = rows.join(F.broadcast(spark.createDataFrame(split, "arc int, parts int")), "arc")
    rows = rows.withColumn("cell", F.pmod("salt", F.col("parts")).cast("int")).drop("parts")
    counted = [tuple(r) for r in rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = loose_bounds(total, shards, slack) if slack else balanced_bounds(total, shards)
    planned = plan(points, counted, bounds) or [(0, 0, 0, 0, 0, 0)]
    where = spark.createDataFrame(planned, "arc int, cell int, low long, high long, shard int, slot long")
    order = Window.partitionBy("arc", "cell").orderBy("place", "text_crc32", "size", F.col("doc_id").asc_nulls_first())
    ranked = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    found = ranked.join(where, ["arc", "cell"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))


def _ranges(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(bucket, above, up to, arc) for every part of an arc that lies in one of 4,096 equal parts of the ring."""
    out, width = [], RING >> 12
    ends = [p for p, _ in points]
    spans = [(a, b, i) for i, (a, b) in enumerate(zip([-1, *ends], ends))] + [(ends[-1], RING - 1, 0)]
    for low, high, arc in spans:
        for bucket in range(max(low + 1, 0) // width, high // width + 1) if high > low else ():
            out.append((bucket, max(low, bucket * width - 1), min(high, (bucket + 1) * width - 1), arc))
    return out
