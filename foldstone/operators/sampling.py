"""Background samples: uniform, weighted, and weighted to match a distribution. Draws follow hashes, not task order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstone.functions.columns import INNER_EDGES_KM, bin_of, uniform


def sort_key(seed: Column | int, key: Column, weight: Column | None = None) -> Column:
    """Ascending order of this key is a draw without replacement: a uniform, or an exponential over the weight."""
    u = uniform(seed, key)
    return u if weight is None else -F.ln(u) / weight


def enough(cells: DataFrame, n: int, weight: str | None = None) -> None:
    """Raise unless ``n`` distinct rows can be drawn, with weights above zero if these are to count."""
    allowed = cells.count()
    if n > allowed:
        raise ValueError(f"{n} cells cannot be drawn from {allowed}.")
    if weight is not None:
        found = cells.where(F.col(weight) > 0).count()
        if not found:
            raise ValueError("no cell that may be drawn has a weight above zero")
        if found < n:
            raise ValueError(f"{n} cells cannot be drawn from {found} that have a weight above zero")


def sample_cells(cells: DataFrame, n: int, seed: int, weight: str | None = None) -> DataFrame:
    """``n`` distinct rows of ``cells`` (id, ...), with chances by ``weight`` (negative ones count as 0)."""
    enough(cells, n, weight)
    key = sort_key(seed, F.col("id"))
    if weight is not None:
        cells, key = cells.where(F.col(weight) > 0), sort_key(seed, F.col("id"), F.col(weight))
    return cells.withColumn("key", key).orderBy("key", "id").limit(n).drop("key")


def repeated_draws(cells: DataFrame, draws: int, n: int) -> DataFrame:
    """(draw, scheme, id) of ``draws`` uniform and weighted draws of ``n`` rows of ``cells`` (id, w) each; seeds 2k and 2k + 1."""
    each = cells.select("id", "w", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")).alias("draw"))
    plain = each.select("draw", "id", F.lit("uniform").alias("scheme"), sort_key(2 * F.col("draw"), F.col("id")).alias("key"))
    matched = each.where("w > 0").select("draw", "id", F.lit("road_weighted").alias("scheme"), sort_key(2 * F.col("draw") + 1, F.col("id"), F.col("w")).alias("key"))
    order = Window.partitionBy("draw", "scheme").orderBy("key", "id")
    return plain.unionByName(matched).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("draw", "scheme", "id")


def bin_shares(distances: DataFrame, edges: tuple[float, ...] = INNER_EDGES_KM) -> DataFrame:
    """(bin, n, share) of ``distances`` (km): all bins, empty ones too; shares are rounded half to even at 3 digits."""
    spark = distances.sparkSession
    counted = distances.groupBy(bin_of(F.col("km"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    whole = Window.partitionBy()  # over the bins alone, a fixed number of rows
    filled = bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return filled.select("bin", "n", F.bround(F.col("n") / F.sum("n").over(whole), 3).alias("share"))


def matched_weights(background: DataFrame, presences: DataFrame, edges: tuple[float, ...] = INNER_EDGES_KM) -> DataFrame:
    """``background`` (id, km) with ``weight``: the presences' share of its bin over the background's share."""
    ours = background.withColumn("bin", bin_of(F.col("km"), edges))
    have = ours.groupBy("bin").agg(F.count(F.lit(1)).alias("nb"))
    want = presences.groupBy(bin_of(F.col("km"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("np"))
    whole = Window.partitionBy()  # over the bins alone
    ratio = have.join(want, "bin", "full").select("bin", F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("np", F.lit(0)).alias("np"))
    ratio = ratio.select("bin", F.coalesce(F.try_divide(F.col("np") / F.sum("np").over(whole), F.col("nb") / F.sum("nb").over(whole)), F.lit(0.0)).alias("weight"))
    return ours.join(F.broadcast(ratio), "bin").select("id", "bin", "weight")  # one row a bin
