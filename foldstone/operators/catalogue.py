"""Cleaning of event catalogues, and accounts of what goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.columns import ACCURACY_KM, event_time, lookup, stripped


def clean_catalogue(raw: DataFrame, country: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of one country (any case, any white space around), their accuracy in kilometres and time; what cannot be
    read is NULL. No shuffle."""
    same = F.coalesce(F.lower(stripped(F.col("country_name"))) == country.lower(), F.lit(False))
    return raw.where(same).select("event_id", event_time(F.col("event_date")).alias("event_time"), lookup(F.col("location_accuracy"), ACCURACY_KM).alias("accuracy_km"), *keep)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    names = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*names), F.struct(*order))  # a partial minimum, no window
    return rows.groupBy(*keys).agg(first.alias("__first")).select(*keys, *[F.col("__first")[c].alias(c) for c in names])


def has_all(rows: DataFrame, needed: list[str]) -> Column:
    """Whether a row has every needed value; not-a-number counts as missing."""
    kinds, whole = dict(rows.dtypes), F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            whole = whole & ~F.isnan(c)
    return F.coalesce(whole, F.lit(False))


def complete(rows: DataFrame, needed: list[str]) -> DataFrame:
    """The rows that have every needed value."""
    return rows.where(has_all(rows, needed))


def row_account(rows: DataFrame, needed: list[str]) -> DataFrame:
    """One row: how many rows there are, how many have every needed value, and how many are dropped."""
    whole = has_all(rows, needed)
    return rows.agg(F.count(F.lit(1)).alias("before"), F.count_if(whole).alias("after"), F.count_if(~whole).alias("dropped"))


def one_scheme(rows: DataFrame, scheme: str, cutoff: float) -> DataFrame:
    """Presences located to within ``cutoff``, and the background of one scheme."""
    return rows.where(((F.col("label") == 1) & (F.col("accuracy_km") <= cutoff)) | (F.col("abs_set") == scheme))


def set_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact median, mean and count of a value by set."""
    return rows.groupBy(by).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))

