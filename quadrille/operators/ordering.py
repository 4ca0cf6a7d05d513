"""Sort modes and keys, unions and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.curves import curve_key

# Accepted names of sort modes.
MODES = {"none": "none", "": "none", "columns": "columns", "cols": "columns", "column": "columns", "z": "zorder", "zorder": "zorder", "z-order": "zorder", "morton": "zorder", "hilbert": "hilbert", "h": "hilbert"}


def sort_mode(name: str | None) -> str:
    mode = MODES.get((name or "none").strip().lower())
    if mode is None:
        raise ValueError(f"unknown sort mode: {name}")
    return mode


def sort_keys(spec: str | None) -> list[tuple[str, bool]]:
    """`a:asc,b:desc` as (column, ascending); whatever is not `desc` ascends."""
    keys = []
    for part in (spec or "").split(","):
        name, _, way = part.strip().partition(":")
        if name.strip():
            keys.append((name.strip(), way.strip().lower() != "desc"))
    return keys


def order_by(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys]


def cluster(df: DataFrame, x: str, y: str, curve: str = "hilbert", bits: int = 24, tie: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds the curve key, ranges the rows by it and sorts them within partitions.

    Rows without a point have a null key and come last.
    """
    name = f"{'z' if sort_mode(curve) == 'zorder' else 'h'}key{bits}"
    keyed = curve_key(df, F.col(x), F.col(y), sort_mode(curve), bits)
    key = F.col(name).asc_nulls_last()
    ranged = keyed.repartitionByRange(partitions, key) if partitions else keyed.repartitionByRange(key)
    return ranged.sortWithinPartitions(key, *(tie or []))


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place in the order, from 1: ranged and sorted by many tasks, not one window.

    The order must be total, as the rows are counted in one job and numbered in another.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    numbered = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return df.sparkSession.createDataFrame(numbered, schema, verifySchema=False)


def union_promote(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def unique_names(names: list[str]) -> list[str]:
    """Names without repetition, in order."""
    return list(dict.fromkeys(names))


def uniform(key: Column, seed: int = 42) -> Column:
    """A reproducible number in [0, 1) for a row's key."""
    mixed = F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * F.lit(2654435761) + F.lit(seed) * F.lit(40503), F.lit(4294967296))
    return F.pmod(mixed * F.lit(69069) + F.lit(1), F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key falls below the fraction (M1, M3): the same rows in every run and partitioning."""
    return df.where(uniform(F.col(key), seed) < fraction)


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """`rows` rows without replacement, those with the smallest numbers (M2): a top-k, not a sort."""
    return df.withColumn("_u", uniform(F.col(key), seed)).orderBy("_u", key).limit(rows).drop("_u")
