"""A stream of features against a fixed tile set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadrille.operators.assign import TileIndex, assign_contains, assign_disjoint


def assign_stream(features: DataFrame, tiles: DataFrame, mode: str = "disjoint", **columns: str) -> DataFrame:
    """Adds tile_id to a streaming DataFrame: a stream-static join without state or watermark."""
    index = TileIndex(tiles)
    if mode == "disjoint":
        return assign_disjoint(features, index, **columns)
    if mode == "contains":
        return assign_contains(features, index, **columns)
    raise ValueError(f"unknown mode: {mode}")
