"""Assignment of features to tiles.

Tiles are spread over the cells of a grid as fine as there are tiles. Containment and
centroid modes need one cell of a feature: an equi-join with the cell's list of tiles and
array functions, without a shuffle of features while the cells are few. Modes that need
every touched tile take the feature's cells and report a pair only in the cell that holds
the lower corner of the intersection, so no duplicate has to be removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quadrille.functions import boxes
from quadrille.operators import ordering

#: Cells up to which the tile index is broadcast (some 100 bytes each); beyond, it is shuffled.
BROADCAST_CELLS = 100_000
TILE_FIELDS = ("tile_id", "ordinal", "box")


class TileIndex:
    """Tiles (tile_id, ordinal, box) over a grid; `bounds`, `side` and the cell table."""

    def __init__(self, tiles: DataFrame, side: int | None = None):
        own = tiles.select("tile_id", F.col("ordinal").cast("long"), "box").where(F.col("box").isNotNull())
        b = F.col("box")
        finite = lambda v: F.when(boxes.is_finite(v), v)
        stats = own.agg(F.count("*").alias("n"), F.min(finite(b.xmin)), F.min(finite(b.ymin)), F.max(finite(b.xmax)), F.max(finite(b.ymax))).first()
        self.count = stats[0]
        self.low = (stats[1] or 0.0, stats[2] or 0.0)
        spans = [(stats[3] or 0.0) - self.low[0], (stats[4] or 0.0) - self.low[1]]
        self.side = side or max(1, math.ceil(math.sqrt(self.count or 1)))
        self.step = tuple(s / self.side if s > 0 else 1.0 for s in spans)
        self.tiles = own
        near = [boxes.EPSILON * 2] * 2  # a tile takes what lies within epsilon outside
        cells = own.select(F.struct(*TILE_FIELDS).alias("tile"), F.explode(self.cells(b.xmin - near[0], b.ymin - near[1], b.xmax + near[0], b.ymax + near[1])).alias("_cell"))
        self.cells_table = cells
        self.listed = self._listed(own, near[0])
        self.small = self.listed <= BROADCAST_CELLS

    def _listed(self, tiles: DataFrame, near: float) -> int:
        """Rows of the cell table, counted without making them: tiles may overlap or be infinite."""
        b = F.col("box")
        wide = lambda axis, lo, hi: self._axis(hi + near, axis) - self._axis(lo - near, axis) + 1
        return tiles.agg(F.sum(wide(0, b.xmin, b.xmax) * wide(1, b.ymin, b.ymax))).first()[0] or 0

    def _axis(self, value: Column, axis: int) -> Column:
        place = F.floor((value - F.lit(self.low[axis])) / F.lit(self.step[axis]))
        inside = F.when(value < self.low[axis], F.lit(0)).when(value >= self.low[axis] + self.step[axis] * self.side, F.lit(self.side - 1)).otherwise(place)
        return inside.cast("long")

    def cell(self, x: Column, y: Column) -> Column:
        """The cell of a point; points outside belong to the border cells."""
        return self._axis(x, 0) * F.lit(self.side) + self._axis(y, 1)

    def cells(self, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
        """All cells that a box touches."""
        columns = F.sequence(self._axis(xmin, 0), self._axis(xmax, 0))
        rows = F.sequence(self._axis(ymin, 1), self._axis(ymax, 1))
        return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: c * F.lit(self.side) + r)))

    def lists(self) -> DataFrame:
        """(_cell, _tiles): the tiles of each cell."""
        table = self.cells_table.groupBy("_cell").agg(F.collect_list("tile").alias("_tiles"))
        return F.broadcast(table) if self.small else table

    def pairs(self) -> DataFrame:
        return F.broadcast(self.cells_table) if self.small else self.cells_table


def _best(found: Column, order) -> Column:
    """The tile of an array with the smallest order, null for an empty array."""
    return F.array_min(F.transform(found, lambda t: F.struct(*order(t), t.tile_id.alias("tile_id")))).tile_id


def assign_contains(features: DataFrame, tiles: DataFrame | TileIndex, bbox: str = "bbox") -> DataFrame:
    """Adds tile_id of the smallest tile that contains the box, the first of equal ones; null if none does."""
    index = tiles if isinstance(tiles, TileIndex) else TileIndex(tiles)
    b = F.col(bbox)
    x, y = boxes.centre(b)
    joined = features.withColumn("_cell", index.cell(x, y)).join(index.lists(), "_cell", "left")
    found = F.filter("_tiles", lambda t: boxes.contains(t.box, b))
    return joined.withColumn("tile_id", _best(found, lambda t: (boxes.area(t.box), t.ordinal))).drop("_cell", "_tiles")


def assign_disjoint(features: DataFrame, tiles: DataFrame | TileIndex, x: str = "cx", y: str = "cy") -> DataFrame:
    """Adds tile_id of the first tile whose half-open box holds the centroid; null if none does."""
    index = tiles if isinstance(tiles, TileIndex) else TileIndex(tiles)
    joined = features.withColumn("_cell", index.cell(F.col(x), F.col(y))).join(index.lists(), "_cell", "left")
    found = F.filter("_tiles", lambda t: boxes.holds_point(t.box, F.col(x), F.col(y)))
    return joined.withColumn("tile_id", _best(found, lambda t: (t.ordinal,))).drop("_cell", "_tiles")


def _pairs(features: DataFrame, index: TileIndex, bbox: str, predicate) -> DataFrame:
    """Every (feature, tile) with the predicate, once; adds the column _tile."""
    b, t = F.col(bbox), F.col("tile").box
    spread = features.withColumn("_cell", F.explode(index.cells(b.xmin, b.ymin, b.xmax, b.ymax)))
    met = spread.join(index.pairs(), "_cell")
    corner = index.cell(F.greatest(b.xmin, t.xmin), F.greatest(b.ymin, t.ymin))
    return met.where(predicate(b, t) & (F.col("_cell") == corner)).withColumnRenamed("tile", "_tile").drop("_cell")


def assign_covering(features: DataFrame, tiles: DataFrame | TileIndex, bbox: str = "bbox") -> DataFrame:
    """A row for each tile whose interior the box overlaps, with its tile_id."""
    index = tiles if isinstance(tiles, TileIndex) else TileIndex(tiles)
    return _pairs(features, index, bbox, boxes.overlaps).withColumn("tile_id", F.col("_tile").tile_id).drop("_tile")


def _one_each(pairs: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The best pair of each feature: an aggregation with partial results, not a sort of all pairs."""
    kept = [c for c in columns if c != key]
    best = pairs.groupBy(key).agg(F.min_by(F.struct(*kept, F.col("_tile").tile_id.alias("tile_id")), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col("_best")[c].alias(c) for c in columns], F.col("_best").tile_id.alias("tile_id"))


def assign_smallest_intersecting(features: DataFrame, tiles: DataFrame | TileIndex, key: str, bbox: str = "bbox") -> DataFrame:
    """Features with the smallest tile that their box touches, the first of equal ones; others are left out."""
    index = tiles if isinstance(tiles, TileIndex) else TileIndex(tiles)
    tile = F.col("_tile")
    return _one_each(_pairs(features, index, bbox, boxes.touches), key, [boxes.area(tile.box), tile.ordinal], features.columns)


def assign_min_expansion(features: DataFrame, tiles: DataFrame | TileIndex, key: str, extent: tuple[float, float, float, float], bbox: str = "bbox", spare_tiles: bool = True) -> DataFrame:
    """One tile for each feature: of those it overlaps, the one that grows least within the extent, then the smallest.

    Features without a box or an overlap get a tile by a reproducible number of their key, in the
    order of ordinals, or are left out without spare_tiles or where there are no tiles.
    """
    index = tiles if isinstance(tiles, TileIndex) else TileIndex(tiles)
    tile = F.col("_tile")
    growth = boxes.expansion(tile.box, F.col(bbox), boxes.literal_box(*extent))
    numeric = isinstance(features.schema[key].dataType, NumericType)
    best = _one_each(_pairs(features, index, bbox, boxes.overlaps), key, [growth, boxes.area(tile.box), tile.ordinal], features.columns)
    if not spare_tiles:
        return best
    lone = features.join(best.select(key), key, "left_anti")
    places = ordering.places(index.tiles.select("ordinal", "tile_id"), [F.col("ordinal"), F.col("tile_id")], "_place").select("_place", "tile_id")
    place = F.floor(ordering.uniform(F.col(key) if numeric else F.xxhash64(key)) * F.lit(index.count)) + 1
    spare = lone.withColumn("_place", place).join(F.broadcast(places) if index.count <= BROADCAST_CELLS else places, "_place")
    return best.unionByName(spare.select(*features.columns, "tile_id"))


def skipped(features: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Features without a tile."""
    return features.join(assigned.where(F.col("tile_id").isNotNull()).select(key), key, "left_anti")


def counts(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of rows seen and assigned (A3)."""
    done = assigned.agg(F.count("tile_id").alias("assigned"))
    return features.agg(F.count("*").alias("seen")).withColumn("_one", F.lit(1)).join(done.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("skipped", F.col("seen") - F.col("assigned"))


def describe(tiles: DataFrame) -> DataFrame:
    """One row: number of tiles, their common bounds, and whether no two of them overlap."""
    index = TileIndex(tiles)
    b = F.col("box")
    met = _pairs(index.tiles.withColumnRenamed("tile_id", "_own"), index, "box", boxes.overlaps).where(F.col("_own") != F.col("_tile").tile_id)
    twice = met.agg((F.count("*") == 0).alias("is_disjoint")).withColumn("_one", F.lit(1))
    whole = index.tiles.agg(F.count("*").alias("tiles"), F.min(b.xmin).alias("xmin"), F.min(b.ymin).alias("ymin"), F.max(b.xmax).alias("xmax"), F.max(b.ymax).alias("ymax"))
    return whole.withColumn("_one", F.lit(1)).join(twice, "_one").drop("_one")
