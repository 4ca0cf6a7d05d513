"""Tile sets: regular grids and balanced partitions of points.

The splitter works on the driver on a bounded sample, or on the cells of a distributed
grid histogram as weighted points, so its memory does not follow the data. What it promises
then holds for the sample or the cells; `partition_whole` keeps the promises for all points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.operators import assign
from quadrille.operators.ordering import sample_rows, uniform

TILES = "tile_id string, ordinal long, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
#: Points of a sample, and cells of a side of the histogram, that reach the driver at most.
SAMPLE_ROWS, HISTOGRAM_SIDE = 100_000, 512


def tile_name(number: int) -> str:
    return f"tile_{number:06d}"


def tile_number(name: str) -> int | None:
    """The number at the end of a tile's name."""
    digits = name.rpartition("_")[2]
    return int(digits) if digits.isdigit() else None


def tile_frame(spark: SparkSession, sides: np.ndarray, names: list[str] | None = None) -> DataFrame:
    """(tile_id, ordinal, box) from rows of xmin, ymin, xmax, ymax."""
    rows = [(names[i] if names else tile_name(i), i, tuple(map(float, s))) for i, s in enumerate(sides)]
    return spark.createDataFrame(rows, TILES)


def grid(spark: SparkSession, xmin: float, ymin: float, columns: int, rows: int, width: float, height: float) -> DataFrame:
    """A regular grid, numbered row by row."""
    number = F.col("id")
    x, y = F.lit(xmin) + (number % columns) * F.lit(width), F.lit(ymin) + F.floor(number / columns) * F.lit(height)
    return spark.range(columns * rows).select(F.format_string("tile_%06d", number).alias("tile_id"), number.alias("ordinal"), boxes.box(x, y, x + width, y + height).alias("box"))


@dataclass
class Splitter:
    """Recursive R*-style splits: minimal margins, then overlap, then area.

    `fill` is the share of the capacity that either side of a split must hold, `band` the
    middle share of the allowed positions that is tried (0: all). With `cells`, the boxes
    are those of the cuts and fill the plane; else they are the tight bounds of the points.
    With `exact`, cuts are only made at multiples of the capacity, which gives `parts` boxes.
    """

    parts: int
    fill: float = 0.95
    band: float = 0.0
    cells: bool = False
    exact: bool = False
    sides: list[tuple[float, float, float, float]] = field(default_factory=list)

    def split(self, points: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Boxes (n, 4) of points (n, 2), numbered from left to right down the recursion."""
        if self.parts < 1:
            raise ValueError("at least one part is needed")
        if not len(points):
            raise ValueError("the sample is empty")
        if weights is None:
            self.capacity = math.ceil(len(points) / self.parts)
            self.least = float(math.ceil(self.fill * self.capacity))
            load = np.ones(len(points))
        else:
            load = np.asarray(weights, float)
            self.capacity = math.ceil(load.sum() / self.parts)
            self.least = self.fill * load.sum() / self.parts
        self.weighted, self.sides = weights is not None, []
        everything = (-np.inf, -np.inf, np.inf, np.inf)
        todo = [(np.arange(len(points)), everything)]
        while todo:
            rows, cell = todo.pop()
            if load[rows].sum() <= self.capacity or len(rows) < 2:
                tight = (*points[rows].min(axis=0), *points[rows].max(axis=0))
                self.sides.append(cell if self.cells else tight)
                continue
            axis, left, right = self._divide(points, load, rows)
            cut = (points[left, axis].max() + points[right, axis].min()) / 2
            low, high = list(cell), list(cell)
            low[axis + 2] = high[axis] = cut
            todo += [(right, tuple(high)), (left, tuple(low))]
        return np.array(self.sides)

    def _positions(self, before: np.ndarray) -> np.ndarray:
        total, count = before[-1], len(before)
        if self.exact:
            shares = max(1, round(total / self.capacity))
            at = np.searchsorted(before, np.arange(1, shares) * total / shares - 1e-9)
            return np.unique(at[at < count - 1])
        good = np.flatnonzero((before >= self.least) & (total - before >= self.least))
        if not len(good):
            return np.array([count // 2])
        if self.band > 0:
            first, last = int((1 - self.band) / 2 * len(good)), int((1 + self.band) / 2 * len(good))
            good = good[first:last] if last > first else good
        return good

    def _divide(self, points: np.ndarray, load: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        best = None
        for axis in (0, 1):
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            own = points[order]
            at = self._positions(np.cumsum(load[order]))
            at = at[at < len(order) - 1]
            if not len(at):
                continue
            low1, high1 = np.minimum.accumulate(own)[at], np.maximum.accumulate(own)[at]
            low2, high2 = np.minimum.accumulate(own[::-1])[::-1][at + 1], np.maximum.accumulate(own[::-1])[::-1][at + 1]
            pick, score = _least_score(at, low1, high1, low2, high2)
            if best is None or score < best[0]:
                best = (score, axis, order, int(at[pick]) + 1)
        if best is None:
            order = rows[np.argsort(points[rows, 0], kind="stable")]
            return 0, order[: len(order) // 2], order[len(order) // 2 :]
        return best[1], best[2][: best[3]], best[2][best[3] :]


def _least_score(at: np.ndarray, low1: np.ndarray, high1: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[int, tuple]:
    """The best of the positions `at` by the bounds of either side, the first of equal ones, and its score."""
    margins = (high1 - low1).sum(axis=1) + (high2 - low2).sum(axis=1)
    shared = np.clip(np.minimum(high1, high2) - np.maximum(low1, low2), 0, None).prod(axis=1)
    areas = (high1 - low1).prod(axis=1) + (high2 - low2).prod(axis=1)
    pick = np.lexsort((at, areas, shared, margins))[0]
    return pick, (margins[pick], shared[pick], areas[pick])


def expand_to_infinity(sides: np.ndarray) -> np.ndarray:
    """Sides on the border of the whole become infinite (R9); gaps inside stay."""
    out, low, high = sides.copy(), sides[:, :2].min(axis=0), sides[:, 2:].max(axis=0)
    for axis in (0, 1):
        out[np.isclose(sides[:, axis], low[axis]), axis] = -np.inf
        out[np.isclose(sides[:, axis + 2], high[axis]), axis + 2] = np.inf
    return out


def clip_to(sides: np.ndarray, extent: tuple[float, float, float, float]) -> np.ndarray:
    """Infinite sides are replaced by those of the extent."""
    return np.where(np.isinf(sides), np.array(extent), sides)


def partition(features: DataFrame, parts: int, key: str, x: str = "cx", y: str = "cy", rows: int = SAMPLE_ROWS, fraction: float = 1.0, seed: int = 42, **options) -> DataFrame:
    """Tiles from a sample of centroids (M1, M2): at most `rows` points reach the driver."""
    points = features.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(boxes.is_finite(F.col("x")) & boxes.is_finite(F.col("y")))
    if fraction < 1.0:
        points = points.where(uniform(F.col(key), seed) < fraction)
    sample = sample_rows(points, key, rows, seed).select("x", "y").toPandas().to_numpy(float)
    return tile_frame(features.sparkSession, Splitter(parts, **options).split(sample))


def partition_by_histogram(features: DataFrame, parts: int, x: str = "cx", y: str = "cy", side: int = HISTOGRAM_SIDE, **options) -> DataFrame:
    """Tiles from all centroids (R3): the cells of a grid histogram, at their means, weigh what they hold.

    One aggregation with partial results; at most side * side cells reach the driver.
    """
    points = features.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(boxes.is_finite(F.col("x")) & boxes.is_finite(F.col("y")))
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if low[0] is None:
        raise ValueError("there is no point")
    place = lambda c, a, b: F.least(F.floor((F.col(c) - a) / F.lit((b - a) or 1.0) * side), F.lit(side - 1))
    cells = points.groupBy(place("x", low[0], low[2]), place("y", low[1], low[3])).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    found = cells.select("x", "y", "n").orderBy("x", "y").toPandas().to_numpy(float)
    return tile_frame(features.sparkSession, Splitter(parts, **options).split(found[:, :2], found[:, 2]))


@dataclass
class _Part:
    """A part of all points: its half-open cell, tight bounds, rows, and the range of either axis that the next grid resolves."""

    cell: tuple[float, ...]
    tight: tuple[float, ...]
    count: int
    zoom: list[tuple[float, float]]
    halves: tuple[_Part, _Part] | None = None


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns alone, computed once a row: what computes them is not repeated wherever later filters and expressions name them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _part(cell: tuple[float, ...], tight: np.ndarray, count: float) -> _Part:
    tight = tuple(map(float, tight))
    return _Part(cell, tight, int(count), [(tight[0], tight[2]), (tight[1], tight[3])])


def _gridded(points: DataFrame, parts: list[_Part], side: int) -> list[np.ndarray]:
    """For each part the occupied cells of its grid: column, row, points held, and their tight bounds.

    Columns and rows 1 to `side` divide the part's zoom; 0 and `side` + 1 hold what lies before and after.
    """
    spark = points.sparkSession
    cells = tile_frame(spark, np.array([p.cell for p in parts]))
    spans = []
    for i, p in enumerate(parts):
        scales = [0.5 if math.isinf(b - a) else 1.0 for a, b in p.zoom]
        spans.append((tile_name(i), i, *[v for (a, b), s in zip(p.zoom, scales) for v in (a, b, s, (b * s - a * s) or 1.0)]))
    fields = ", ".join(f"_{n}{c} double" for c in "xy" for n in ("low", "high", "scale", "width"))
    zooms = spark.createDataFrame(spans, f"tile_id string, _part int, {fields}")
    zooms = F.broadcast(zooms) if len(parts) <= assign.BROADCAST_CELLS else zooms

    def place(c: str):
        v, low, high, scale, width = (F.col(n) for n in (c, f"_low{c}", f"_high{c}", f"_scale{c}", f"_width{c}"))
        inside = F.least(F.floor((v * scale - low * scale) / width * side), F.lit(side - 1)) + 1
        return F.when(v < low, F.lit(0)).when(v > high, F.lit(side + 1)).otherwise(inside)

    held = assign.assign_disjoint(points, cells, "x", "y").join(zooms, "tile_id")
    bounds = [F.min("x"), F.min("y"), F.max("x"), F.max("y")]
    found = held.groupBy("_part", place("x").alias("_i"), place("y").alias("_j")).agg(F.count("*"), *bounds).toArrow()
    found = np.column_stack([c.to_numpy() for c in found.columns]).astype(float)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return [f[:, 1:] for f in np.split(found, np.searchsorted(found[:, 0], np.arange(1, len(parts))))]


def _lines(cells: np.ndarray, axis: int) -> tuple[np.ndarray, ...]:
    """Columns (or rows) that hold points: numbers, points up to each, and the bounds up to each, from each on and of each."""
    cells = cells[np.argsort(cells[:, axis], kind="stable")]
    bins, first = np.unique(cells[:, axis], return_index=True)
    low, high = np.minimum.reduceat(cells[:, 3:5], first), np.maximum.reduceat(cells[:, 5:7], first)
    back = slice(None, None, -1)
    ahead = np.minimum.accumulate(low), np.maximum.accumulate(high)
    behind = np.minimum.accumulate(low[back])[back], np.maximum.accumulate(high[back])[back]
    return bins, np.cumsum(np.add.reduceat(cells[:, 2], first)), ahead, behind, (low[:, axis], high[:, axis])


def _divide_cells(part: _Part, cells: np.ndarray, capacity: int, fill: float) -> list[_Part]:
    """Splits a part along lines of its grid; parts whose cut needs finer lines are returned, with the zoom to look in.

    Both sides of a cut hold `fill` of the capacity; a part too small for that is halved, with
    the rest of the capacity to spare. Cuts lie between different values: where equal ones
    leave none in that range, the cut next to the middle is taken.
    """
    open_, todo, least = [], [(part, cells)], math.ceil(fill * capacity)
    while todo:
        part, cells = todo.pop()
        if part.count <= capacity or part.tight[:2] == part.tight[2:]:
            continue
        half, spare = part.count // 2, (1 - fill) * capacity
        low, high = least, part.count - least
        if high < low:
            low, high = max(half - spare, part.count - capacity), min(part.count - half + spare, capacity)
        best, near, zoom = None, None, []
        for axis in (0, 1):
            bins, before, ahead, behind, own = _lines(cells, axis)
            at = np.arange(len(bins) - 1)
            hot = np.searchsorted(before, low)
            zoom.append((float(own[0][hot]), float(own[1][hot])))
            good, away = at[(before[at] >= low) & (before[at] <= high)], np.abs(before[at] - part.count / 2)
            for kept, is_good in ((good, True), (at[away == away.min(initial=np.inf)], False)):
                if not len(kept):
                    continue
                pick, score = _least_score(kept, ahead[0][kept], ahead[1][kept], behind[0][kept + 1], behind[1][kept + 1])
                cut = axis, bins[kept[pick]]
                if is_good and (best is None or score < best[0]):
                    best = score, cut
                elif not is_good and (near is None or (away.min(), *score) < near[0]):
                    near = (away.min(), *score), cut
        if best is None and any(a < b for a, b in zoom):
            part.zoom = zoom
            open_.append(part)
            continue
        axis, last = (best or near)[1]
        left, right = cells[cells[:, axis] <= last], cells[cells[:, axis] > last]
        lower, upper = list(part.cell), list(part.cell)
        lower[axis + 2] = upper[axis] = float(right[:, 3 + axis].min())
        part.halves = tuple(_part(tuple(c), [*r[:, 3:5].min(axis=0), *r[:, 5:7].max(axis=0)], r[:, 2].sum()) for c, r in ((lower, left), (upper, right)))
        todo += [(p, r) for p, r in zip(part.halves, (left, right))]
    return open_


def partition_whole(features: DataFrame, parts: int, x: str = "cx", y: str = "cy", side: int = HISTOGRAM_SIDE, fill: float = 0.95, cells: bool = False) -> DataFrame:
    """Tiles of all centroids, none sampled: no tile holds more than its share, rounded up, and tight boxes do not even touch.

    The splitter's rule with cuts at the lines of grids whose cells know their rows and tight
    bounds. A part without a fitting line gets a finer grid where its cut must lie, all
    such parts in one pass over the points. Some side * side cells (16 a part, if that is
    more) reach the driver at once. Only points that coincide can exceed the capacity,
    as no box parts them. With `cells`, boxes fill the plane, half-open.
    """
    if parts < 1:
        raise ValueError("at least one part is needed")
    points = computed(features, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(boxes.is_finite(F.col("x")) & boxes.is_finite(F.col("y")))
    count, *tight = points.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not count:
        raise ValueError("there is no point")
    capacity = math.ceil(count / parts)
    whole = _part((-np.inf, -np.inf, np.inf, np.inf), tight, count)
    open_ = [whole] * (count > capacity and whole.tight[:2] != whole.tight[2:])
    while open_:
        found = _gridded(points, open_, max(2, math.isqrt(side * side // len(open_)) - 2))
        open_ = [p for part, c in zip(open_, found) for p in _divide_cells(part, c, capacity, fill)]
    sides, todo = [], [whole]
    while todo:
        part = todo.pop()
        if part.halves:
            todo += part.halves[::-1]
        else:
            sides.append(part.cell if cells else part.tight)
    return tile_frame(features.sparkSession, np.array(sides))


def uniform_points(extent: tuple[float, float, float, float], count: int = 1000, seed: int = 42) -> np.ndarray:
    """Points spread evenly over an extent, for a data set without a sample (M4)."""
    return np.random.default_rng(seed).uniform(extent[:2], extent[2:], (count, 2))
