"""Measures of whole batches of WKB.

Points and polygons of one ring with five positions have fixed layouts in little-endian,
two-dimensional WKB, so whole batches of them are arrays; all other geometries go through the
kernel one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np

from quadrille.geometry import wkb

# Byte order, type, and for rings the numbers of rings and positions.
POINT_HEAD = bytes([1, 1, 0, 0, 0])
RING_HEAD = bytes([1, 3, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0, 0])


class Batch:
    """WKB values, with the places and positions of finite points (n, 2) and five-position rings (n, 5, 2)."""

    def __init__(self, values: Sequence[bytes | None], strict: bool = False):
        """Unreadable values are left out, or raise with `strict`."""
        self.values = values
        sizes = np.fromiter((-1 if v is None else len(v) for v in values), np.int64, len(values))
        self.point_at, xy = self._fixed(sizes, POINT_HEAD, 1)
        self.xy = xy[:, 0]
        self.ring_at, self.rings = self._fixed(sizes, RING_HEAD, 5)
        other = sizes >= 0
        other[self.point_at] = other[self.ring_at] = False
        self.rest = [(int(i), g) for i in np.flatnonzero(other) if (g := wkb.from_wkb(values[i]) if strict else parsed(values[i])) is not None]
        self.low, self.high = self.rings.min(axis=1), self.rings.max(axis=1)

    def _fixed(self, sizes: np.ndarray, head: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
        whole = len(head) + 16 * count
        at = np.flatnonzero(sizes == whole)
        raw = np.frombuffer(b"".join(self.values[i] for i in at), np.uint8).reshape(len(at), whole)
        xy = np.ascontiguousarray(raw[:, len(head) :]).view("<f8").reshape(len(at), count, 2)
        good = (raw[:, : len(head)] == np.frombuffer(head, np.uint8)).all(axis=1) & np.isfinite(xy).all(axis=(1, 2))
        return at[good], xy[good]

    def bounds(self) -> np.ndarray:
        """(n, 4), not a number where there are none."""
        out = np.full((len(self.values), 4), np.nan)
        out[self.point_at] = np.tile(self.xy, 2)
        out[self.ring_at] = np.concatenate([self.low, self.high], axis=1)
        return self._others(out, wkb.bounds)

    def _ring_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Twice the signed areas, and the moments, as the kernel computes them."""
        first = self.rings[:, :1]
        p = self.rings - first
        q = np.roll(p, -1, axis=1)
        cross = p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]
        total = cross.sum(axis=1)
        return total, ((p + q) * cross[..., None]).sum(axis=1) / 3 + first[:, 0] * total[:, None]

    def centroids(self) -> np.ndarray:
        out = np.full((len(self.values), 2), np.nan)
        out[self.point_at] = self.xy
        total, moment = self._ring_sums()
        solid = total != 0
        out[self.ring_at[solid]] = moment[solid] / total[solid, None]
        for i in self.ring_at[~solid]:
            out[i] = wkb.centroid(wkb.from_wkb(self.values[i]))
        return self._others(out, wkb.centroid)

    def _others(self, out: np.ndarray, measure: Callable[[wkb.Geometry], Any]) -> np.ndarray:
        for i, g in self.rest:
            if (found := measure(g)) is not None:
                out[i] = found
        return out

    def well_oriented(self) -> np.ndarray:
        out = np.ones(len(self.values), bool)
        out[self.ring_at] = self._ring_sums()[0] >= 0
        return self._others(out, wkb.well_oriented)

    def is_empty(self) -> np.ndarray:
        out = np.ones(len(self.values), bool)
        out[self.point_at] = out[self.ring_at] = False
        return self._others(out, wkb.is_empty)

    def type_names(self) -> np.ndarray:
        out = np.full(len(self.values), None, object)
        out[self.point_at], out[self.ring_at] = "Point", "Polygon"
        return self._others(out, lambda g: g.type_name)

    def within(self, region: wkb.Geometry) -> np.ndarray:
        """Points strictly within a region of polygons."""
        out = np.zeros(len(self.values), bool)
        if len(self.xy):
            out[self.point_at] = wkb.points_within(self.xy, region)
        others = [(i, g.data) for i, g in self.rest if g.kind == "Point" and len(g.data)]
        if others:
            out[[i for i, _ in others]] = wkb.points_within(np.array([p for _, p in others]), region)
        return out

    def intersects(self, region: wkb.Geometry) -> np.ndarray:
        """Geometries that share a position with a region; rings by their boxes alone where both are rectangles."""
        out = np.zeros(len(self.values), bool)
        box = wkb.bounds(region)
        if box is None:
            return out
        if len(self.xy):
            out[self.point_at] = wkb.points_on(self.xy, region)
        near = (self.low[:, 0] <= box[2]) & (self.high[:, 0] >= box[0]) & (self.low[:, 1] <= box[3]) & (self.high[:, 1] >= box[1])
        one_ring = region.kind == "Polygon" and len(region.data) == 1 and len(region.data[0]) == 5
        sure = near & rectangles(self.rings) & (one_ring and rectangles(np.asarray(region.data))[0])
        out[self.ring_at[sure]] = True
        for i in self.ring_at[near & ~sure]:
            out[i] = wkb.intersects(wkb.from_wkb(self.values[i]), region)
        return self._others(out, lambda g: wkb.intersects(g, region))


def parsed(raw: bytes | None) -> wkb.Geometry | None:
    if raw is None:
        return None
    try:
        return wkb.from_wkb(raw)
    except wkb.GeometryError:
        return None


def rectangles(rings: np.ndarray) -> np.ndarray:
    """Which closed rings (n, 5, 2) run around an axis-parallel rectangle with an area."""
    steps = np.diff(rings, axis=1) != 0
    one_way = steps[..., 0] ^ steps[..., 1]
    turns = steps[:, :-1, 0] != steps[:, 1:, 0]
    return one_way.all(axis=1) & turns.all(axis=1) & (rings[:, 0] == rings[:, -1]).all(axis=1)


def _cut(rows: np.ndarray, good: np.ndarray) -> list[bytes | None]:
    raw, size = rows.tobytes(), rows.shape[1]
    return [raw[i * size : (i + 1) * size] if g else None for i, g in enumerate(good.tolist())]


def _built(head: bytes, xy: np.ndarray) -> list[bytes | None]:
    rows = np.empty((len(xy), len(head) + 8 * xy.shape[1]), np.uint8)
    rows[:, : len(head)] = np.frombuffer(head, np.uint8)
    rows[:, len(head) :] = np.ascontiguousarray(xy, "<f8").view(np.uint8).reshape(len(xy), 8 * xy.shape[1])
    return _cut(rows, ~np.isnan(xy).any(axis=1))


def point_values(x: np.ndarray, y: np.ndarray) -> list[bytes | None]:
    """WKB of points; null where a coordinate is missing."""
    return _built(POINT_HEAD, np.stack([x, y], axis=1))


def rectangle_values(xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> list[bytes | None]:
    """WKB of boxes; null where a side is missing."""
    return _built(RING_HEAD, np.stack([xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax, xmin, ymin], axis=1))
