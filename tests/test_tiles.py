import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import boxes, curves
from quadrille.operators import assign, ordering
from quadrille.operators.tiles import Splitter, clip_to, expand_to_infinity, partition_by_histogram, partition_whole, tile_frame, tile_name, tile_number


def plain_split(points, parts, fill=0.95):
    """The splitter's rule, position by position."""
    capacity = -(-len(points) // parts)
    least = np.ceil(fill * capacity)
    mbr = lambda p: (p.min(axis=0), p.max(axis=0))

    def go(rows):
        if len(rows) <= capacity or len(rows) < 2:
            lo, hi = mbr(points[rows])
            return [(*lo, *hi)]
        best = None
        for axis in (0, 1):
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            at = [k for k in range(len(order)) if k + 1 >= least and len(order) - k - 1 >= least] or [len(order) // 2]
            for k in at:
                if k + 1 >= len(order):
                    continue
                (a, b), (c, d) = mbr(points[order[: k + 1]]), mbr(points[order[k + 1 :]])
                score = ((b - a).sum() + (d - c).sum(), np.clip(np.minimum(b, d) - np.maximum(a, c), 0, None).prod(), (b - a).prod() + (d - c).prod())
                if best is None or score < best[0]:
                    best = (score, order[: k + 1], order[k + 1 :])
        if best is None:
            order = rows[np.argsort(points[rows, 0], kind="stable")]
            best = (None, order[: len(order) // 2], order[len(order) // 2 :])
        return go(best[1]) + go(best[2])

    return np.array(go(np.arange(len(points))))


@pytest.mark.parametrize("parts", [1, 3, 7, 20])
def test_splitter_follows_the_rule(parts):
    points = np.random.default_rng(parts).normal(size=(300, 2))
    assert np.allclose(Splitter(parts).split(points), plain_split(points, parts))


@pytest.mark.parametrize("points", [np.zeros((1, 2)), np.zeros((50, 2)), np.array([[0, 0], [1, 1.0]]), np.array([[0, 0], [1, 1], [2, 0.0]])])
def test_splitter_on_degenerate_points(points):
    for options in ({}, {"exact": True}, {"cells": True}, {"band": 0.3}):
        assert len(Splitter(3, **options).split(points)) >= 1


def test_splitter_capacity_weights_and_exact():
    rng = np.random.default_rng(0)
    points, weights = rng.normal(size=(2000, 2)), rng.integers(1, 9, 2000)
    assert len(Splitter(16, exact=True).split(points)) == 16
    for sides in (Splitter(16).split(points), Splitter(16).split(points, weights)):
        inside = ((points[:, None] >= sides[None, :, :2]) & (points[:, None] <= sides[None, :, 2:])).all(axis=2)
        assert inside.any(axis=1).all()
    with pytest.raises(ValueError):
        Splitter(4).split(np.zeros((0, 2)))
    cells = Splitter(9, cells=True).split(points)
    new = rng.normal(size=(500, 2)) * 3
    assert (((new[:, None] >= cells[None, :, :2]) & (new[:, None] < cells[None, :, 2:])).all(axis=2).sum(axis=1) == 1).all()
    grown = expand_to_infinity(Splitter(9).split(points))
    assert np.isinf(grown).any() and not np.isinf(clip_to(grown, (-9, -9, 9, 9))).any()


def test_names():
    assert tile_name(7) == "tile_000007" and tile_number("tile_000007") == 7 and tile_number("x") is None


def frame(spark, rows):
    f = spark.createDataFrame(rows, "k long, xmin double, ymin double, xmax double, ymax double")
    b = boxes.box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return f.select("k", b.alias("bbox"), ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))


def test_assignment_modes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    low = rng.uniform(0, 10, (300, 2)).round(1)
    rows = [(i, *map(float, p), *map(float, p + rng.choice([0, 0.5, 3], 2))) for i, p in enumerate(low)]
    rows += [(900, None, 1.0, 2.0, 3.0), (901, -50.0, -50.0, -49.0, -49.0), (902, -100.0, -100.0, 100.0, 100.0)]
    sides = np.hstack([a := rng.uniform(0, 9, (40, 2)).round(1), a + rng.choice([1, 2, 5], (40, 2))])
    sides = np.vstack([sides, sides[:3], [[4, 4, 4, 4]], [[0, 0, 10, 10]]])
    f, tiles = frame(spark, rows), tile_frame(spark, sides)
    feats = [r for r in rows if r[1] is not None]
    size = lambda t: (t[2] - t[0]) * (t[3] - t[1])
    touch = lambda b, t: b[0] <= t[2] and b[2] >= t[0] and b[1] <= t[3] and b[3] >= t[1]
    over = lambda b, t: not (b[2] <= t[0] or t[2] <= b[0] or b[3] <= t[1] or t[3] <= b[1])
    hold = lambda b, t: b[0] >= t[0] - 1e-9 and b[2] <= t[2] + 1e-9 and b[1] >= t[1] - 1e-9 and b[3] <= t[3] + 1e-9
    half = lambda b, t: t[0] <= (b[0] + b[2]) / 2 < t[2] and t[1] <= (b[1] + b[3]) / 2 < t[3]
    best = lambda test, key: {r[0]: tile_name(min(hits)[-1]) for r in feats if (hits := [(*key(t), i) for i, t in enumerate(sides) if test(r[1:], t)])}
    got = lambda df: {r.k: r.tile_id for r in df.where(F.col("tile_id").isNotNull()).collect()}
    for index in (tiles, assign.TileIndex(tiles, side=1), assign.TileIndex(tiles, side=13)):
        assert got(assign.assign_contains(f, index)) == best(hold, lambda t: (size(t),))
        assert got(assign.assign_disjoint(f, index)) == best(half, lambda t: ())
        assert got(assign.assign_smallest_intersecting(f, index, "k")) == best(touch, lambda t: (size(t),))
        pairs = sorted((r.k, r.tile_id) for r in assign.assign_covering(f, index).collect())
        assert pairs == sorted((r[0], tile_name(i)) for r in feats for i, t in enumerate(sides) if over(r[1:], t))
    whole = assign.assign_min_expansion(f, tiles, "k", (0, 0, 15, 15))
    assert whole.count() == len(rows) and whole.where(F.col("tile_id").isNull()).count() == 0
    done = assign.assign_contains(f, tiles)
    assert assign.skipped(f, done, "k").count() + done.where(F.col("tile_id").isNotNull()).count() == len(rows)


def test_curves(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    rows = sorted((r.h, r.x, r.y) for r in cells.withColumn("h", curves.hilbert(F.col("x"), F.col("y"), 4)).collect())
    assert [r[0] for r in rows] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))
    z = {(r.x, r.y): r.z for r in curves.with_morton(cells, F.col("x"), F.col("y"), "z").collect()}
    assert sorted(z.values()) == list(range(n * n)) and z[(1, 0)] == 1 and z[(0, 1)] == 2
    with pytest.raises(ValueError):
        curves.to_world_grid(F.col("x"), 0, 1, 32)


def plain_hilbert(x, y, bits):
    """Quadrant by quadrant from the highest bit."""
    d, swap, flip = 0, False, 0
    for i in range(bits - 1, -1, -1):
        u, v = (x >> i & 1) ^ flip, (y >> i & 1) ^ flip
        u, v = (v, u) if swap else (u, v)
        d = d * 4 + (3 * u ^ v)
        if not v:
            swap, flip = not swap, flip ^ u
    return d


@pytest.mark.parametrize("bits", [1, 3, 5, 16, 24, 31])
def test_hilbert_of_any_order(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(2**bits), rng.randrange(2**bits)) for _ in range(200)] + [(0, 0), (2**bits - 1, 0), (0, 2**bits - 1), (None, 1), (1, None)]
    got = spark.createDataFrame(rows, "x long, y long").withColumn("h", curves.hilbert(F.col("x"), F.col("y"), bits)).collect()
    assert [r.h for r in got] == [None if x is None or y is None else plain_hilbert(x, y, bits) for x, y in rows]


def test_index_size_is_counted(spark):
    sides = np.array([(0.0, 0.0, 10.0, 10.0)] * 9 + [(-np.inf, -np.inf, np.inf, np.inf)])
    index = assign.TileIndex(tile_frame(spark, sides))
    assert index.listed == index.cells_table.count() and index.listed > 4 * 10 + index.side**2


def test_spare_tiles_follow_the_key(spark):
    tiles = tile_frame(spark, np.array([(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0)]))
    f = spark.range(40).select(F.col("id").alias("k"), boxes.literal_box(5.0, 5.0, 6.0, 6.0).alias("bbox"))
    first, again = (sorted((r.k, r.tile_id) for r in assign.assign_min_expansion(f.repartition(n), tiles, "k", (0, 0, 9, 9)).collect()) for n in (1, 3))
    assert first == again and len(first) == 40 and len({t for _, t in first}) == 2
    text = f.withColumn("k", F.col("k").cast("string"))
    assert assign.assign_min_expansion(text, tiles, "k", (0, 0, 9, 9)).where("tile_id is not null").count() == 40


def test_histogram_partition_covers_every_point(spark):
    f = spark.range(3000).select((F.sin("id") * 10).alias("cx"), (F.cos(F.col("id") * 3) * 5).alias("cy"), "id")
    tiles = partition_by_histogram(f, 12, side=64, cells=True)
    assert assign.assign_disjoint(f, tiles).where(F.col("tile_id").isNull()).count() == 0


def odd_points(kind):
    rng = np.random.default_rng(5)
    even = rng.uniform(0, 10, (600, 2))
    return {
        "even": even,
        "clusters": np.vstack([rng.normal(0, 1e-6, (400, 2)), rng.normal(1e6, 1, (200, 2)), [[1e12, -1e12], [-1e300, 3.0]]]),
        "ties": rng.integers(0, 6, (900, 2)).astype(float),
        "line": np.column_stack([np.zeros(300), rng.normal(size=300)]),
        "same": np.full((50, 2), 7.0),
        "mostly same": np.vstack([np.full((200, 2), 7.0), even[:100]]),
        "one": np.array([[1.0, 2.0]]),
    }[kind]


@pytest.mark.parametrize("kind,side", [("even", 512), ("even", 8), ("clusters", 32), ("ties", 8), ("line", 16), ("same", 512), ("mostly same", 512), ("one", 512)])
def test_whole_partition_keeps_its_promises_for_all_points(spark, kind, side):
    points, parts = odd_points(kind), 7
    f = spark.createDataFrame([*[tuple(map(float, p)) for p in points], (None, 1.0), (1.0, float("nan")), (float("inf"), 1.0)], "cx double, cy double")
    sides, cells = (np.array([tuple(r.box) for r in partition_whole(d, parts, side=side, cells=c).orderBy("ordinal").collect()]) for d, c in ((f, False), (f.repartition(3), True)))
    inside = ((points[:, None] >= sides[None, :, :2]) & (points[:, None] <= sides[None, :, 2:])).all(axis=2)
    assert (inside.sum(axis=1) == 1).all()
    assert (inside == ((points[:, None] >= cells[None, :, :2]) & (points[:, None] < cells[None, :, 2:])).all(axis=2)).all()
    capacity = -(-len(points) // parts)
    for tile, held in zip(sides, inside.T):
        assert (tile == [*points[held].min(axis=0), *points[held].max(axis=0)]).all()
        assert held.sum() <= capacity or (tile[:2] == tile[2:]).all()
        assert held.sum() >= 0.45 * capacity - 1 or kind not in ("even", "clusters", "line")
    assert len(sides) <= 2 * parts


def test_whole_partition_refuses_nothing(spark):
    f = spark.createDataFrame([(None, 1.0)], "cx double, cy double")
    with pytest.raises(ValueError):
        partition_whole(f, 3)
    with pytest.raises(ValueError):
        partition_whole(f, 0)


def test_sort_specs():
    assert ordering.sort_keys(" a:desc, b ,c:down,") == [("a", False), ("b", True), ("c", True)]
    assert ordering.sort_mode("Z-Order") == "zorder" and ordering.sort_mode(None) == "none"
    with pytest.raises(ValueError):
        ordering.sort_mode("peano")


def test_human_size(spark):
    values = [0, 1023, 1024, 1536, 5 * 1024**2, 7 * 1024**4, None]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert [r[0] for r in df.select(boxes.human_size(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "5.00 MB", "7.00 TB", None]


def test_small_helpers(spark):
    from quadrille.operators.tiles import uniform_points

    points = uniform_points((0, 10, 1, 12), 500)
    assert points.shape == (500, 2) and (points >= (0, 10)).all() and (points <= (1, 12)).all() and (points == uniform_points((0, 10, 1, 12), 500)).all()
    assert ordering.unique_names(["b", "a", "b", "c", "a"]) == ["b", "a", "c"]
    apart = assign.describe(tile_frame(spark, np.array([(0, 0, 1, 1), (1, 0, 2, 1.0)]))).first()
    assert apart.asDict() == {"tiles": 2, "xmin": 0, "ymin": 0, "xmax": 2, "ymax": 1, "is_disjoint": True}
    assert not assign.describe(tile_frame(spark, np.array([(0, 0, 1, 1), (0.5, 0, 2, 1.0)]))).first().is_disjoint
