"""Space-filling curve keys as native columns."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys use 2 * bits of a signed 64-bit integer.
MOST_BITS = 31
WORLD = (-180.0, -90.0, 180.0, 90.0)


def _check(bits: int) -> None:
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must lie between 1 and {MOST_BITS}")


def to_extent_grid(value: Column, low: Column, high: Column, bits: int) -> Column:
    """Cell of a value between two bounds, truncated; 0 where the bounds are equal or not finite."""
    _check(bits)
    span = high - low
    good = (span > 0) & (span < float("inf")) & ~F.isnan(span)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.when(good, span)))
    return F.when(value.isNotNull(), F.coalesce((share * float(2**bits - 1)).cast("long"), F.lit(0).cast("long")))


def to_world_grid(value: Column, low: float, high: float, bits: int) -> Column:
    """Cell of a value on a fixed range, rounded half to even and clipped."""
    _check(bits)
    top = float(2**bits - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(top), F.rint((value - F.lit(low)) / F.lit(high - low) * F.lit(top)))).cast("long")


def _spread(x: Column) -> Column:
    """Moves bit i of a number below 2^31 to bit 2i."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits of two cells, y in the higher place (Z3)."""
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def with_morton(df: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """Adds a Morton key in stages, so that the expression does not grow with itself."""
    staged = df.withColumns({"_sx": x, "_sy": y})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        staged = staged.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_sx", "_sy")})
    return staged.withColumn(name, F.shiftleft("_sy", 1).bitwiseOR(F.col("_sx"))).drop("_sx", "_sy")


def _turns(levels: int = 4) -> list[int]:
    """For each way a quadrant is turned (4) and `levels` bits of x and of y: digits of the position times 4, plus the way the cell is turned.

    A quadrant may have its axes exchanged (1) and both running backwards (2).
    """
    out = []
    for state, x, y in itertools.product(range(4), range(1 << levels), range(1 << levels)):
        position, swap, flip = 0, state & 1, state >> 1
        for i in range(levels - 1, -1, -1):
            u, v = (x >> i & 1) ^ flip, (y >> i & 1) ^ flip
            if swap:
                u, v = v, u
            position = position * 4 + (3 * u ^ v)
            if not v:
                swap, flip = 1 - swap, flip ^ u
        out.append(position * 4 + swap + 2 * flip)
    return out


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Position on the Hilbert curve of order `bits` (Z4), four bits of either axis at a time by a fixed table.

    x and y should be plain columns, as they come up in every step; null if one is null.
    """
    _check(bits)
    steps = -(-bits // 4)
    # one constant, which the optimizer folds, not an expression for each entry
    table = F.split(F.lit(",".join(map(str, _turns()))), ",").cast("array<int>")
    turned, digits = F.lit(4 * steps - bits & 1), []  # each leading pair of zeros exchanges the axes
    for k in range(steps - 1, -1, -1):
        four = lambda v: F.shiftright(v, 4 * k).bitwiseAND(F.lit(15)).cast("int")  # noqa: B023, E731
        found = F.get(table, turned * 256 + four(x) * 16 + four(y))
        turned = found.bitwiseAND(F.lit(3))
        digits.append(F.shiftleft(F.shiftright(found, 2).cast("long"), 8 * k))
    return functools.reduce(Column.bitwiseOR, digits)


def curve_key(df: DataFrame, x: Column, y: Column, curve: str, bits: int, extent: tuple[Column, ...] | None = None, name: str | None = None) -> DataFrame:
    """Adds `zkey<bits>` or `hkey<bits>` of a point; with an extent as (xmin, ymin, xmax, ymax) columns, else the world.

    A missing point has a null key, which ascending order with nulls last puts at the end (Z5, Z7).
    """
    if extent is None:
        cx, cy = to_world_grid(x, WORLD[0], WORLD[2], bits), to_world_grid(y, WORLD[1], WORLD[3], bits)
    else:
        cx, cy = to_extent_grid(x, extent[0], extent[2], bits), to_extent_grid(y, extent[1], extent[3], bits)
    if curve in ("z", "zorder", "morton"):
        return with_morton(df, cx, cy, name or f"zkey{bits}")
    if curve in ("h", "hilbert"):
        staged = df.withColumns({"_cx": cx, "_cy": cy})
        return staged.withColumn(name or f"hkey{bits}", hilbert(F.col("_cx"), F.col("_cy"), bits)).drop("_cx", "_cy")
    raise ValueError(f"unknown curve: {curve}")
