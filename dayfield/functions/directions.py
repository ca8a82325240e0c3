"""Directions on the sphere, equal-area square coordinates, grid codes and rotations, as column expressions.

Conventions: azimuth 0 is south (-y) and grows to the west (-x); theta is measured from +z, phi from +x. The square of one
hemisphere is the concentric equal-area map of Shirley and Chiu (1997); the lower hemisphere lies at u in 1..2."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import uniform

PI = math.pi


class Xyz(NamedTuple):
    x: Column
    y: Column
    z: Column


def xyz(prefix: str = "d") -> Xyz:
    return Xyz(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))


def dot(a: Xyz, b: Xyz) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def norm(v: Xyz) -> Xyz:
    """Unit vector; the zero vector gives nulls."""
    size = F.sqrt(dot(v, v))
    return Xyz(F.try_divide(v.x, size), F.try_divide(v.y, size), F.try_divide(v.z, size))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def atan2(y: Column, x: Column) -> Column:
    """IEEE's atan2, which heeds the sign of zeros; Spark's takes -0 for 0."""
    minus = lambda c: c.cast("string").startswith("-")
    level = F.when(minus(x), F.lit(PI)).otherwise(0.0)
    return F.when((y == 0) & x.isNotNull() & ~F.isnan(x), F.when(minus(y), -level).otherwise(level)).otherwise(F.atan2(y, x))


def to_alt_az(v: Xyz) -> tuple[Column, Column]:
    """Degrees above the horizon and azimuth in -180..180."""
    return F.degrees(F.asin(clip(v.z, -1.0, 1.0))), F.degrees(atan2(-v.x, -v.y))


def from_alt_az(alt: Column, az: Column) -> Xyz:
    a, b = F.radians(alt), F.radians(az)
    return Xyz(-F.sin(b) * F.cos(a), -F.cos(b) * F.cos(a), F.sin(a))


def to_theta_phi(v: Xyz) -> tuple[Column, Column]:
    return F.acos(clip(v.z, -1.0, 1.0)), atan2(v.y, v.x)


def from_theta_phi(theta: Column, phi: Column) -> Xyz:
    return Xyz(F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta))


def to_angular(v: Xyz) -> tuple[Column, Column]:
    """Angular fisheye: the distance from the centre is theta in right angles."""
    theta, phi = to_theta_phi(v)
    return theta / (PI / 2) * F.cos(phi), theta / (PI / 2) * F.sin(phi)


def to_uv(v: Xyz) -> tuple[Column, Column]:
    """Square coordinates of a unit vector: u in 0..1 above, 1..2 below the horizon, v in 0..1."""
    r = F.sqrt(F.greatest(1 - F.abs(v.z), F.lit(0.0)))
    raw = atan2(v.y, v.x)
    phi = F.when(raw < -PI / 4, raw + 2 * PI).otherwise(raw)
    q = PI / 4
    a = F.when(phi < q, r).when(phi < 3 * q, -(phi - PI / 2) * r / q).when(phi < 5 * q, -r).otherwise((phi - 1.5 * PI) * r / q)
    b = F.when(phi < q, phi * r / q).when(phi < 3 * q, r).when(phi < 5 * q, -(phi - PI) * r / q).otherwise(-r)
    return (a + 1) / 2 + F.when(v.z < 0, 1.0).otherwise(0.0), (b + 1) / 2


def from_uv(u: Column, v: Column) -> Xyz:
    below = u > 1
    a, b = 2 * (u - F.when(below, 1.0).otherwise(0.0)) - 1, 2 * v - 1
    q = PI / 4
    r = F.when(a > -b, F.when(a > b, a).otherwise(b)).otherwise(F.when(a < b, -a).otherwise(-b))
    ba, ab = F.coalesce(F.try_divide(b, a), F.lit(0.0)), F.coalesce(F.try_divide(a, b), F.lit(0.0))
    phi = F.when(a > -b, F.when(a > b, q * ba).otherwise(q * (2 - ab))).otherwise(F.when(a < b, q * (4 + ba)).otherwise(F.when(b != 0, q * (6 - ab)).otherwise(0.0)))
    side = r * F.sqrt(F.greatest(2 - r * r, F.lit(0.0)))
    return Xyz(side * F.cos(phi), side * F.sin(phi), (1 - r * r) * F.when(below, -1.0).otherwise(1.0))


def cell(value: Column, n: int | Column) -> Column:
    """Index of ``value`` in 0..1 on a line of n cells; the upper edge belongs to the last cell."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.least(F.floor(value * n), n - 1), F.lit(0)).cast("int")


def grid_bin(u: Column, v: Column, n: int) -> Column:
    return cell(u, n) * n + cell(v, n)


def bin_uv(code: Column, n: int, offset: float = 0.5) -> tuple[Column, Column]:
    return (F.floor(code / n) + offset) / n, (code % n + offset) / n


def jittered_uv(code: Column, n: int, seed: int, *keys: str) -> tuple[Column, Column]:
    """A place inside the cell of a flat index, drawn from the seed and the keys."""
    return (F.floor(code / n) + uniform(seed, *keys)) / n, (code % n + uniform(seed + 1, *keys)) / n


#: What ``transform`` can do: name -> (columns of the input, columns of the result, function of the input columns).
def _ops() -> dict:
    def of_xyz(f):
        return lambda *c: f(norm(Xyz(*c)))

    return {"xy": (3, 2, of_xyz(to_angular)), "aa": (3, 2, of_xyz(to_alt_az)), "tp": (3, 2, of_xyz(to_theta_phi)), "uv": (3, 2, of_xyz(to_uv)), "uv2xyz": (2, 3, lambda u, v: from_uv(u, v))}


def transform(rows: DataFrame, columns: list[str], op: str, names: list[str]) -> DataFrame:
    """``rows`` with the chosen columns transformed into ``names``: xyz to angular (xy), altitude and azimuth (aa), theta and phi (tp) or
    square coordinates (uv), or back from these (uv2xyz). Vectors are scaled to length 1 first; a wrong number of columns is an error."""
    if op not in _ops():
        raise ValueError(f"unknown transform {op!r}")
    takes, gives, f = _ops()[op]
    if len(columns) != takes or len(names) != gives:
        raise ValueError(f"{op} takes {takes} columns and gives {gives}, not {len(columns)} and {len(names)}")
    return rows.withColumns(dict(zip(names, f(*map(F.col, columns)), strict=True)))


def sky_patch(v: Xyz, side: int) -> Column:
    """Patch of a direction: square cell of the upper hemisphere, side * side for the ground."""
    u, w = to_uv(v)
    return F.when(v.z < 0, F.lit(side * side)).otherwise(grid_bin(u, w, side))


def patch_centre(patch: Column, side: int) -> Xyz:
    u, v = bin_uv(patch, side)
    up = from_uv(u, v)
    ground = patch >= side * side
    return Xyz(F.when(ground, 0.0).otherwise(up.x), F.when(ground, 0.0).otherwise(up.y), F.when(ground, -1.0).otherwise(up.z))


def chord(angle: Column) -> Column:
    """Chord of an angle in radians on the unit sphere."""
    return 2 * F.sin(angle / 2)


def angle_of_chord(c: Column) -> Column:
    return 2 * F.asin(clip(c / 2, -1.0, 1.0))


def view_chord(angle_deg: float) -> float:
    """Chord of half an opening angle."""
    return 2 * math.sin(math.radians(angle_deg) / 4)


def rotate_z(x: Column, y: Column, degrees: float | Column) -> tuple[Column, Column]:
    a = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def reflect(v: Xyz, normal: Xyz) -> Xyz:
    k = 2 * dot(v, normal)
    return Xyz(v.x - k * normal.x, v.y - k * normal.y, v.z - k * normal.z)


def radiance(r: Column, g: Column, b: Column) -> Column:
    """Channel weights of the Radiance renderer."""
    return 0.265 * r + 0.670 * g + 0.065 * b
