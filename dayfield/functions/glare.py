"""Glare terms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .directions import Xyz, clip, dot

SCALE = 179.0


def position_index(v: Xyz, view: Xyz) -> Column:
    """Guth's position index of a ray for a horizontal view, as Kim and others fit it; below the line of sight after Iwata.

    tau is the angle from the vertical plane of the view, sigma the angle between ray and view (degrees)."""
    # right = view x up, top = right x view, for an up vector of +z (or +y for a vertical view)
    steep = F.abs(view.z) > 0.999
    ux, uy, uz = F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0)
    rx, ry, rz = view.y * uz - view.z * uy, view.z * ux - view.x * uz, view.x * uy - view.y * ux
    size = F.sqrt(rx * rx + ry * ry + rz * rz)
    rx, ry, rz = F.try_divide(rx, size), F.try_divide(ry, size), F.try_divide(rz, size)
    tx, ty, tz = ry * view.z - rz * view.y, rz * view.x - rx * view.z, rx * view.y - ry * view.x
    right, top, ahead = v.x * rx + v.y * ry + v.z * rz, v.x * tx + v.y * ty + v.z * tz, dot(v, view)
    sigma = F.degrees(F.acos(clip(ahead, -1.0, 1.0)))
    tau = F.degrees(F.atan2(F.abs(right), F.abs(top)))
    above = F.exp((35.2 - 0.31889 * tau - 1.22 * F.exp(-2 * tau / 9)) / 1000 * sigma + (21 + 0.26667 * tau - 0.002963 * tau * tau) / 100000 * sigma * sigma)
    r = F.sqrt(F.try_divide(right * right + top * top, F.greatest(ahead, F.lit(1e-6)) * F.greatest(ahead, F.lit(1e-6))))
    below = F.when(r > 0.6, 1 + 1.2 * r).otherwise(1 + 0.8 * r)
    return F.least(F.when(top < 0, below).otherwise(above), F.lit(16.0))


def dgp(ev: Column, pwsl2: Column, low_below: float = 500.0) -> tuple[Column, Column, Column, Column]:
    """(dgp_t1, log_gc, dgp_t2, dgp): daylight glare probability, with a low-light factor under ``low_below`` lux."""
    t1 = 5.87e-5 * ev
    log_gc = F.coalesce(F.log10(1 + F.try_divide(pwsl2, F.pow(ev, F.lit(1.87)))), F.lit(0.0))
    t2 = 9.18e-2 * log_gc
    soft = F.exp(0.024 * ev - 4) / (1 + F.exp(0.024 * ev - 4))
    low = F.when(ev < low_below, soft).otherwise(1.0)
    return t1, log_gc, t2, F.least(low * (t1 + t2 + 0.16), F.lit(1.0))


def ugr(pwsl2: Column, backlum: Column) -> Column:
    inner = F.try_divide(0.25 * pwsl2, backlum)
    return F.greatest(F.coalesce(8 * F.log10(F.when(inner > 0, inner)), F.lit(0.0)), F.lit(0.0))


def ugp(pwsl2: Column, backlum: Column) -> Column:
    return F.pow(1 + 2.0 / 7 * F.pow(F.lit(10.0), -(ugr(pwsl2, backlum) + 5) / 40), F.lit(-10))


def spread_source(omega: Column, lum: Column, fwhm_deg: float = 0.183333) -> tuple[Column, Column]:
    """A small bright source enlarged by a Lorentzian point spread, and the luminance that keeps its energy.

    The half width grows with the luminance ratio to a visible 1 cd/m2, clipped to 1.5 degrees."""
    gamma = fwhm_deg / 2
    half = F.degrees(F.sqrt(omega / math.pi))
    wide = half + clip(gamma * F.sqrt(F.greatest(F.log10(F.greatest(lum, F.lit(1.0))), F.lit(0.0))), 0.0, 1.5)
    new = math.pi * F.pow(F.radians(wide), F.lit(2))
    return new, F.try_divide(lum * omega, new)


def source_radius(omega: Column) -> Column:
    return F.sqrt(omega / math.pi)
