"""Forest-plot and climate formulas as Column expressions.

Fixed values: plot area 0.07 ha in four quadrants, 28 m default transect
length, 2 m transect width, 50 m belt length, the vapour-pressure constants over
ice and water, and the 45 degree aspect axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .missing import _c

PLOT_AREA_HA = 0.07
QUADRANTS = 4
TRANSECT_LENGTH_M = 28
TRANSECT_WIDTH_M = 2
BELT_LENGTH_M = 50
M2_PER_HA = 10000
ICE = (21.875, 265.5)
WATER = (17.269, 237.3)
ES_BASE_KPA = 0.61078
ASPECT_AXIS_DEG = 45.0


def surveyed_area(n_quads, plot_area: float = PLOT_AREA_HA) -> Column:
    """Hectares actually surveyed when ``n_quads`` of four quadrants were done."""
    return F.lit(plot_area) * _c(n_quads) / F.lit(float(QUADRANTS))


def stem_basal_m2(dbh_mm) -> Column:
    """Cross-section of one stem in m2 from its diameter in mm."""
    return F.lit(math.pi) * F.pow(_c(dbh_mm) / F.lit(2000.0), F.lit(2.0))


def basal_area(dbh_mm, n_quads, plot_area: float = PLOT_AREA_HA) -> Column:
    """Basal area of one stem in m2 per ha."""
    return F.try_divide(stem_basal_m2(dbh_mm), surveyed_area(n_quads, plot_area))


def basal_area_cm(dbh_cm) -> Column:
    """Stem cross-section in m2 from a diameter in cm (forester's constant)."""
    return F.lit(math.pi) * F.pow(_c(dbh_cm), F.lit(2.0)) / F.lit(40000.0)


def stem_density(count, n_quads, plot_area: float = PLOT_AREA_HA) -> Column:
    return F.try_divide(_c(count).cast("double"), surveyed_area(n_quads, plot_area))


def transect_area(*lengths, width: float = TRANSECT_WIDTH_M,
                  missing_length: float = TRANSECT_LENGTH_M) -> Column:
    """Area in m2 of belt transects; unrecorded lengths take the default."""
    total = None
    for ln in lengths:
        one = F.coalesce(_c(ln).cast("double"), F.lit(float(missing_length)))
        total = one if total is None else total + one
    return total * F.lit(float(width))


def per_hectare(count, area_m2) -> Column:
    return F.try_divide(_c(count).cast("double"), _c(area_m2)) * F.lit(float(M2_PER_HA))


def belt_density(count, width, length: float = BELT_LENGTH_M) -> Column:
    """Whole stems per ha on a belt of the given width."""
    area = F.lit(float(length)) * _c(width)
    return F.bround(F.try_divide(_c(count).cast("double"), area) * F.lit(float(M2_PER_HA)), 0)


def importance(count, site_count, basal, site_basal) -> Column:
    """Relative density plus relative dominance."""
    return F.try_divide(_c(count).cast("double"), _c(site_count)) + F.try_divide(
        _c(basal), _c(site_basal))


def saturation_pressure(temp_c) -> Column:
    """Saturation vapour pressure in kPa; over ice below freezing."""
    t = _c(temp_c)
    curve = lambda k: F.lit(ES_BASE_KPA) * F.exp(F.lit(k[0]) * t / (t + F.lit(k[1])))
    return F.when(t < 0, curve(ICE)).otherwise(curve(WATER))


def vapour_deficit(tmin, tmax, vp_pa) -> Column:
    """Daily vapour-pressure deficit in kPa from temperatures and vapour pressure in Pa."""
    mean_es = (saturation_pressure(tmin) + saturation_pressure(tmax)) / F.lit(2.0)
    return mean_es - _c(vp_pa) / F.lit(1000.0)


def northeastness(aspect_deg) -> Column:
    """Aspect as a 0-2 index, largest facing north-east."""
    return F.cos(F.radians(F.lit(ASPECT_AXIS_DEG)) - F.radians(_c(aspect_deg))) + F.lit(1.0)


def elevation_class(elev_m, step: float = 100.0) -> Column:
    return F.bround(_c(elev_m) / F.lit(step), 0)


def normal_interval(estimate, se, z: float = 1.96) -> tuple[Column, Column]:
    half = F.lit(z) * _c(se)
    return _c(estimate) - half, _c(estimate) + half


def significant(p, level: float = 0.05) -> Column:
    """1 below the level, 0 otherwise, null when p is unknown."""
    return F.when(_c(p).isNull(), F.lit(None).cast("int")).when(_c(p) < level, 1).otherwise(0)


def excludes_zero(lower, upper) -> Column:
    prod = _c(lower) * _c(upper)
    return F.when(prod.isNull(), F.lit(None).cast("int")).when(prod < 0, 0).otherwise(1)
