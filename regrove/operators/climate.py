"""Daily weather to seasonal means, normals and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ecology import vapour_deficit
from ..functions.missing import strict_mean
from .joins import natural_inner

SEASON_DAYS = (150, 244)  # fixed value: both ends excluded


def daily_deficit(daily: DataFrame, tmin: str = "tmin", tmax: str = "tmax", vp: str = "vp") -> DataFrame:
    return daily.withColumn("vpd", vapour_deficit(tmin, tmax, vp))


def seasonal_means(daily: DataFrame, site: str = "site", measures: Sequence[str] = ("precip", "tmax", "tmin", "vpd"),
                   days: tuple[int, int] = SEASON_DAYS, year: str = "year", yday: str = "yday") -> DataFrame:
    """Mean of each measure per site and year over the growing season."""
    inside = daily.filter((F.col(yday) > days[0]) & (F.col(yday) < days[1]))
    return inside.groupBy(site, year).agg(*[strict_mean(m).alias(m) for m in measures])


def normals_and_anomalies(yearly: DataFrame, windows: dict[str, tuple[int, int]], site: str = "site",
                          measures: Sequence[str] = ("precip", "tmax", "tmin", "vpd"),
                          year: str = "year", tag: str = "FRI") -> DataFrame:
    """Each scenario's last year beside the scenario mean, and the difference.

    ``windows`` maps a scenario to its first and last year (both included).  The
    scenarios are exploded from literals, so all of them share one pass.
    """
    spec = F.array(*[F.struct(F.lit(k).alias(tag), F.lit(a).alias("__a"), F.lit(b).alias("__b"))
                     for k, (a, b) in windows.items()])
    rows = yearly.withColumn("__w", F.explode(spec)).select(*yearly.columns, "__w.*")
    rows = rows.filter((F.col(year) >= F.col("__a")) & (F.col(year) <= F.col("__b"))).drop("__a", "__b")
    means = rows.groupBy(tag, site).agg(*[strict_mean(m).alias(f"{m}_avg") for m in measures])
    last = rows.groupBy(tag).agg(F.max(year).alias(year))
    out = natural_inner(natural_inner(rows, last, [tag, year]), means, [tag, site])
    return out.withColumns({**{f"{m}_anom": F.col(m) - F.col(f"{m}_avg") for m in measures},
                            "season": F.col(year) + 1})
