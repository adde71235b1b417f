"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import EARTH_KM, HOME


def great_circle(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Kilometres between two points; null if any coordinate is."""
    dlat, dlon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(chord))


def km_from_home(lat: Column, lon: Column, home: tuple[float, float] = HOME) -> Column:
    """Whole kilometres from home, rounded half to even."""
    return F.bround(great_circle(F.lit(home[0]), F.lit(home[1]), lat, lon)).cast("int")


def within_radius(points: DataFrame, centres: DataFrame, radius_km: float) -> DataFrame:
    """Points (with lat, lon) paired with the centres (centre, centre_lat, centre_lon) within a radius.

    An equality join on cells of the size of the radius, then the exact distance: no all-pairs comparison. Each centre
    is entered in the nine cells around it (more at high latitudes), each point in one.
    """
    step = radius_km / 110.0
    wide = F.ceil(1 / F.cos(F.radians(F.least(F.abs(F.col("centre_lat")) + step, F.lit(85.0))))).cast("int")
    cell = lambda c: F.floor(c / step).cast("int")
    entered = centres.withColumn("cell_y", F.explode(F.sequence(cell(F.col("centre_lat")) - 1, cell(F.col("centre_lat")) + 1))).withColumn(
        "cell_x", F.explode(F.sequence(cell(F.col("centre_lon")) - wide, cell(F.col("centre_lon")) + wide))
    )
    placed = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("cell_y", cell(F.col("lat"))).withColumn("cell_x", cell(F.col("lon")))
    km = great_circle(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon"))
    return placed.join(entered, ["cell_y", "cell_x"]).withColumn("km", km).filter(F.col("km") <= radius_km).drop("cell_y", "cell_x")
