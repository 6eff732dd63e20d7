"""Distances, boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILES, KM, METRES = 3958.7613, 6371.0, 6_371_000.0


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    return a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MILES) -> Column:
    """Great-circle distance; null where a coordinate is."""
    half = F.sqrt(_half_chord(lat1, lon1, lat2, lon2))
    return 2 * radius * F.asin(F.when(half > 1, F.lit(1.0)).otherwise(half))  # least() would skip a null


def usable(lat: Column, lon: Column) -> Column:
    """In range, and not the null island."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres between usable coordinates, else null."""
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2)))
    return F.when(usable(lat1, lon1) & usable(lat2, lon2), 2 * METRES * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def radius_box(lat: float, lon: float, miles: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a box around a circle; it does not wrap at the antimeridian."""
    import math

    up, side = miles / 69.0, miles / (69.0 * max(0.1, math.cos(math.radians(lat))))
    return lat - up, lat + up, lon - side, lon + side


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """In a map view; one whose west lies past its east crosses the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def in_longitude_band(lat: Column, lon1: Column, lon2: Column, radius_m: float) -> Column:
    """Whether two longitudes lie within a radius of each other at a latitude, around the globe."""
    apart = F.abs(lon1 - lon2)
    width = F.least(F.lit(180.0), radius_m / (111_320.0 * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-6))))
    return F.least(apart, 360 - apart) <= width


def view_centre(west: float, east: float) -> float:
    """Middle longitude of a map view that may cross the antimeridian, in [-180, 180)."""
    span = (east - west) % 360
    return (west + span / 2 + 180) % 360 - 180


#: Kilometres of a degree of latitude, rounded down: cells never come out too small.
DEGREE_KM = 111.0


def _row(lat: Column, km: float) -> Column:
    return F.floor((lat + 90) * (DEGREE_KM / km)).cast("bigint")


def _cells_around(row: Column, km: float) -> Column:
    """How many cells the grid row of a latitude has around the globe: each at least km wide all over the row."""
    south = (row * (km / DEGREE_KM) - 90).cast("double")
    widest = F.greatest(F.abs(south), F.abs(south + km / DEGREE_KM))
    width = DEGREE_KM * F.cos(F.radians(F.least(widest, F.lit(89.9999))))
    return F.greatest(F.floor(360 * width / km), F.lit(1)).cast("bigint")


def in_cell(places: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """``places`` with row and col of a grid whose cells are km high and km wide at least, at every latitude."""
    rows = places.withColumn("row", _row(F.col(lat), km))
    n = _cells_around(F.col("row"), km)
    return rows.withColumn("col", F.pmod(F.floor((F.col(lon) + 180) / 360 * n).cast("bigint"), n))


def around_cells(places: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """A row for every cell that can hold a place within km: three rows, each with the cells beside the longitude, around the globe."""
    rows = places.withColumn("row", F.explode(F.array(*[_row(F.col(lat), km) + k for k in (-1, 0, 1)])))
    n = _cells_around(F.col("row"), km)
    col = F.floor((F.col(lon) + 180) / 360 * n).cast("bigint")
    return rows.withColumn("col", F.explode(F.array_distinct(F.array(*[F.pmod(col + k, n) for k in (-1, 0, 1)]))))
