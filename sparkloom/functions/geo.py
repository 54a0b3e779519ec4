"""Geometry as column arithmetic on latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_MILE = 1609.344
METERS_PER_DEGREE = 111_194.92664455873  # mean earth radius 6371008.8 m


def segment_length(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar length in degrees."""
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north; NULL for a point."""
    turn = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    return F.when((lat1 != lat2) | (lon1 != lon2), F.pmod(turn + F.lit(360.0), F.lit(360.0)))


def segment_direction(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """1 north (315, 45], 2 east, 3 south, 4 west."""
    a = azimuth(lat1, lon1, lat2, lon2)
    return (F.when((a > 315) | (a <= 45), 1).when(a <= 135, 2).when(a <= 225, 3).when(a <= 315, 4))


def miles_to_meters(miles: Column) -> Column:
    return F.round(miles * METERS_PER_MILE)


def parse_latlon(text: Column) -> tuple[Column, Column]:
    """``'32.7 N, 117.1 W'`` as signed latitude and longitude."""
    def part(letters, negative):
        number = F.regexp_extract(text, rf"([0-9.]+)\s*([{letters}])", 1).try_cast("double")
        return F.when(F.regexp_extract(text, rf"[0-9.]+\s*([{letters}])", 1) == negative, -number).otherwise(number)

    return part("NS", "S"), part("EW", "W")


def meters_to_segment(lat: float, lon: float, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance from a fixed point to a segment in a plane tangent at the point."""
    kx = F.cos(F.radians(F.lit(lat))) * METERS_PER_DEGREE
    ax, ay = (lon1 - lon) * kx, (lat1 - lat) * METERS_PER_DEGREE
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * METERS_PER_DEGREE
    norm = dx * dx + dy * dy
    share = F.when(norm == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * dx + ay * dy), norm))))
    px, py = ax + share * dx, ay + share * dy
    return F.sqrt(px * px + py * py)


def parse_linestring(wkt: Column) -> Column:
    """WKT LINESTRING as an ordered array of ``(lon, lat)``; NULL if it is not one."""
    body = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(
        F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("lon"),
        F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("lat")))
    return F.when(body != "", points)


def consecutive_pairs(points: Column) -> Column:
    """Segments between neighbouring points as ``(lat1, lon1, lat2, lon2)``.

    ``points`` is used per segment: give a column of an earlier projection.
    """
    heads = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.transform(heads, lambda p, i: F.struct(
        p["lat"].alias("lat1"), p["lon"].alias("lon1"),
        F.get(points, i + 1)["lat"].alias("lat2"), F.get(points, i + 1)["lon"].alias("lon2")))
