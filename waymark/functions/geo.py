"""Planar geometry on (lat, lon) columns, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells of this many radii have a diagonal just under one radius.
DIAGONAL_FIT = 0.7071
# Cell bounds are widened by this share so that rounding never loses a pair on the limit.
SLACK = 1e-9


def squared_distance(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Products, not pow(): the value is then the same in every SQL engine, bit for bit."""
    d_lat, d_lon = lat_a - lat_b, lon_a - lon_b
    return d_lat * d_lat + d_lon * d_lon


def distance(lat_a, lon_a, lat_b, lon_b) -> Column:
    return F.sqrt(squared_distance(lat_a, lon_a, lat_b, lon_b))


def within_radius(lat_a, lon_a, lat_b, lon_b, radius) -> Column:
    """True where the points are at most `radius` apart; the limit belongs to the circle."""
    return squared_distance(lat_a, lon_a, lat_b, lon_b) <= radius * radius


def grid_cell(coordinate, size) -> Column:
    return F.floor(coordinate / size).cast("int")


def grid_cell_ceil(coordinate, radius) -> Column:
    return F.ceil(coordinate / (radius * 2)).cast("int")


def cells_in_reach(coordinate, radius, size) -> Column:
    """Indexes of all cells of `size` that hold a coordinate within `radius`."""
    reach = radius * (1 + SLACK)
    return F.sequence(F.floor((coordinate - reach) / size), F.floor((coordinate + reach) / size))


def round_coordinate(coordinate, base=100) -> Column:
    """Half up to 1/base."""
    return lattice_index(coordinate, base) / F.lit(float(base))


def lattice_index(coordinate, base=100) -> Column:
    return F.floor(coordinate * base + 0.5)


def polar_offset(lat, lon, center_lat, center_lon) -> tuple[Column, Column]:
    """Distance and angle of a point as seen from a centre."""
    d_lat, d_lon = lat - center_lat, lon - center_lon
    return F.hypot(d_lat, d_lon), F.atan2(d_lon, d_lat)
