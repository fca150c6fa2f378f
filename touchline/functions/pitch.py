"""Drawing coordinates of a shot on the attacking half."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.numbers import clamp

# Half pitch of 560 x 320 units, data pitch of 120 x 80.
HALF_WIDTH, HALF_HEIGHT, MARGIN = 560.0, 320.0, 4.0
DATA_LENGTH, DATA_HEIGHT, HALFWAY = 120.0, 80.0, 60.0
RADIUS_PER_XG, RADIUS_MIN, RADIUS_MAX = 65, 8, 20
BAR_FULL, BAR_FULL_XG = 140, 0.5


def map_x(x: Column) -> Column:
    scaled = (x - HALFWAY) / (DATA_LENGTH - HALFWAY) * HALF_WIDTH
    return clamp(scaled, MARGIN, HALF_WIDTH - MARGIN)


def map_y(y: Column) -> Column:
    return clamp(y / DATA_HEIGHT * HALF_HEIGHT, MARGIN, HALF_HEIGHT - MARGIN)


def marker_radius(xg: Column) -> Column:
    return clamp((xg * RADIUS_PER_XG).cast("int"), RADIUS_MIN, RADIUS_MAX)


def bar_width(xg: Column) -> Column:
    return F.least(F.lit(BAR_FULL), (xg * BAR_FULL / BAR_FULL_XG).cast("int"))
