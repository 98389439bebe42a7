"""Distance joins as equi-joins on grid cells.

Points are binned on physical coordinates in cells of two radii; the left side meets the cells that its radius reaches, four
as a rule, so each pair of points meets once and the join is a sort-merge join on (plane, cell) that adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_radius(radius_um: float) -> float:
    if not math.isfinite(radius_um) or radius_um < 0:
        raise ValueError("the distance must be finite and not negative")
    return float(radius_um)


def cell(coordinate_um: Column, radius_um: float) -> Column:
    """Bin of a coordinate. A radius of 0 needs equal coordinates, for which any cell size serves."""
    return F.floor(coordinate_um / F.lit(2 * radius_um if radius_um > 0 else 1.0)).cast("long")


def reached(coordinate_um: Column, radius_um: float) -> Column:
    """The bins within the radius, and a rounding error more, of a coordinate."""
    reach = F.lit(radius_um * (1 + 1e-9))
    return F.explode(F.sequence(cell(coordinate_um - reach, radius_um), cell(coordinate_um + reach, radius_um)))


def usable(df: DataFrame, columns) -> DataFrame:
    """Rows whose coordinates are numbers; floor(NaN) would become cell 0."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def distance_join(left: DataFrame, right: DataFrame, keys: list[str], radius_um: float) -> DataFrame:
    """Pairs with equal ``keys`` and hypot(dx, dy) <= radius, inclusive.

    Both sides have px and py, physical coordinates in um; all other column names must differ but for the keys. Adds dx_um and
    dy_um (right minus left) and xy_distance_um.
    """
    radius_um = check_radius(radius_um)
    a = usable(left, ("px", "py")).withColumn("__cx", reached(F.col("px"), radius_um)).withColumn("__cy", reached(F.col("py"), radius_um)).withColumnsRenamed({"px": "__ax", "py": "__ay"})
    b = usable(right, ("px", "py")).select("*", cell(F.col("px"), radius_um).alias("__cx"), cell(F.col("py"), radius_um).alias("__cy")).withColumnsRenamed({"px": "__bx", "py": "__by"})
    # never by broadcast: Spark takes a side's size from its compressed file, and the driver would have to hold all of it
    pairs = a.join(b.hint("merge"), [*keys, "__cx", "__cy"])
    dx, dy = F.col("__bx") - F.col("__ax"), F.col("__by") - F.col("__ay")
    return (
        pairs.withColumns({"dx_um": dx, "dy_um": dy, "xy_distance_um": F.hypot(dx, dy)})
        .where(F.col("xy_distance_um") <= radius_um)
        .drop("__ax", "__ay", "__bx", "__by", "__cx", "__cy")
    )
