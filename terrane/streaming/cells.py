"""Cell averages over a stream of measurements. State is one row of sums for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import Moments, direction_cosines, whole


def streaming_average(stream: DataFrame, minx: float, miny: float, size: float) -> DataFrame:
    """O3 for a stream of easting, northing, dip, dip_dir, with given lower bounds
    (a stream has no last row to take them from). For output modes complete and update."""
    terms = Moments.terms(*direction_cosines(F.col("dip"), F.col("dip_dir")))
    cells = stream.withColumns({"cx": F.floor((F.col("easting") - minx) / size), "cy": F.floor((F.col("northing") - miny) / size)})
    sums = cells.groupBy("cx", "cy").agg(*(F.sum(getattr(terms, n)).alias(f"s_{n}") for n in Moments.NAMES))
    dip, direction = Moments.of().mean()
    return sums.select(whole(minx + (F.col("cx") + 0.5) * size).alias("easting"), whole(miny + (F.col("cy") + 0.5) * size).alias("northing"), whole(dip).alias("dip"), whole(direction).alias("dip_dir"), F.col("s_n").alias("n"))
