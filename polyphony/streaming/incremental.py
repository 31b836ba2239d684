"""Cell sums kept up to date on a stream (an extension: the cosine metrics rest on additive sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyphony.operators import vectors


def unique_in_time(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Second deliveries of a key within the watermark are dropped; the state of older keys is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def partial_sums(stream: DataFrame, keys: tuple[str, ...] = vectors.CELL, e: str = "e") -> DataFrame:
    """keys, pos, v, n: a running aggregation for update or complete mode; its state is one number a cell and position."""
    flat = stream.dropna(subset=[*keys, e]).select(*keys, F.posexplode(F.col(e).cast("array<double>")).alias("pos", "v"))
    return flat.groupBy(*keys, "pos").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


def cells(partial: DataFrame, keys: tuple[str, ...] = vectors.CELL) -> DataFrame:
    """keys, n, s from the sums as they stand."""
    out = partial.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return out.select(*keys, "n", F.col("p.v").alias("s"))
