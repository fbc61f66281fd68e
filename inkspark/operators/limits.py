"""Sliding-window accounting of requests and tokens, replayed over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(events: DataFrame, seconds: int, by: list[str], value: Column | None = None, out: str = "n", at: str = "ts") -> DataFrame:
    """Add the count (or sum) of a key's events in (t - seconds, t]: an entry leaves at the full age."""
    w = Window.partitionBy(*by).orderBy("_us").rangeBetween(-(seconds * 1_000_000) + 1, 0)
    rows = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    return rows.withColumn(out, (F.count(F.lit(1)) if value is None else F.sum(value)).over(w)).drop("_us")


def sliding_global(events: DataFrame, seconds: int, out: str = "n", at: str = "ts") -> DataFrame:
    """The same over all events at once, without a single-task window: time is cut into slices as long as the window, and
    every event also stands, as context only, in the slice after its own."""
    width = seconds * 1_000_000
    rows = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_slice", F.expr(f"_us div {width}"))
    halo = F.explode(F.array(F.struct(F.col("_slice").alias("s"), F.lit(True).alias("own")), F.struct((F.col("_slice") + 1).alias("s"), F.lit(False).alias("own"))))
    rows = rows.withColumn("_x", halo)
    w = Window.partitionBy("_x.s").orderBy("_us").rangeBetween(-width + 1, 0)
    return rows.withColumn(out, F.count(F.lit(1)).over(w)).where("_x.own").drop("_us", "_slice", "_x")


def route_shares(weights: dict[str, int], n: Column) -> Column:
    """Round robin over a pool by weight for the n-th request (from 0), if none fails."""
    order = [name for name, w in weights.items() for _ in range(w)]
    return F.element_at(F.array(*[F.lit(x) for x in order]), (n % len(order) + 1).cast("int"))
