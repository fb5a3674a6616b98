"""Session state over ordered turns, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shabdagrid.operators.windows import carry_forward


def pinned(turns: DataFrame, session: list[str], order: list[str], pin: Column, unpin: Column, out: str = "pinned", block: Column | None = None) -> DataFrame:
    """turns with the value pinned at each of them: the last pin, until a turn unpins it.  A pin on an unpinning turn counts.

    An unpinning is a level above the pin, which it makes forget; with `block` a long session is scanned in parallel."""
    t = turns.withColumn("__t_u", F.when(unpin, F.lit(1))).withColumn("__t_p", pin)
    return carry_forward(t, session, order, ["__t_u", "__t_p"], block).withColumnRenamed("__t_p", out).drop("__t_u")


def visit_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Visits per window and kind.  On a stream, events later than `late` behind the latest are dropped; in batch none is."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, window).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("visits"))
    return g.select(F.col("w.start").alias("day"), kind, "visits")


def run_visit_stream(events: DataFrame, ts: str, kind: str, path: str, checkpoint: str, late: str = "1 day"):
    """Start the counting stream into Parquet; each closed window is written once."""
    out = visit_counts(events, ts, kind, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
