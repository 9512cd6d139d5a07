"""Length of MIDI files from their tempo changes: a running tempo by window, sums per track, and the longest track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TEMPO = 500_000


def durations(events: DataFrame, tempos: DataFrame | None = None) -> DataFrame:
    """(file_id, length_secs) of events (file_id, track, tick, tempo, division); tempo is null but for tempo changes.

    With tempos (file_id, tick, tempo), the first track's map holds for all tracks, as in files of format 1; without,
    each track has its own. A change at a tick holds from that tick on, and of several the last in event order (seq).
    """
    per = ["file_id", "track"]
    if tempos is not None:
        ends = events.groupBy("file_id", "track").agg(F.max("tick").alias("end"), F.first("division").alias("division"))
        marks = ends.select("file_id", "track", F.lit(0).cast("bigint").alias("tick"), F.lit(DEFAULT_TEMPO).cast("bigint").alias("tempo"), F.lit(-1).cast("bigint").alias("seq"), "end", "division")
        changes = ends.join(tempos.select("file_id", "tick", "tempo", "seq"), "file_id").where("tick < end").select("file_id", "track", "tick", "tempo", "seq", "end", "division")
        rows = marks.unionByName(changes)
    else:
        last = Window.partitionBy(*per)
        rows = events.withColumn("end", F.max("tick").over(last)).where("tempo is not null").select("file_id", "track", "tick", "tempo", "seq", "end", "division")
        starts = events.groupBy(*per).agg(F.max("tick").alias("end"), F.first("division").alias("division"))
        rows = rows.unionByName(starts.select("file_id", "track", F.lit(0).cast("bigint").alias("tick"), F.lit(DEFAULT_TEMPO).cast("bigint").alias("tempo"), F.lit(-1).cast("bigint").alias("seq"), "end", "division"))
    order = Window.partitionBy(*per).orderBy("tick", "seq")
    rows = rows.withColumn("next", F.coalesce(F.lead("tick").over(order), F.col("end")))
    secs = (F.least("next", "end") - F.col("tick")) * F.col("tempo") / F.col("division") / 1e6
    return rows.groupBy(*per).agg(F.sum(secs).alias("secs")).groupBy("file_id").agg(F.max("secs").alias("length_secs"))
