"""Journals of stages: durations from starts, heartbeats and finishes; recovery and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.packing import range_of


def stage_seconds(events: DataFrame, now: float | None = None, heartbeat: float | None = None) -> DataFrame:
    """(stage, started, seconds) of every start in events(time, event, stage, seconds).

    A finished start is charged what its finish says. An unfinished one is charged to its last heartbeat, plus one heartbeat
    interval where that is given, but not past the next start of any stage, nor past ``now``.
    """
    ranged = events.select("stage", "time", "event", "seconds", range_of(events, "time").alias("_range"))
    start = F.when(F.col("event") == "start", F.col("time"))
    # the last start of the ranges before, by stage, then the last one within the range: no window spans a stage
    ends = ranged.groupBy("stage", "_range").agg(F.max(start).alias("_last"))
    ahead = Window.partitionBy("stage").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("stage").alias("_stage"), F.col("_range").alias("_in"), F.last("_last", True).over(ahead).alias("_carried"))
    joined = ranged.join(carried, (F.col("stage") == F.col("_stage")) & (F.col("_range") == F.col("_in")))
    here = Window.partitionBy("stage", "_range").orderBy("time", F.col("event") != "start").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("started", F.coalesce(F.last(start, True).over(here), F.col("_carried"))).where("started IS NOT NULL")
    found = placed.groupBy("stage", "started").agg(
        F.max(F.when(F.col("event") == "finish", F.coalesce("seconds", F.col("time") - F.col("started")))).alias("finished"),
        F.max(F.when(F.col("event") == "heartbeat", F.col("time"))).alias("beat"),
    )
    last = F.coalesce("beat", "started")
    if heartbeat is not None:
        # the next start of any stage: within the range, or the first of the ranges after
        every = ranged.where("event = 'start'").select("_range", F.col("time").alias("_t")).distinct()
        firsts = every.groupBy("_range").agg(F.min("_t").alias("_first"))
        after = firsts.select(F.col("_range").alias("_in"), F.lead("_first").over(Window.orderBy("_range")).alias("_after"))  # a row for each range
        following = every.withColumn("_next", F.lead("_t").over(Window.partitionBy("_range").orderBy("_t"))).join(after, F.col("_range") == F.col("_in"))
        found = found.join(following.select("_t", F.coalesce("_next", "_after").alias("next_any")), F.col("started") == F.col("_t"), "left")
        last = F.least(last + heartbeat, *([F.col("next_any")] + ([F.lit(float(now))] if now is not None else [])))
    open_ = F.greatest(last - F.col("started"), F.lit(0.0))
    return found.select("stage", "started", F.coalesce("finished", open_).alias("seconds"))


def recovered(lines: DataFrame, number: str, line: str, schema: str) -> DataFrame:
    """Parsed rows of a journal of JSON lines. Only its last line may be torn, and is dropped then; any other raises."""
    parsed = lines.select(number, line, F.from_json(line, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    last = lines.agg(F.max(number)).first()[0]
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    kept = parsed.where(~(bad & (F.col(number) == F.lit(last))))
    checked = kept.withColumn("_r", F.when(bad, F.raise_error(F.concat(F.lit("torn line "), F.col(number).cast("string")))).otherwise(F.col("_r")))
    return checked.select(number, "_r.*").drop("_corrupt")


def replay(log: DataFrame, step: str, checkpoint: int) -> DataFrame:
    """Rows up to a checkpoint's step; what was logged beyond it will be logged again."""
    return log.where(F.col(step) <= checkpoint)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")
