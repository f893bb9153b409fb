"""Gates and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import decide, ledger
from tessella.plans.registry import query, table
from tessella.sources import files
from tessella.streaming import journal

S = "SELECT event_type, avg(value) - 40 AS m, 1.645 * stddev_samp(value) / sqrt(count(*)) AS h, count(*) AS n, count(*) FILTER (value > 40) AS above FROM events GROUP BY 1"


@query(f"""WITH s AS ({S}) SELECT event_type, round(m, 6) AS mean, m - h > -5 AND m + h < 5 AS equivalent, m > -20 AS close, above >= 0.2 * n AS signs, m - h > -20 AS not_worse, m > -20 AND above >= 0.2 * n AND m - h > -20 AS all_pass FROM s""")
def gates(spark, sf_dir):
    """Equivalence within a band, and named gates that must all hold."""
    v = F.col("value")
    s = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg(v) - 40).alias("m"), (1.645 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias("h"), F.count(v).alias("n"), F.count_if(v > 40).alias("above"))
    m, h = F.col("m"), F.col("h")
    return s.select("event_type", F.round("m", 6).alias("mean"), decide.equivalent(m - h, m + h, 5.0).alias("equivalent"), *decide.all_pass({"close": m > -20, "signs": F.col("above") >= 0.2 * F.col("n"), "not_worse": m - h > -20}))


LEDGER = """e AS (SELECT user_id::VARCHAR AS stage, epoch_us(ts) / 1e6 AS time, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'heartbeat' END AS event FROM events WHERE event_type IN ('view', 'purchase', 'click')),
s AS (SELECT stage, time, lead(time) OVER (PARTITION BY stage ORDER BY time) AS nxt FROM e WHERE event = 'start'),
j AS (SELECT s.stage, s.time, max(e.time - s.time) FILTER (e.event = 'finish') AS fin, max(e.time) FILTER (e.event = 'heartbeat') AS beat FROM s LEFT JOIN e ON e.stage = s.stage AND e.event <> 'start' AND e.time >= s.time AND (nxt IS NULL OR e.time < nxt) GROUP BY 1, 2)"""


@query(f"""WITH {LEDGER}
SELECT stage, count(*) AS starts, round(sum(coalesce(fin, greatest(coalesce(beat, time) - time, 0))), 3) AS seconds FROM j GROUP BY 1""")
def stage_ledger(spark, sf_dir):
    """Seconds charged to each stage: finishes, else to the last heartbeat."""
    return ledger.stage_seconds(stages(spark, sf_dir)).groupBy("stage").agg(F.count(F.lit(1)).alias("starts"), F.round(F.sum("seconds"), 3).alias("seconds"))


def stages(spark, sf_dir):
    """Events as a ledger: of each user a stage that views start, clicks keep alive and purchases finish."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "start", "purchase", "finish", "click", "heartbeat")])
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stage"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.try_element_at(kind, "event_type").alias("event"), F.lit(None).cast("double").alias("seconds"))
    return e.where("event IS NOT NULL")


@query(f"""WITH {LEDGER}, n AS (SELECT t AS time, lead(t) OVER (ORDER BY t) AS following FROM (SELECT DISTINCT time AS t FROM e WHERE event = 'start'))
SELECT stage, count(*) AS starts, round(sum(coalesce(fin, greatest(least(coalesce(beat, time) + 600, following) - time, 0))), 3) AS seconds FROM j JOIN n USING (time) GROUP BY 1""")
def graced_ledger(spark, sf_dir):
    """The same with one heartbeat's grace of 600 seconds for what did not finish, up to the next start of any stage."""
    return ledger.stage_seconds(stages(spark, sf_dir), None, 600.0).groupBy("stage").agg(F.count(F.lit(1)).alias("starts"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first FROM events GROUP BY 1""")
def journal_once(spark, sf_dir):
    """Events written to journals, purchases twice, followed as a stream of lines, appended once each, and read again."""
    path = files.folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.unionAll(events.where("event_type = 'purchase'")).select(F.to_json(F.struct("event_id", "event_type", "value")).alias("line")).write.text(f"{path}/journals")
    journal.register(spark)
    rows = journal.parsed(journal.follow(spark, f"{path}/journals"), "event_id LONG, event_type STRING, value DOUBLE")
    journal.append_once(rows, "event_id", f"{path}/rows", f"{path}/checkpoint")
    found = spark.read.parquet(f"{path}/rows")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS used, round(greatest(100000 - sum(value), 0), 4) AS remaining FROM events WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM events) GROUP BY 1""")
def replayed_budget(spark, sf_dir):
    """A log up to its checkpoint, and what is left of each budget."""
    events = table(spark, sf_dir, "events")
    log = ledger.replay(events, "event_id", (events.agg(F.max("event_id")).first()[0] or 0) * 9 // 10)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("used"), F.round(F.greatest(100000 - F.sum("value"), F.lit(0.0)), 4).alias("remaining"))
