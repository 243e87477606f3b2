"""The survey's stateful streams over the events table: each is run to the end of its input, and held against a batch oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.book import book
from tessera.sources.folders import scratch
from tessera.sources.tables import table
from tessera.streaming import feeds, states

QUERIES, ORACLES, query = book()


def run(spark: SparkSession, d: str, make) -> DataFrame:
    """What the stream made of the events gives for all of them, taken as one micro-batch and what its timers bring after it."""
    own = states.stateful(spark)
    path = f"{d}/events.parque[t]"  # a pattern, since the table may be a folder or one file, which a stream takes by a pattern only
    rows = own.readStream.schema(table(spark, d, "events").schema).parquet(path)
    out = scratch(spark, "stream-out")
    got = feeds.drained(make(rows), out, scratch(spark, "stream-state"))
    return spark.read.schema(got.schema).parquet(out)


_LAST = "SELECT user_id, max(epoch_us(ts) // 1000) AS last, min(epoch_us(ts) // 1000) AS born, sum(floor(value * 16))::DOUBLE AS budget, arg_max(event_type, (ts, event_type = 'purchase')) = 'purchase' AS done FROM events GROUP BY user_id"


@query("t02_stall_timers", f"""WITH l AS ({_LAST}), n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events), k AS (SELECT user_id, last, unnest(generate_series(1, least(3, (now - last) // 5400000))) AS attempt FROM l, n WHERE NOT done)
  SELECT user_id, CASE WHEN attempt <= 2 THEN 'requeue' ELSE 'fail' END AS action, CAST(attempt AS INTEGER) AS attempt, CAST(last + attempt * 5400000 AS BIGINT) AS at_ms FROM k""")
def t02(spark, d):
    """A user without an event for 90 minutes is queued again twice, then failed; a purchase as the last event ends the watch."""
    return run(spark, d, lambda s: states.stalled(s, "user_id", F.col("event_type") == "purchase", 90, 2))


@query("t03_expiry_timers", f"""WITH l AS ({_LAST}), n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events), e AS (SELECT user_id, greatest(born + greatest(CAST(floor(budget * 60.0::DOUBLE * 1000) AS BIGINT), 36000000), last + 3600000) AS due FROM l)
  SELECT user_id, due AS expired_ms FROM e, n WHERE due <= now""")
def t03(spark, d):
    """Older than what its events' values allow (ten hours at least), and an hour without one."""
    return run(spark, d, lambda s: states.expired(s, "user_id", F.floor(F.col("value") * 16), 60.0, 36000, 3600))


@query("t09_ttl_state", """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, t AS stored, false AS inside FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN r.t - s.stored <= 7200000 THEN s.stored ELSE r.t END, r.t - s.stored <= 7200000 FROM s JOIN r ON s.user_id = r.user_id AND r.k = s.k + 1)
  SELECT event_id, inside FROM s""")
def t09(spark, d):
    """Lookups of a cache of two hours, a key a user."""
    return run(spark, d, lambda s: states.until(s, "user_id", F.lit(True), 7200))


@query("t16_cooldown_state", """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, CASE WHEN failed THEN t + 21600000 ELSE -1 END AS until, false AS inside FROM r WHERE k = 1
    UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN r.t > s.until AND r.failed THEN r.t + 21600000 ELSE s.until END, r.t <= s.until FROM s JOIN r ON s.user_id = r.user_id AND r.k = s.k + 1)
  SELECT event_id, inside FROM s""")
def t16(spark, d):
    """A user whose attempt failed is passed over for six hours, then tried again."""
    return run(spark, d, lambda s: states.until(s, "user_id", F.col("event_type") == "error", 21600))


@query("t10_retention_state", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k > 20")
def t10(spark, d):
    """What leaves each user's list of the twenty newest events."""
    return run(spark, d, lambda s: states.retired(s, "user_id", 20))


@query("t12_resumed_backfill", """WITH m AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS half FROM events)
  SELECT event_id, CASE WHEN epoch_us(ts) <= half THEN 1 ELSE 2 END AS run FROM events, m""")
def t12(spark, d):
    """Two runs with one checkpoint: the second begins where the first ended, when the later half of the events has come."""
    folder, out, state = (scratch(spark, f"backfill-{n}") for n in ("in", "out", "state"))
    events = table(spark, d, "events").select("event_id", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    half = events.agg(F.expr("min(unix_micros(cast(ts as timestamp)))").alias("a"), F.expr("max(unix_micros(cast(ts as timestamp)))").alias("b")).select(F.expr("a + (b - a) div 2").alias("half")).first()["half"]
    for number, part in enumerate((micros <= half, micros > half), 1):
        events.where(part if half is not None else F.lit(number == 1)).write.mode("append").parquet(folder)
        states.backfill(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(folder), out, state, number)
    return spark.read.schema("event_id long, run int").parquet(f"{out}/*").select("event_id", "run")
