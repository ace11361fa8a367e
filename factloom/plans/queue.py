"""Queries for the queue and its state machines over the events, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import queue as Q
from factloom.session import table
from factloom.streaming import folds

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null")
    return e.select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
r AS (SELECT n, user_id, event_id, true AS admitted, CAST(0 AS BIGINT) AS retry_after, [{'t': t, 'u': user_id}] AS kept FROM e WHERE n = 1
  UNION ALL SELECT n, user_id, event_id, len(live) < 15 AND len(mine) < 1, CASE WHEN len(live) < 15 AND len(mine) < 1 THEN 0 ELSE CAST(greatest(1, ceil(greatest(CASE WHEN len(live) >= 15 THEN live[1].t ELSE 0 END, CASE WHEN len(mine) >= 1 THEN mine[1].t ELSE 0 END) + 3600 - t)) AS BIGINT) END,
    CASE WHEN len(live) < 15 AND len(mine) < 1 THEN list_append(live, {'t': t, 'u': user_id}) ELSE live END
  FROM (SELECT e.n AS n, e.user_id AS user_id, e.event_id AS event_id, e.t AS t, list_filter(r.kept, lambda x: x.t >= e.t - 3600) AS live, list_filter(r.kept, lambda x: x.t >= e.t - 3600 AND x.u = e.user_id) AS mine FROM r JOIN e ON e.n = r.n + 1))
SELECT user_id, event_id, admitted, retry_after FROM r""")
def rate_limit_admissions(spark: SparkSession, d: str) -> DataFrame:
    """At most one event of a user and fifteen of all within an hour."""
    return Q.admission(_events(spark, d), "user_id", "t", "event_id", 1, 15, 3600.0)


_PENDING = """p AS (SELECT user_id AS tmdb_id, arg_max(event_id, (ts, event_id)) AS receipt, min(epoch_us(ts)) AS requested_at, max(epoch_us(ts)) - 86400000000 AS next_eligible_at FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY user_id),
c AS (SELECT user_id, min(epoch_us(ts)) AS done FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 GROUP BY user_id),
q AS (SELECT p.*, CASE WHEN c.done > p.requested_at THEN c.done END AS completed_at FROM p LEFT JOIN c ON c.user_id = p.tmdb_id)"""
_NOW = 1_706_400_000_000_000


def _pending(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    submits = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("tmdb_id")).agg(
        F.max_by("event_id", F.struct("us", "event_id")).alias("receipt"), F.min("us").alias("requested_at"), (F.max("us") - 86_400_000_000).alias("next_eligible_at")
    )
    done = e.where("event_type = 'purchase' and event_id % 3 = 0").groupBy("user_id").agg(F.min("us").alias("done"))
    met = submits.join(done, F.col("tmdb_id") == F.col("user_id"), "left")
    return met.select("tmdb_id", "receipt", "requested_at", "next_eligible_at", F.when(F.col("done") > F.col("requested_at"), F.col("done")).alias("completed_at"))


@query(f"""
WITH {_PENDING}, t AS (SELECT tmdb_id FROM q WHERE completed_at IS NULL AND next_eligible_at <= {_NOW} ORDER BY next_eligible_at, requested_at, tmdb_id LIMIT 3)
SELECT tmdb_id, receipt, CASE WHEN tmdb_id IN (SELECT tmdb_id FROM t) THEN {_NOW} + 600000000 ELSE next_eligible_at END AS next_eligible_at, tmdb_id IN (SELECT tmdb_id FROM t) AS handed_out FROM q""")
def snapshot_step(spark: SparkSession, d: str) -> DataFrame:
    stepped = Q.snapshot_step(_pending(spark, d), F.lit(_NOW), 3, F.lit(600_000_000))
    return stepped.select("tmdb_id", "receipt", "next_eligible_at", "handed_out")


@query(f"""
WITH {_PENDING}, a AS (SELECT event_id % 40 AS batch, user_id AS tmdb_id, event_id - (event_id % 2) AS receipt, event_id % 97 <> 0 AS proof_ok FROM events WHERE event_type = 'signup'), b AS (SELECT batch, bool_and(proof_ok) AS good FROM a GROUP BY batch)
SELECT a.batch AS batch, a.tmdb_id AS tmdb_id, CASE WHEN NOT good THEN 'rejected' WHEN q.receipt IS DISTINCT FROM a.receipt OR q.receipt IS NULL THEN 'stale' WHEN completed_at IS NOT NULL THEN 'already_complete' ELSE 'complete' END AS state
FROM a JOIN b ON a.batch = b.batch LEFT JOIN q ON q.tmdb_id = a.tmdb_id""")
def conditional_complete(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements with a current, an old or a wrong receipt, in batches of which some have a bad proof."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    acks = e.select((F.col("event_id") % 40).alias("batch"), F.col("user_id").alias("tmdb_id"), (F.col("event_id") - F.col("event_id") % 2).alias("receipt"), (F.col("event_id") % 97 != 0).alias("proof_ok"))
    return Q.conditional_complete(_pending(spark, d), acks)


@query(f"""
WITH {_PENDING} SELECT e.user_id AS tmdb_id, e.event_id AS receipt, CASE WHEN q.tmdb_id IS NULL THEN 'unknown' WHEN completed_at IS NULL THEN 'pending' ELSE 'complete' END AS status
FROM events e LEFT JOIN q ON q.tmdb_id = e.user_id AND q.receipt = e.event_id WHERE event_type = 'signup'""")
def receipt_status(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("tmdb_id"), F.col("event_id").alias("receipt"))
    return Q.receipt_status(_pending(spark, d), asked)


@query(f"""
WITH {_PENDING}, l AS (SELECT c_custkey AS tmdb_id, {_NOW} - c_custkey * 1000000000 AS asked FROM customer), f AS (SELECT * FROM l WHERE asked >= {_NOW} - 864000000000 AND tmdb_id NOT IN (SELECT tmdb_id FROM q)),
n AS (SELECT *, row_number() OVER (ORDER BY asked, tmdb_id) AS k FROM f)
SELECT tmdb_id, asked AS requested_at, greatest({_NOW}, asked + 600000000) AS next_eligible_at FROM n WHERE k <= 1000 - (SELECT count(*) FILTER (WHERE completed_at IS NULL) FROM q)""")
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Older requests taken over into the queue as far as there is room."""
    legacy = table(spark, d, "customer").select(F.col("c_custkey").alias("tmdb_id"), (F.lit(_NOW) - F.col("c_custkey") * 1_000_000_000).alias("at"))
    return Q.imported(_pending(spark, d), legacy, F.lit(_NOW), F.lit(864_000_000_000), F.lit(600_000_000), 1000)


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE user_id IS NOT NULL), c AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM b WHERE place <= 3)
SELECT user_id, event_id, place FROM c WHERE coalesce(bad, 0) = 0""")
def sequential_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first three events, up to the first error."""
    e = table(spark, d, "events").where("user_id is not null")
    return Q.bounded_batch(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(f"""
WITH RECURSIVE {_E},
r AS (SELECT user_id, event_id, n, CASE WHEN event_type = 'signup' THEN event_id END AS receipt, CASE WHEN event_type = 'signup' THEN t END AS due, false AS done, CASE WHEN event_type = 'signup' THEN 'pending' ELSE 'unknown' END AS outcome FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n,
    CASE WHEN e.event_type = 'signup' THEN e.event_id ELSE r.receipt END,
    CASE WHEN e.event_type = 'signup' AND (r.receipt IS NULL OR r.done) THEN e.t WHEN e.event_type IN ('view', 'click') AND r.receipt IS NOT NULL AND NOT r.done AND r.due <= e.t THEN e.t + 600 ELSE r.due END,
    CASE WHEN e.event_type = 'signup' THEN false WHEN e.event_type = 'purchase' AND r.receipt IS NOT NULL AND NOT r.done THEN true ELSE r.done END,
    CASE WHEN e.event_type = 'signup' THEN 'pending' WHEN r.receipt IS NULL THEN 'unknown' WHEN e.event_type IN ('view', 'click') THEN CASE WHEN NOT r.done AND r.due <= e.t THEN 'handed_out' ELSE 'not_due' END WHEN r.done THEN 'already_complete' WHEN e.event_type = 'error' THEN 'stale' ELSE 'complete' END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, outcome FROM r""")
def pending_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each user's queue entry through its events: signup submits, view and click ask for a snapshot, purchase completes with the current receipt, error with a wrong one."""
    kind = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type").isin("view", "click"), "snapshot").otherwise("complete")
    e = _events(spark, d).withColumn("kind", kind).withColumn("wrong", F.col("event_type") == "error")
    return folds.fold(e.select("user_id", "event_id", "t", "kind", "wrong"), "user_id", ["t", "event_id"], folds.pending_entry(600.0), "user_id long, event_id long, outcome string")


@query(f"""
WITH RECURSIVE {_E},
r AS (SELECT user_id, event_id, n, t AS last, true AS granted FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.last >= 120 THEN e.t ELSE r.last END, e.t - r.last >= 120 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, granted FROM r""")
def status_windows(spark: SparkSession, d: str) -> DataFrame:
    """One status window in 120 seconds."""
    found = folds.fold_columns(_events(spark, d), "user_id", ["t", "event_id"], folds.cool_down_columns(120.0), "user_id long, event_id long, granted boolean")
    return found


_PHASE = """CASE WHEN e.event_type = 'signup' AND r.phase = '' THEN 'PREPARED' WHEN e.event_type = 'view' AND r.phase = 'PREPARED' THEN 'SUBMIT' WHEN e.event_type = 'click' AND r.phase = 'SUBMIT' THEN CASE WHEN e.event_id % 5 = 0 THEN 'LEGACY' ELSE 'RECEIPT' END
  WHEN e.event_type = 'error' AND r.phase = 'RECEIPT' THEN 'CANONICAL' WHEN e.event_type = 'error' AND r.phase = 'LEGACY' AND r.tries = 2 THEN 'SUBMIT' WHEN e.event_type = 'purchase' AND r.phase = 'CANONICAL' THEN '' ELSE r.phase END"""


@query(f"""
WITH RECURSIVE {_E}, s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS phase, 0 AS tries FROM e),
r AS (SELECT user_id, n, event_id, phase, tries FROM s UNION ALL SELECT e.user_id, e.n, e.event_id, {_PHASE}, CASE WHEN r.phase = 'LEGACY' AND e.event_type = 'error' THEN (r.tries + 1) % 3 ELSE r.tries END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, phase FROM r WHERE n > 0""")
def obligation_phases(spark: SparkSession, d: str) -> DataFrame:
    """Each user's obligation through its phases; an event that doesn't fit the phase changes nothing."""
    kinds = {"signup": "prepare", "view": "activate", "click": "submitted", "error": "told", "purchase": "verified"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    e = _events(spark, d).withColumn("kind", kind).withColumn("receipt", F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")))
    return folds.fold(e.select("user_id", "event_id", "t", "kind", "receipt"), "user_id", ["t", "event_id"], folds.obligation(), "user_id long, event_id long, phase string")
