"""The queries p2, p4 and p5 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.changefeed import MergeTable, feed_entries
from factloom.operators.history import snapshot_history, state_history, strip_outer
from factloom.operators.snapshots import snapshot_changes
from factloom.session import scratch, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = state_history(table(spark, sf_dir, "monitored_changes"), "tmdbId", "timestamp", "oldState", "newState")
    return periods.select(
        F.col("entity").alias("tmdbId"), "state", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to")
    )


def p2_snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bitmaps over periodic snapshots: runs of snapshots in which a series shows a status."""
    rows = table(spark, sf_dir, "official_series_data").withColumn("state", F.upper(strip_outer(F.col("status"))))
    runs = snapshot_history(rows, "snapshot_id", "tmdbId", "state")
    return runs.select(F.col("entity").alias("tmdbId"), F.col("state").alias("status"), "first_snapshot", "last_snapshot")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "official_series_data")
    compared = [
        F.col("nextSeasonNumber"), F.upper(strip_outer(F.col("status"))), F.col("releaseDate"), F.col("releaseYear"), F.col("announcementDate"),
    ]
    latest = [F.col("lastChecked"), F.col("deliveredAt"), F.col("row_id")]
    found = snapshot_changes(rows, "snapshot_id", "tmdbId", compared, latest)
    return found.select(F.col("snapshot").alias("snapshot_id"), F.col("key").alias("tmdbId"), "change_kind")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "changes")
    merge_table = MergeTable(spark, scratch(spark, "p5"))
    entries = feed_entries(feed, "tmdbId", "timestamp", "old", "new", receivedAt=F.col("receivedAt"))
    quarter = F.coalesce(F.date_format(F.date_trunc("quarter", "receivedAt"), "yyyyMM"), F.lit("none"))
    merge_table.append_by(entries, quarter)
    return merge_table.current().select(F.col("key").alias("tmdbId"), "record.nextSeasonNumber", "record.status", "record.sourceUrl")


QUERIES = {"p2_found": p2_found, "p2_snapshot_status": p2_snapshot_status, "p4_found": p4_found, "p5_found": p5_found}

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

ORACLES = {
    "p2_found": f"""
WITH c AS (
  SELECT DISTINCT tmdbId, CAST(floor(epoch(timestamp)) AS BIGINT) AS t,
         upper({_STRIP.format('oldState')}) AS o, upper({_STRIP.format('newState')}) AS n
  FROM monitored_changes WHERE tmdbId IS NOT NULL AND newState IS NOT NULL),
ends AS (
  SELECT tmdbId, t, max(n) AS state FROM c a
  WHERE (SELECT count(*) FROM c b WHERE b.tmdbId = a.tmdbId AND b.t = a.t AND b.n = a.n AND b.o IS DISTINCT FROM b.n)
      > (SELECT count(*) FROM c b WHERE b.tmdbId = a.tmdbId AND b.t = a.t AND b.o = a.n AND b.o IS DISTINCT FROM b.n)
     OR NOT EXISTS (SELECT 1 FROM c b WHERE b.tmdbId = a.tmdbId AND b.t = a.t AND b.o IS DISTINCT FROM b.n)
  GROUP BY ALL),
marked AS (SELECT *, lag(state) OVER (PARTITION BY tmdbId ORDER BY t) AS before FROM ends)
SELECT tmdbId, state, t AS valid_from, coalesce(lead(t) OVER (PARTITION BY tmdbId ORDER BY t), -1) AS valid_to
FROM marked WHERE before IS DISTINCT FROM state""",
    "p2_snapshot_status": f"""
WITH r AS (SELECT snapshot_id, dense_rank() OVER (ORDER BY snapshot_id) AS n FROM (SELECT DISTINCT snapshot_id FROM official_series_data)),
s AS (SELECT DISTINCT tmdbId, upper({_STRIP.format('status')}) AS status, snapshot_id FROM official_series_data WHERE tmdbId IS NOT NULL),
g AS (SELECT tmdbId, status, snapshot_id, n - row_number() OVER (PARTITION BY tmdbId, status ORDER BY n) AS island FROM s JOIN r USING (snapshot_id))
SELECT tmdbId, status, min(snapshot_id) AS first_snapshot, max(snapshot_id) AS last_snapshot FROM g GROUP BY tmdbId, status, island""",
    "p4_found": f"""
WITH v AS (
  SELECT snapshot_id, tmdbId, nextSeasonNumber AS a, upper({_STRIP.format('status')}) AS b, releaseDate AS c, releaseYear AS d, announcementDate AS e
  FROM official_series_data WHERE tmdbId IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, tmdbId ORDER BY lastChecked DESC NULLS LAST, deliveredAt DESC NULLS LAST, row_id DESC) = 1),
s AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS previous FROM (SELECT DISTINCT snapshot_id FROM official_series_data)),
n AS (SELECT s.snapshot_id AS at, v.* FROM v JOIN s USING (snapshot_id) WHERE previous IS NOT NULL),
p AS (SELECT s.snapshot_id AS at, v.* FROM v JOIN s ON s.previous = v.snapshot_id)
SELECT coalesce(n.at, p.at) AS snapshot_id, coalesce(n.tmdbId, p.tmdbId) AS tmdbId,
       CASE WHEN p.at IS NULL THEN 'added' WHEN n.at IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN p ON n.at = p.at AND n.tmdbId = p.tmdbId
WHERE p.at IS NULL OR n.at IS NULL OR (n.a, n.b, n.c, n.d, n.e) IS DISTINCT FROM (p.a, p.b, p.c, p.d, p.e)""",
    "p5_found": """
WITH c AS (
  SELECT DISTINCT coalesce(tmdbId, new.tmdbId, old.tmdbId) AS k, CAST(timestamp AS TIMESTAMPTZ) AS t,
         CAST(old AS VARCHAR) AS o, CAST(new AS VARCHAR) AS n,
         new.nextSeasonNumber AS nextSeasonNumber, new.status AS status, new.sourceUrl AS sourceUrl
  FROM changes WHERE old IS NOT NULL OR new IS NOT NULL),
top AS (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY k ORDER BY t DESC) = 1),
ends AS (
  SELECT * FROM top a
  WHERE (SELECT count(*) FROM top b WHERE b.k = a.k AND b.n IS NOT DISTINCT FROM a.n)
      > (SELECT count(*) FROM top b WHERE b.k = a.k AND b.o IS NOT DISTINCT FROM a.n))
SELECT k AS tmdbId, nextSeasonNumber, status, sourceUrl FROM ends
WHERE k IS NOT NULL AND n IS NOT NULL""",
}
