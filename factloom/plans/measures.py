"""Queries for measures, classifications, conflicts and constraints over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import metrics as M
from factloom.operators import validate as V
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ORDER = ("routing", "discovery", "fetch", "identity", "parser")


@query("""
SELECT route, count(*) AS cases, count(*) FILTER (WHERE s > 1) AS routed, count(*) FILTER (WHERE s > 2) AS discovered, count(*) FILTER (WHERE s > 3) AS fetched, count(*) FILTER (WHERE s > 4) AS identified, count(*) FILTER (WHERE s > 5) AS parsed,
  count(*) FILTER (WHERE s > 5 AND passed) AS covered, CASE WHEN count(*) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE s > 5 AND passed) / count(*), 2) END AS coverage_pct
FROM (SELECT *, CASE failureStage WHEN 'routing' THEN 1 WHEN 'discovery' THEN 2 WHEN 'fetch' THEN 3 WHEN 'identity' THEN 4 WHEN 'parser' THEN 5 ELSE 6 END AS s FROM hbo_production_evidence) GROUP BY route""")
def cumulative_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Counts of cases that passed each stage and all before it."""
    stage = F.coalesce(F.array_position(F.array(*map(F.lit, _ORDER)), F.col("failureStage")), F.lit(0))
    last = F.when(stage == 0, 6).otherwise(stage)
    names = ("routed", "discovered", "fetched", "identified", "parsed")
    counts = M.funnel({"cases": F.lit(True)} | {n: last > i for i, n in enumerate(names, 1)} | {"covered": F.col("passed")})
    rows = table(spark, d, "hbo_production_evidence").groupBy("route").agg(*counts)
    return rows.withColumn("coverage_pct", M.pct(F.col("covered"), F.col("cases")))


@query("""
SELECT route, string_agg(failureStage || '=' || n, ',' ORDER BY failureStage) AS breakdown FROM (SELECT route, failureStage, count(*) AS n FROM hbo_production_evidence WHERE failureStage IS NOT NULL GROUP BY ALL) GROUP BY route""")
def failure_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = M.breakdown(table(spark, d, "hbo_production_evidence"), "route", "failureStage")
    entries = F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("route", F.array_join(entries, ",").alias("breakdown"))


@query("""
SELECT route, count(*) FILTER (WHERE status = 'RENEWED') AS renewed, count(*) FILTER (WHERE status = 'RELEASE_DATE_CONFIRMED') AS release_date_confirmed, count(*) FILTER (WHERE status = 'FINAL_SEASON') AS final_season, count(*) FILTER (WHERE status = 'CANCELED') AS canceled FROM hbo_production_evidence GROUP BY route""")
def zero_filled_status(spark: SparkSession, d: str) -> DataFrame:
    return M.zero_filled(table(spark, d, "hbo_production_evidence"), "route", "status", ["RENEWED", "RELEASE_DATE_CONFIRMED", "FINAL_SEASON", "CANCELED"])


@query("""
WITH g AS (SELECT route, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM hbo_production_evidence GROUP BY route)
SELECT round_even(100.0 * sum(p) / sum(n), 2) AS weighted_pct, round_even(avg(100.0 * p / n), 2) AS macro_pct, count(*) AS groups FROM g""")
def weighted_and_macro_coverage(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "hbo_production_evidence").groupBy("route").agg(F.count("*").alias("n"), F.count_if("passed").alias("p"))
    return M.weighted_and_macro(groups, "p", "n")


@query("""
WITH dom AS (SELECT unnest(['routing', 'discovery', 'fetch', 'identity', 'parser', 'publication']) AS failureStage),
c AS (SELECT failureStage, count(*) AS n, string_agg(DISTINCT route, ',' ORDER BY route) AS affected FROM hbo_production_evidence WHERE failureStage IS NOT NULL GROUP BY 1)
SELECT failureStage, coalesce(n, 0) AS n, coalesce(affected, '') AS affected, round_even(100.0 * coalesce(n, 0) / sum(n) OVER (), 2) AS share_pct FROM dom LEFT JOIN c USING (failureStage)""")
def failure_share(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled failure classes with affected routes and share of all failures."""
    domain = spark.createDataFrame([(x,) for x in (*_ORDER, "publication")], "failureStage string")
    rows = table(spark, d, "hbo_production_evidence").where("failureStage is not null")
    return M.share_table(rows, "failureStage", "route", domain).withColumn("affected", F.array_join("affected", ","))


@query("""
WITH f AS (SELECT route, failureStage, count(*) AS n FROM hbo_production_evidence WHERE NOT passed GROUP BY ALL),
g AS (SELECT route, count(*) AS cases, count(*) FILTER (WHERE passed) AS covered FROM hbo_production_evidence GROUP BY route),
r AS (SELECT route, max(n) AS dominant_n, arg_max(failureStage, (n, failureStage)) AS dominant, sum(n) AS failures FROM f GROUP BY route)
SELECT g.route AS route, dominant, round_even((100.0 - 100.0 * covered / cases) * dominant_n / failures, 3) AS score, row_number() OVER (ORDER BY round_even((100.0 - 100.0 * covered / cases) * dominant_n / failures, 3) DESC, g.route) AS place FROM g JOIN r ON g.route = r.route""")
def gap_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Routes by coverage gap times the share of their dominant failure."""
    from pyspark.sql import Window

    e = table(spark, d, "hbo_production_evidence")
    counted = e.groupBy("route", F.when(~F.col("passed"), F.col("failureStage")).alias("stage")).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("covered")
    )
    failed = F.when(F.col("covered") == 0, F.col("n"))
    by_route = counted.groupBy("route").agg(
        F.sum("n").alias("cases"), F.sum("covered").alias("covered"), F.sum(failed).alias("failures"), F.max(failed).alias("dominant_n"),
        F.max_by("stage", F.when(F.col("covered") == 0, F.struct("n", "stage"))).alias("dominant"),
    ).where("failures > 0")
    score = F.bround((F.lit(100.0) - 100.0 * F.col("covered") / F.col("cases")) * F.col("dominant_n") / F.col("failures"), 3)
    ranked = by_route.withColumn("score", score)
    return ranked.select("route", "dominant", "score", F.row_number().over(Window.orderBy(F.desc("score"), "route")).cast("long").alias("place"))


@query("""
SELECT max_by(route, (n, route)) AS largest, min_by(route, (n, route)) AS smallest FROM (SELECT route, count(*) AS n FROM hbo_production_evidence GROUP BY route)""")
def extreme_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "hbo_production_evidence").groupBy("route").agg(F.count("*").alias("n"))
    return groups.agg(M.best_by("n", "route").alias("largest"), M.best_by("n", "route", False).alias("smallest"))


@query("""
SELECT route, count(DISTINCT tmdbId) AS series, count(DISTINCT sourceUrl) AS articles, coalesce(bool_and(passed), true) AS all_passed, coalesce(bool_or(passed), false) AS any_passed, count(DISTINCT tmdbId) >= 3 AND count(DISTINCT sourceUrl) >= 3 AND coalesce(bool_and(passed), true) AS qualified FROM hbo_production_evidence GROUP BY route""")
def distinct_thresholds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hbo_production_evidence").groupBy("route").agg(
        F.countDistinct("tmdbId").alias("series"), F.countDistinct("sourceUrl").alias("articles"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"), F.coalesce(F.bool_or("passed"), F.lit(False)).alias("any_passed"),
    )
    return rows.withColumn("qualified", (F.col("series") >= 3) & (F.col("articles") >= 3) & F.col("all_passed"))


@query("SELECT caseId, CASE WHEN count(DISTINCT announcementDate) = 1 THEN min(announcementDate) END AS announced, count(*) AS n FROM hbo_production_evidence GROUP BY caseId")
def exactly_one_date(spark: SparkSession, d: str) -> DataFrame:
    """The one date on which all rows of a case agree, else null."""
    return table(spark, d, "hbo_production_evidence").groupBy("caseId").agg(M.only_value(F.col("announcementDate")).alias("announced"), F.count("*").alias("n"))


@query("""
SELECT tmdbId, nextSeasonNumber, string_agg(DISTINCT CAST(releaseDate AS VARCHAR), ',' ORDER BY CAST(releaseDate AS VARCHAR)) AS dates FROM hbo_production_evidence WHERE tmdbId IS NOT NULL GROUP BY ALL HAVING count(DISTINCT releaseDate) > 1""")
def date_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hbo_production_evidence").where("tmdbId is not null")
    found = M.conflicts(rows, ["tmdbId", "nextSeasonNumber"], "releaseDate")
    return found.select("tmdbId", "nextSeasonNumber", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("dates"))


@query("""
SELECT row_id, CASE WHEN httpStatus IS NULL THEN 'TRANSPORT_ERROR' WHEN httpStatus IN (401, 403) THEN 'ACCESS_BLOCKED' WHEN httpStatus = 404 THEN 'NOT_FOUND' WHEN httpStatus = 429 OR httpStatus >= 500 THEN 'TRANSIENT' WHEN NOT coalesce(bodyExtractable, false) THEN 'UNREADABLE' ELSE 'ACCESSIBLE' END AS access FROM wbd_hbo_max_web_research""")
def access_classes(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("httpStatus")
    access = (
        F.when(status.isNull(), "TRANSPORT_ERROR").when(status.isin(401, 403), "ACCESS_BLOCKED").when(status == 404, "NOT_FOUND")
        .when((status == 429) | (status >= 500), "TRANSIENT").when(~F.coalesce("bodyExtractable", F.lit(False)), "UNREADABLE").otherwise("ACCESSIBLE")
    )
    return table(spark, d, "wbd_hbo_max_web_research").select("row_id", access.alias("access"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(min(l_extendedprice), 2) AS cheapest, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp'1999-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.min("l_extendedprice"), 2).alias("cheapest"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query("""
WITH x AS (SELECT row_id, tmdbId, nextSeasonNumber, upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS status, releaseDate, releaseYear, sourceUrl FROM official_series_data)
SELECT 'id' AS rule, row_id FROM x WHERE tmdbId IS NULL OR tmdbId <= 0
UNION ALL SELECT 'season', row_id FROM x WHERE nextSeasonNumber IS NULL OR nextSeasonNumber <= 0
UNION ALL SELECT 'status', row_id FROM x WHERE status IS NULL OR status NOT IN ('RENEWED', 'RELEASE_DATE_CONFIRMED', 'FINAL_SEASON', 'CANCELED')
UNION ALL SELECT 'year', row_id FROM x WHERE releaseDate IS NOT NULL AND releaseYear IS DISTINCT FROM year(releaseDate)
UNION ALL SELECT 'dated', row_id FROM x WHERE status = 'RELEASE_DATE_CONFIRMED' AND releaseDate IS NULL
UNION ALL SELECT 'url', row_id FROM x WHERE sourceUrl IS NULL OR NOT starts_with(sourceUrl, 'https://')""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows against the rules of a record; one row for each broken rule, none if all hold."""
    rows = table(spark, d, "official_series_data").withColumn("status", F.upper(F.regexp_replace("status", r"^\s+|\s+$", "")))
    return V.violations(rows, "row_id", V.RECORD_RULES)


@query("SELECT tmdbId, count(*) AS n FROM official_series_data WHERE tmdbId IS NOT NULL AND snapshot_id = (SELECT max(snapshot_id) FROM official_series_data) GROUP BY tmdbId HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "official_series_data").where("tmdbId is not null")
    latest = rows.agg(F.max("snapshot_id").alias("snapshot_id"))
    return V.duplicates(rows.join(latest, "snapshot_id", "left_semi"), ["tmdbId"])


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand) AS digest FROM part")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("digest"))
