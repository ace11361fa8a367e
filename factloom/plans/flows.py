"""Queries for folds, windows of time, walks, claims and resolution over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import spans
from factloom.functions.claims import extract_claims
from factloom.operators.graph import bounded_walk, index_crawl as crawl, linked_from, qualification_walk
from factloom.operators.resolve import reconcile
from factloom.session import shared_dir, table
from factloom.streaming import folds

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_E = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""
WITH RECURSIVE {_E},
r AS (SELECT user_id, event_id, n, true AS admitted, CAST(0 AS BIGINT) AS retry_after, [t] AS kept FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE CAST(greatest(1, ceil(live[1] + 86400 - t)) AS BIGINT) END, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x >= e.t - 86400) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, admitted, retry_after FROM r""")
def rate_limited_events(spark: SparkSession, d: str) -> DataFrame:
    """Admission of at most 3 events of a user in a day; only admitted ones count."""
    return folds.fold_columns(_events(spark, d).select("user_id", "event_id", "t"), "user_id", ["t", "event_id"], folds.rate_limit_columns(3, 86_400.0), "user_id long, event_id long, admitted boolean, retry_after long")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, t, n, t AS last, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, CASE WHEN e.t - r.last >= 86400 THEN e.t ELSE r.last END, e.t - r.last >= 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def cooled_down_events(spark: SparkSession, d: str) -> DataFrame:
    """Events at least a day after the last accepted one of their user."""
    return folds.fold_columns(_events(spark, d).select("user_id", "event_id", "t"), "user_id", ["t", "event_id"], folds.cool_down_columns(86_400.0), "user_id long, event_id long, accepted boolean")


@query(f"""
WITH RECURSIVE {_E},
r AS (SELECT user_id, event_id, n, true AS granted, 0.0::DOUBLE AS delay, [t] AS kept FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(live) < 2, CASE WHEN len(live) < 2 THEN 0.0 ELSE live[1] + 43200 + 1 - t END, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.t - 43200) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, granted, round(delay, 3) AS delay FROM r""")
def rolling_quota_events(spark: SparkSession, d: str) -> DataFrame:
    """At most 2 events of a user in 12 hours, the others with the delay they must wait."""
    told = folds.fold_columns(_events(spark, d).select("user_id", "event_id", "t"), "user_id", ["t", "event_id"], folds.rolling_quota_columns(2, 43_200.0), "user_id long, event_id long, granted boolean, delay double")
    return told.withColumn("delay", F.round("delay", 3))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_hour_counts(spark: SparkSession, d: str) -> DataFrame:
    return folds.tumbling_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS start, count(*) AS n FROM events, range(3) AS g(k) GROUP BY ALL")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return folds.sliding_counts(e, "ts", "3 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return folds.sessions(e, "user_id", "ts", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), edges AS (SELECT a AS source, b AS target FROM e UNION ALL SELECT b, a FROM e),
l0 AS (SELECT 'o0' AS node), l1 AS (SELECT DISTINCT target AS node FROM edges JOIN l0 ON source = l0.node), l2 AS (SELECT DISTINCT target AS node FROM edges JOIN l1 ON source = l1.node WHERE target NOT IN (SELECT node FROM l0 UNION ALL SELECT node FROM l1))
SELECT node, 0 AS depth FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def bounded_link_walk(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts within two steps of order 0."""
    shared_dir(spark)
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    edges = e.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(e.select(F.col("b").alias("source"), F.col("a").alias("target")))
    return bounded_walk(edges, spark.createDataFrame([("o0",)], "node string"), 2).select("node", "depth")


_EDGES = "edges AS (SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, 'line ' || l_linenumber AS anchor FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey, 'order' FROM lineitem)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("line "), "l_linenumber").alias("a"))
    return rows.select(F.col("o").alias("source"), F.col("p").alias("target"), F.col("a").alias("anchor")).unionByName(rows.select(F.col("p").alias("source"), F.col("o").alias("target"), F.lit("order").alias("anchor")))


@query(f"""
WITH {_EDGES}, seeds AS (SELECT DISTINCT 'o' || l_orderkey AS node FROM lineitem WHERE l_orderkey % 50 = 0), l1 AS (SELECT DISTINCT target AS node FROM edges JOIN seeds ON source = node)
SELECT node, 0 AS depth FROM seeds UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT DISTINCT target, 2 FROM edges JOIN l1 ON source = l1.node WHERE target NOT IN (SELECT node FROM seeds)""")
def growing_link_walk(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts within two steps of every fiftieth order: the seeds grow with the table."""
    shared_dir(spark)
    seeds = table(spark, d, "lineitem").where("l_orderkey % 50 = 0").select(F.concat(F.lit("o"), "l_orderkey").alias("node"))
    return bounded_walk(_links(spark, d), seeds, 2).select("node", "depth")


@query(f"""
WITH {_EDGES}, seeds AS (SELECT DISTINCT 'p' || l_partkey AS node FROM lineitem WHERE l_partkey % 50 = 0), i1 AS (SELECT DISTINCT target AS node FROM edges JOIN seeds ON source = node WHERE target LIKE 'o%'),
c AS (SELECT node, 0 AS depth FROM seeds UNION ALL SELECT node, 1 FROM i1), f AS (SELECT target, anchor, source, depth FROM edges JOIN c ON source = node WHERE target NOT LIKE 'o%' AND depth < 2)
SELECT target AS node, CAST(min(depth) + 1 AS INTEGER) AS depth, array_to_string(list_sort(list(DISTINCT anchor)), ' | ') AS anchors, count(DISTINCT source) AS indexes FROM f GROUP BY target""")
def index_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth part is an entry page, orders are index pages, parts articles; anchor texts are merged."""
    shared_dir(spark)
    entries = table(spark, d, "lineitem").where("l_partkey % 50 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("node"))
    return crawl(_links(spark, d), entries, 2, lambda t: F.startswith(t, F.lit("o")))


@query(f"""
WITH RECURSIVE {_EDGES}, adj AS (SELECT source, list(target ORDER BY target)[1:3] AS kids FROM (SELECT DISTINCT source, target FROM edges) GROUP BY source), seeds AS (SELECT DISTINCT 'o' || l_orderkey AS node FROM lineitem WHERE l_orderkey % 50 = 0),
r AS (SELECT node AS seed, 0 AS n, [node] AS ahead, [node] AS met, CAST([] AS VARCHAR[]) AS seen FROM seeds
  UNION ALL SELECT seed, n + 1, list_concat(fresh, ahead[2:]), list_concat(met, fresh), list_append(seen, ahead[1]) FROM (SELECT r.*, list_filter(coalesce(kids, []), lambda x: NOT list_contains(met, x)) AS fresh FROM r LEFT JOIN adj ON source = ahead[1] WHERE n < 5 AND len(ahead) > 0)),
w AS (SELECT seed, arg_max(seen, n) AS seen FROM r GROUP BY seed)
SELECT seed, CAST(generate_subscripts(seen, 1) - 1 AS INTEGER) AS place, unnest(seen) AS node FROM w""")
def qualification_walks(spark: SparkSession, d: str) -> DataFrame:
    """Depth-first walks of five pages from every fiftieth order."""
    shared_dir(spark)
    seeds = table(spark, d, "lineitem").where("l_orderkey % 50 = 0").select(F.concat(F.lit("o"), "l_orderkey").alias("node"))
    return qualification_walk(_links(spark, d), seeds, 5, 3)


@query(f"WITH {_EDGES} SELECT DISTINCT target AS node FROM edges WHERE source IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def linked_from_finished(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return linked_from(_links(spark, d), pages)


_L, _R = "(?:^|[^\\pL\\pN_])", "(?:$|[^\\pL\\pN_])"
_NUM = "one|first|two|second|three|third|four|fourth|five|fifth|six|sixth|seven|seventh|eight|eighth|nine|ninth|ten|tenth"
_NUMS = "['" + "','".join(_NUM.split("|")) + "']"
_MON = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_MESES = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query(f"""
WITH p AS (SELECT doc_id, publication_date AS p, regexp_split_to_array(text, '[\\n.!?]+') AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, p, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') AS ss FROM p),
s AS (SELECT doc_id, p, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS position, unnest(ss) AS s FROM q),
k AS (SELECT *, CASE WHEN regexp_matches(s, '(?i){_L}(final season|last season|letzte staffel|última temporada|posljednja sezona|dernière saison){_R}') THEN 'FINAL' WHEN regexp_matches(s, '(?i){_L}(cancel(?:s|ed|led)|cancela|annulée?|setzt .* ab|otkazana){_R}') THEN 'CANCELED'
  WHEN regexp_matches(s, '(?i){_L}(renew(?:s|ed)|renueva|renouvelle|a renouvelé|ha renovado|verlängert|je obnovio){_R}') THEN 'RENEWED' WHEN regexp_matches(s, '(?i){_L}(premieres|se estrena|startet am|arrivera le|počinje){_R}') THEN 'PREMIERE' END AS kind FROM s),
f AS (SELECT * FROM k WHERE kind IS NOT NULL AND NOT regexp_matches(s, '(?i){_L}(not|never|won''t|wouldn''t|isn''t|may|might|could|rumou?r(?:s|ed)?|reportedly|whether|no|kein(?:e|en)?|aún no|pas|nije){_R}')),
x AS (SELECT *, regexp_extract(lower(s), '{_L}season ([0-9]+|{_NUM}){_R}', 1) AS a, regexp_extract(lower(s), '{_L}([0-9]+|{_NUM})(?:st|nd|rd|th)? (?:and final )?season{_R}', 1) AS b,
  regexp_extract(s, '(?i){_L}({_MON})\\.? ([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,? ([0-9]{{4}}))?{_R}', ['m', 'd', 'y']) AS x, regexp_extract(s, '(?i){_L}([0-9]{{1,2}})(?:st|nd|rd|th)? ({_MON})\\.?(?:,? ([0-9]{{4}}))?{_R}', ['d', 'm', 'y']) AS z,
  regexp_extract(s, '(?i){_L}([0-9]{{1,2}}) de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre) de ([0-9]{{4}}){_R}', ['d', 'm', 'y']) AS e FROM f),
y AS (SELECT *, CASE WHEN x.m <> '' THEN x.m ELSE z.m END AS m, CASE WHEN x.m <> '' THEN x.d ELSE z.d END AS d, nullif(CASE WHEN x.m <> '' THEN x.y ELSE z.y END, '') AS yr FROM x),
w AS (SELECT *, '-' || lpad(CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(m[1:3])) AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS md FROM y)
SELECT doc_id, position, s AS sentence, kind, CAST(coalesce(try_cast(nullif(a, '') AS INTEGER), (nullif(list_position({_NUMS}, a), 0) + 1) // 2, try_cast(nullif(b, '') AS INTEGER), (nullif(list_position({_NUMS}, b), 0) + 1) // 2) AS INTEGER) AS season,
  coalesce(CASE WHEN m = '' THEN NULL WHEN yr IS NOT NULL THEN try_cast(yr || md AS DATE) WHEN try_cast(year(p) || md AS DATE) < p THEN try_cast((year(p) + 1) || md AS DATE) ELSE try_cast(year(p) || md AS DATE) END,
    try_cast(e.y || '-' || lpad(CAST(list_position({_MESES}, lower(e.m)) AS VARCHAR), 2, '0') || '-' || lpad(e.d, 2, '0') AS DATE)) AS day FROM w""")
def document_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims about seasons in all documents."""
    return extract_claims(table(spark, d, "documents"), "doc_id", "text", "publication_date")


@query()
def season_and_status_spans(spark: SparkSession, d: str) -> DataFrame:
    """Interval join on offsets: each status word in a snippet with the nearest season number within 85 characters."""
    e = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t")).where("t is not null")
    claims = spans.spans(F.col("t"), r"\b(?:renewed|cancel\w*|premieres|final season|returns?)\b")
    seasons = spans.spans(F.col("t"), r"\bseason \d+|\b\w+ season\b")
    found = e.select("row_id", "pos", "t", claims.alias("claims"), seasons.alias("seasons"))
    near = found.select("row_id", "pos", "t", F.explode(spans.pairs(F.col("claims"), F.col("seasons"), 85)).alias("x"))
    return near.select("row_id", "pos", F.col("x.claim.text").alias("claim"), F.col("x.reference.text").alias("season"), F.col("x.reference.gap").alias("gap"), spans.excerpt(F.col("t"), F.col("x.claim"), F.col("x.reference")).alias("excerpt"))


@query("""
WITH s AS (SELECT row_id, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos, unnest(relevantEvidenceSnippet) AS t FROM hbo_production_evidence),
a AS (SELECT row_id, pos, t, unnest(list_filter(generate_series(0, length(t) - 1), lambda i: lower(substr(t, i + 1, 7)) = 'renewed')) AS c, list_filter(generate_series(0, length(t) - 1), lambda i: lower(substr(t, i + 1, 6)) = 'season') AS r FROM s WHERE t IS NOT NULL),
g AS (SELECT row_id, pos, t, c, list_min(list_filter(list_transform(r, lambda x: {'gap': greatest(0, c - (x + 6), x - (c + 7)), 'start': x}), lambda y: y.gap <= 85)) AS m FROM a),
e AS (SELECT *, least(c, m.start) AS lo, greatest(c + 7, m.start + 6) AS hi FROM g WHERE m IS NOT NULL), w AS (SELECT *, greatest(0, CAST(floor((200 - (hi - lo)) / 2.0) AS BIGINT)) AS room FROM e)
SELECT row_id, pos, CAST(c AS INTEGER) AS claim_at, CAST(m.gap AS INTEGER) AS gap, trim(substr(t, greatest(0, lo - room) + 1, least(200, hi + room - greatest(0, lo - room)))) AS excerpt FROM w""")
def renewals_near_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Each "renewed" with the nearest "season" within 85 characters, and the excerpt around both."""
    e = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t")).where("t is not null")
    found = e.select("row_id", "pos", "t", spans.spans(F.col("t"), "renewed").alias("claims"), spans.spans(F.col("t"), "season").alias("seasons"))
    near = found.select("row_id", "pos", "t", F.explode(spans.pairs(F.col("claims"), F.col("seasons"), 85)).alias("x"))
    return near.select("row_id", "pos", F.col("x.claim.start").alias("claim_at"), F.col("x.reference.gap").alias("gap"), spans.excerpt(F.col("t"), F.col("x.claim"), F.col("x.reference")).alias("excerpt"))


@query("""
WITH c AS (SELECT tmdbId, nextSeasonNumber AS g, status, releaseDate, row_id, CASE status WHEN 'CANCELED' THEN 4 WHEN 'FINAL_SEASON' THEN 3 WHEN 'RENEWED' THEN 1 ELSE 0 END AS w FROM hbo_production_evidence WHERE tmdbId IS NOT NULL),
t AS (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY tmdbId ORDER BY coalesce(g, -1) DESC) = 1)
SELECT tmdbId, min(g) AS generation, arg_max_null(status, (w, row_id)) AS kind, CASE WHEN min(releaseDate) = max(releaseDate) THEN min(releaseDate) END AS value, coalesce(min(releaseDate) <> max(releaseDate), false) AS conflict, count(*) AS n_claims FROM t GROUP BY tmdbId""")
def reconciled_series(spark: SparkSession, d: str) -> DataFrame:
    """Strongest status, date and conflicts of each series' latest season."""
    e = table(spark, d, "hbo_production_evidence")
    return reconcile(e, "tmdbId", "nextSeasonNumber", "status", "releaseDate", {"CANCELED": 4, "FINAL_SEASON": 3, "RENEWED": 1}, ["row_id"])
