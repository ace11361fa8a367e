"""Queries for the smaller shapes: tabs, rankings per group, attempts, scopes, fixed buckets, key sets, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.operators import joins as J
from factloom.operators import metrics as M
from factloom.operators import ordering as O
from factloom.operators import validate as V
from factloom.operators.history import strip_outer
from factloom.plans import data_ops
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LATEST = "SELECT * FROM official_series_data WHERE tmdbId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY snapshot_id DESC, lastChecked DESC NULLS LAST, row_id DESC) = 1"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "official_series_data").where("tmdbId is not null")
    return O.strongest(rows, "tmdbId", [F.col("snapshot_id"), F.col("lastChecked"), F.col("row_id")])


@query(f"""
WITH o AS ({_LATEST}), m AS (SELECT s.tmdbId AS tmdbId, o.tmdbId AS known, upper(regexp_replace(o.status, '^\\s+|\\s+$', '', 'g')) AS status, o.releaseDate AS releaseDate FROM series_metadata s LEFT JOIN o USING (tmdbId))
SELECT 'ALL' AS tab, tmdbId FROM m UNION ALL SELECT 'UPCOMING', tmdbId FROM m WHERE releaseDate > DATE '2026-08-01' UNION ALL SELECT 'RENEWED', tmdbId FROM m WHERE status IN ('RENEWED', 'RELEASE_DATE_CONFIRMED')
UNION ALL SELECT 'WAITING', tmdbId FROM m WHERE known IS NULL UNION ALL SELECT 'ENDING', tmdbId FROM m WHERE status = 'FINAL_SEASON' UNION ALL SELECT 'UNDATED', tmdbId FROM m WHERE releaseDate IS NULL AND status IN ('RENEWED', 'FINAL_SEASON')""")
def watch_tabs(spark: SparkSession, d: str) -> DataFrame:
    """The tabs under which each series is shown; one pass, a series may be in several."""
    latest = _latest(spark, d).select(F.col("tmdbId").alias("known"), F.upper(strip_outer(F.col("status"))).alias("status"), "releaseDate")
    m = table(spark, d, "series_metadata").select("tmdbId").join(latest, F.col("tmdbId") == F.col("known"), "left")
    tabs = {
        "ALL": F.lit(True), "UPCOMING": F.col("releaseDate") > F.lit("2026-08-01").cast("date"), "RENEWED": F.col("status").isin("RENEWED", "RELEASE_DATE_CONFIRMED"),
        "WAITING": F.col("known").isNull(), "ENDING": F.col("status") == "FINAL_SEASON", "UNDATED": F.col("releaseDate").isNull() & F.col("status").isin("RENEWED", "FINAL_SEASON"),
    }
    return m.select(F.explode(F.array_compact(F.array(*[F.when(cond, name) for name, cond in tabs.items()]))).alias("tab"), "tmdbId")


@query(f"""
SELECT strftime(releaseDate, '%Y-%m') AS month, tmdbId, row_number() OVER (PARTITION BY strftime(releaseDate, '%Y-%m') ORDER BY releaseDate, tmdbId) AS place FROM ({_LATEST}) WHERE releaseDate > DATE '2026-08-01'""")
def upcoming_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Upcoming series of each month in order of date."""
    later = _latest(spark, d).where("releaseDate > date'2026-08-01'").withColumn("month", F.date_format("releaseDate", "yyyy-MM"))
    place = F.row_number().over(Window.partitionBy("month").orderBy("releaseDate", "tmdbId"))
    return later.select("month", "tmdbId", place.cast("long").alias("place"))


@query("""
SELECT event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events)
WHERE place <= CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 ELSE 0 END""")
def due_per_phase(spark: SparkSession, d: str) -> DataFrame:
    """The first three purchases and the first two views: another limit for each group."""
    e = table(spark, d, "events")
    top = O.top_per_group(e, "event_type", [F.col("ts"), F.col("event_id")], {"purchase": 3, "view": 2})
    return top.select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT route, row_id, place, n AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY passed DESC NULLS LAST, nextSeasonNumber DESC NULLS LAST, sourceUrl NULLS LAST, row_id) AS place, count(*) OVER (PARTITION BY route) AS n FROM hbo_production_evidence) WHERE place <= 8""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each route's eight best candidates with the number of all; the count is an aggregate of its own, so the limit works before the shuffle."""
    e = table(spark, d, "hbo_production_evidence")
    order = [F.desc_nulls_last("passed"), F.desc_nulls_last("nextSeasonNumber"), F.asc_nulls_last("sourceUrl"), F.col("row_id")]
    counts = e.groupBy(F.col("route").alias("r")).agg(F.count("*").alias("candidates"))
    top = O.top_per_group(e, "route", order, 8)
    return top.join(counts, F.col("route").eqNullSafe(F.col("r"))).select("route", "row_id", F.col("place").cast("long").alias("place"), "candidates")


@query("""
SELECT tmdbId, count(*) AS summaries, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM (SELECT DISTINCT tmdbId, to_json({'season': nextSeasonNumber, 'status': status, 'url': sourceUrl}) AS s FROM hbo_production_evidence WHERE tmdbId IS NOT NULL) GROUP BY tmdbId""")
def distinct_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Distinct summaries of each series by their canonical JSON, in order; repeats go before they are brought together."""
    e = table(spark, d, "hbo_production_evidence").where("tmdbId is not null")
    summary = F.to_json(F.struct(F.col("nextSeasonNumber").alias("season"), "status", F.col("sourceUrl").alias("url")), {"ignoreNullFields": "false"})
    distinct = e.select("tmdbId", summary.alias("s")).distinct()
    return distinct.groupBy("tmdbId").agg(F.count("*").alias("summaries"), F.md5(F.array_join(F.array_sort(F.collect_list("s")), "\n")).alias("digest"))


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ordinal FROM s WHERE contains(lower(line), 'season')""")
def running_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document that speak of a season, numbered as they come; a group is one document."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    hits = lines.where(F.contains(F.lower("line"), F.lit("season")))
    return hits.select("doc_id", "position", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")).cast("long").alias("ordinal"))


@query("""
SELECT caseId, row_id, passed FROM hbo_production_evidence WHERE caseId IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY caseId ORDER BY passed DESC NULLS LAST, len(coalesce(relevantEvidenceSnippet, [])) > 0 DESC, observedAt, row_id) = 1""")
def chosen_attempt(spark: SparkSession, d: str) -> DataFrame:
    """Each case's first attempt, unless a later one passes or has content where the first has none."""
    e = table(spark, d, "hbo_production_evidence").where("caseId is not null")
    has = F.coalesce(F.size("relevantEvidenceSnippet") > 0, F.lit(False))
    order = [F.coalesce(F.col("passed").cast("int"), F.lit(-1)), has, -F.unix_micros("observedAt"), -F.col("row_id")]
    return O.strongest(e.select("caseId", "row_id", "passed", "relevantEvidenceSnippet", "observedAt"), "caseId", order).select("caseId", "row_id", "passed")


_MERGE_KEYS = "nextSeasonNumber DESC, CASE status WHEN 'CANCELED' THEN 4 WHEN 'FINAL_SEASON' THEN 3 WHEN 'RENEWED' THEN 1 ELSE 0 END DESC, releaseDate IS NOT NULL DESC, coalesce(strftime(announcementDate, '%Y-%m-%d'), '') DESC, row_id"


@query(f"SELECT tmdbId, row_id, place FROM (SELECT *, row_number() OVER (PARTITION BY tmdbId ORDER BY {_MERGE_KEYS}) AS place FROM hbo_production_evidence WHERE tmdbId IS NOT NULL AND nextSeasonNumber IS NOT NULL AND status IS NOT NULL) WHERE place <= 5")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    """The first five facts of each series in the stable order in which they are merged: ties keep the order they came in."""
    e = table(spark, d, "hbo_production_evidence").where("tmdbId is not null and nextSeasonNumber is not null and status is not null")
    weight = F.when(F.col("status") == "CANCELED", 4).when(F.col("status") == "FINAL_SEASON", 3).when(F.col("status") == "RENEWED", 1).otherwise(0)
    order = [F.desc("nextSeasonNumber"), weight.desc(), F.col("releaseDate").isNotNull().desc(), F.coalesce(F.date_format("announcementDate", "yyyy-MM-dd"), F.lit("")).desc(), F.col("row_id")]
    return O.top_per_group(e, "tmdbId", order, 5).select("tmdbId", "row_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT tmdbId, string_agg(coalesce(CAST(nextSeasonNumber AS VARCHAR), '-') || ' ' || coalesce(status, '-') || ' ' || coalesce(sourceUrl, '-'), chr(10) ORDER BY place) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY tmdbId ORDER BY nextSeasonNumber NULLS LAST, status NULLS LAST, sourceUrl NULLS LAST, row_id) AS place FROM hbo_production_evidence WHERE tmdbId IS NOT NULL) WHERE place <= 5 GROUP BY tmdbId""")
def sorted_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each series' first five pieces of evidence in order of season, status and URL, as one text."""
    e = table(spark, d, "hbo_production_evidence").where("tmdbId is not null")
    order = [F.asc_nulls_last("nextSeasonNumber"), F.asc_nulls_last("status"), F.asc_nulls_last("sourceUrl"), F.col("row_id")]
    line = F.concat_ws(" ", F.coalesce(F.col("nextSeasonNumber").cast("string"), F.lit("-")), F.coalesce("status", F.lit("-")), F.coalesce("sourceUrl", F.lit("-")))
    top = O.top_per_group(e, "tmdbId", order, 5).select("tmdbId", F.struct("place", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return top.groupBy("tmdbId").agg(F.array_join(lines, "\n").alias("evidence"))


@query("""
SELECT event_id, list_sort(json_keys(props)) = ['k'] AS exact, len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'v'))) AS extra FROM events""")
def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether a JSON object has exactly the expected keys, and how many it may not have."""
    keys = F.array_sort(F.json_object_keys("props"))
    return table(spark, d, "events").select("event_id", (keys == F.array(F.lit("k"))).alias("exact"), F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("v")))).cast("long").alias("extra"))


@query("""
SELECT row_id, array_to_string(list_sort(list_intersect(list_transform(rawNetworkLabels, lambda x: lower(x)), ['lumora', 'kestral', 'orbeza'])), '|') AS shared FROM hbo_production_evidence WHERE list_has_any(list_transform(rawNetworkLabels, lambda x: lower(x)), ['lumora', 'kestral', 'orbeza'])""")
def label_intersection(spark: SparkSession, d: str) -> DataFrame:
    wanted, labels = F.array(*map(F.lit, ("lumora", "kestral", "orbeza"))), F.transform("rawNetworkLabels", F.lower)
    rows = table(spark, d, "hbo_production_evidence").where(F.arrays_overlap(labels, wanted))
    return rows.select("row_id", F.array_join(F.array_sort(F.array_intersect(labels, wanted)), "|").alias("shared"))


_WORDS = "['one','two','three','four','five','six','seven','eight','nine','ten']"
_ORDINALS = "['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth']"


@query(f"""
WITH s AS (SELECT row_id, unnest(relevantEvidenceSnippet) AS t, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos FROM hbo_production_evidence),
w AS (SELECT row_id, pos, regexp_extract(lower(t), '\\b([a-z]+) season\\b', 1) AS w FROM s)
SELECT row_id, pos, w AS word, CAST(CASE WHEN list_contains({_WORDS}, w) THEN list_position({_WORDS}, w) ELSE list_position({_ORDINALS}, w) END AS INTEGER) AS season FROM w WHERE list_contains({_WORDS}, w) OR list_contains({_ORDINALS}, w)""")
def season_words(spark: SparkSession, d: str) -> DataFrame:
    """Season numbers written as words, by the union of two maps: cardinals and ordinals."""
    s = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t"))
    word = s.select("row_id", "pos", F.regexp_extract(F.lower("t"), r"\b([a-z]+) season\b", 1).alias("word"))
    both = F.map_concat(X.CARDINAL_MAP(), X.ORDINAL_MAP())
    return word.select("row_id", "pos", "word", F.try_element_at(both, F.col("word")).alias("season")).where("season is not null")


@query("""
WITH e AS (SELECT route, passed, observedAt, unnest(CASE WHEN observedAt >= TIMESTAMPTZ '2026-05-01 00:00:00+00' THEN ['ALL', 'RECENT'] ELSE ['ALL'] END) AS scope FROM hbo_production_evidence)
SELECT scope, route, count(*) AS cases, count(*) FILTER (WHERE passed) AS covered, round_even(100.0 * count(*) FILTER (WHERE passed) / count(*), 2) AS pct FROM e GROUP BY ALL""")
def two_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The same measure in two scopes, in one pass."""
    recent = F.col("observedAt") >= F.lit("2026-05-01 00:00:00").cast("timestamp")
    scopes = F.when(recent, F.array(F.lit("ALL"), F.lit("RECENT"))).otherwise(F.array(F.lit("ALL")))
    e = table(spark, d, "hbo_production_evidence").select("route", "passed", F.explode(scopes).alias("scope"))
    rows = e.groupBy("scope", "route").agg(F.count("*").alias("cases"), F.count_if("passed").alias("covered"))
    return rows.withColumn("pct", M.pct(F.col("covered"), F.col("cases")))


@query("""
SELECT s.tmdbId AS tmdbId, coalesce(bool_or(passed), false) AS any_passed, coalesce(bool_and(passed), true) AS all_passed FROM series_metadata s LEFT JOIN hbo_production_evidence e ON e.tmdbId = s.tmdbId GROUP BY s.tmdbId""")
def any_and_all(spark: SparkSession, d: str) -> DataFrame:
    """Over nothing, any is false and all is true; the facts are reduced before the join."""
    told = table(spark, d, "hbo_production_evidence").where("tmdbId is not null").groupBy(F.col("tmdbId").alias("t")).agg(F.bool_or("passed").alias("a"), F.bool_and("passed").alias("b"))
    s = table(spark, d, "series_metadata").select("tmdbId").join(told, F.col("tmdbId") == F.col("t"), "left")
    return s.select("tmdbId", F.coalesce("a", F.lit(False)).alias("any_passed"), F.coalesce("b", F.lit(True)).alias("all_passed"))


@query("""
WITH b AS (SELECT unnest(['CANCELED', 'FINAL_SEASON', 'RELEASE_DATE_CONFIRMED', 'RENEWED', 'UNKNOWN']) AS bucket)
SELECT bucket, coalesce(string_agg(DISTINCT route, ',' ORDER BY route), '') AS routes FROM b LEFT JOIN hbo_production_evidence e ON coalesce(e.status, 'UNKNOWN') = bucket GROUP BY bucket""")
def bucket_lists(spark: SparkSession, d: str) -> DataFrame:
    """Routes of each of the fixed buckets, sorted; empty buckets too."""
    buckets = spark.createDataFrame([(x,) for x in (*V.STATUSES, "UNKNOWN")], "bucket string")
    pairs = table(spark, d, "hbo_production_evidence").select(F.coalesce("status", F.lit("UNKNOWN")).alias("b"), "route").distinct()
    lists = pairs.groupBy("b").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))
    return buckets.join(lists, F.col("bucket") == F.col("b"), "left").select("bucket", F.coalesce("routes", F.lit("")).alias("routes"))


@query("""
SELECT route, count(*) AS cases, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'hr', 'xx'], lambda x: NOT list_contains(coalesce(list(DISTINCT language) FILTER (WHERE language IS NOT NULL), []), x))), ',') AS gaps FROM hbo_production_evidence GROUP BY route""")
def category_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each route and the languages of a fixed list that it has none in."""
    domain = F.array(*map(F.lit, ("de", "en", "es", "fr", "hr", "xx")))
    rows = table(spark, d, "hbo_production_evidence").groupBy("route").agg(F.count("*").alias("cases"), F.collect_set("language").alias("had"))
    return rows.select("route", "cases", F.array_join(F.array_sort(F.array_except(domain, "had")), ",").alias("gaps"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) - 86400000000 FROM events))
SELECT user_id, count(*) AS n, min(t) AS first_at FROM e GROUP BY user_id UNION ALL SELECT NULL, count(*), min(t) FROM e""")
def window_charges(spark: SparkSession, d: str) -> DataFrame:
    """Count and earliest of the last day, for each key and (key null) over all, in one aggregation."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    last = F.broadcast(e.agg((F.max("t") - 86_400_000_000).alias("since")))
    return e.join(last, F.col("t") >= F.col("since")).groupingSets([["user_id"], []], "user_id").agg(F.count("*").alias("n"), F.min("t").alias("first_at"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), 'season ([0-9]{1,4})', 1), lambda x: CAST(x AS INTEGER)))), ',') AS seasons FROM documents WHERE regexp_matches(lower(text), 'season [0-9]')""")
def season_numbers_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.lower("text").rlike("season [0-9]"))
    found = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("season ([0-9]{1,4})")), lambda x: x.cast("int"))
    return rows.select("doc_id", F.array_join(F.transform(F.array_sort(F.array_distinct(found)), lambda x: x.cast("string")), ",").alias("seasons"))


@query(f"SELECT snapshot_id, count(*) AS changes, count(*) > 4 AS blocked FROM ({data_ops.ORACLES['p4_found']}) GROUP BY snapshot_id")
def mass_change_guard(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each snapshot; more than four block its publication."""
    return V.mass_change(data_ops.p4_found(spark, d), "snapshot_id", 4)


@query("""
SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[\\n.!?;]+'), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '')) AS clauses FROM documents WHERE text IS NOT NULL""")
def clause_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clauses as Spanish texts are split: semicolons end one too."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"), X.SPANISH_ENDS)).cast("long").alias("clauses"))


@query("""
SELECT row_id, trim(regexp_replace(lower(replace(replace(replace(replace(translate(requestedTitle, '–—‐‑−ªº' || chr(160), '-----ao '), '®', ''), '™', ''), '’', ''''), '‘', '''')), '\\s+', ' ', 'g')) AS t FROM hbo_production_evidence""")
def spanish_titles(spark: SparkSession, d: str) -> DataFrame:
    """Dashes, ordinal marks, hard blanks and trade marks put right; accents stay."""
    return table(spark, d, "hbo_production_evidence").select("row_id", X.spanish_plain(F.col("requestedTitle")).alias("t"))


@query("""
WITH s AS (SELECT row_id, unnest(relevantEvidenceSnippet) AS t, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos FROM hbo_production_evidence)
SELECT row_id, pos, concat_ws('|', CASE WHEN regexp_matches(lower(t), 'renew|renueva|verlängert|renouvel|obnov') THEN 'renewal' END, CASE WHEN regexp_matches(lower(t), 'cancel|annul|otkaz|setzt .* ab') THEN 'cancellation' END,
  CASE WHEN regexp_matches(lower(t), 'final|última|letzte|dernière|posljednja') THEN 'final' END, CASE WHEN regexp_matches(t, '[0-9]{1,2}\\.? (de )?[A-Za-z]+') THEN 'date' END, CASE WHEN regexp_matches(t, '20[0-9][0-9]') THEN 'year' END) AS flags FROM s WHERE t IS NOT NULL""")
def signal_flags(spark: SparkSession, d: str) -> DataFrame:
    """What a snippet may tell, as a list of flags."""
    s = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t")).where("t is not null")
    return s.select("row_id", "pos", F.array_join(X.signals(F.col("t")), "|").alias("flags"))


@query("""
WITH u AS (SELECT row_id, pos, url, regexp_extract(url, '^(https?)://', 1) AS s, lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM
  (SELECT row_id, 0 AS pos, url FROM wbd_hbo_max_web_research UNION ALL SELECT row_id, 1, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&b=2&a=%7E' || row_id % 7 || '&fbclid=1#top' FROM wbd_hbo_max_web_research) WHERE url IS NOT NULL)
SELECT row_id, CAST(pos AS INTEGER) AS pos, s || '://' || h || regexp_replace(p, '/+$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS url FROM
  (SELECT *, list_filter(string_split(replace(q, '%7E', '~'), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^(utm_[a-z_]*|fbclid|gclid|mc_cid|mc_eid)$')) AS k FROM u)""")
def canonical_queries(spark: SparkSession, d: str) -> DataFrame:
    """URLs in one form: escapes decoded, parameters sorted, tracking ones dropped; the given ones and ones with tracking added."""
    w = table(spark, d, "wbd_hbo_max_web_research").where("url is not null").select("row_id", "url")
    more = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&b=2&a=%7E"), (F.col("row_id") % 7).cast("string"), F.lit("&fbclid=1#top"))
    both = w.select("row_id", F.posexplode(F.array("url", more)).alias("pos", "url"))
    return both.select("row_id", "pos", U.normal_canonical(F.col("url")).alias("url"))


@query("""
WITH u AS (SELECT row_id, url, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM wbd_hbo_max_web_research WHERE url IS NOT NULL),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '') AS ps FROM u)
SELECT row_id, CASE WHEN NOT regexp_matches(lower(url), '%2f|%5c|/\\.\\.(/|$|\\?)') AND len(list_filter(ps, lambda x: NOT regexp_matches(x, '^(language=[a-z]{2}|page=[1-9][0-9]{0,2})$'))) = 0 THEN
  regexp_extract(url, '^https?://', 0) || lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_sort(ps), '&') ELSE '' END END AS listing FROM k""")
def listing_urls(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages: only known parameters within bounds, no hidden path steps; null for all others."""
    w = table(spark, d, "wbd_hbo_max_web_research").where("url is not null")
    return w.select("row_id", U.listing(F.col("url"), {"language": "[a-z]{2}", "page": "[1-9][0-9]{0,2}"}).alias("listing"))


@query("SELECT row_id, list_contains(string_split_regex(lower(regexp_extract(sourceUrl, '^https?://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]+'), CAST(nextSeasonNumber AS VARCHAR)) AS named FROM hbo_production_evidence WHERE sourceUrl IS NOT NULL AND nextSeasonNumber IS NOT NULL")
def id_in_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether a number is a token of its own in a URL's path."""
    e = table(spark, d, "hbo_production_evidence").where("sourceUrl is not null and nextSeasonNumber is not null")
    return e.select("row_id", F.array_contains(U.path_tokens(F.col("sourceUrl")), F.col("nextSeasonNumber").cast("string")).alias("named"))


@query("""
WITH s AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CAST(regexp_extract(t, '\\b(?:premieres|returns|debuts|arrives|streams) in (20[0-9]{2})\\b', 1) AS INTEGER) AS year FROM s WHERE regexp_matches(t, '\\b(?:premieres|returns|debuts|arrives|streams) in (20[0-9]{2})\\b')""")
def premiere_years(spark: SparkSession, d: str) -> DataFrame:
    """First year without a day that a text gives for a premiere."""
    return table(spark, d, "documents").select("doc_id", D.premiere_year(F.col("text")).alias("year")).where("year is not null")


_EN = "['january','february','march','april','may','june','july','august','september','october','november','december']"


@query(f"""
WITH m AS (SELECT doc_id, regexp_extract(text, '\\b(January|February|March|April|May|June|July|August|September|October|November|December) ([0-9]{{1,2}}), ([0-9]{{4}})\\b', ['m', 'd', 'y']) AS g FROM documents WHERE text IS NOT NULL)
SELECT doc_id, try_cast(g.y || '-' || lpad(CAST(list_position({_EN}, lower(g.m)) AS VARCHAR), 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) AS day FROM m WHERE g.m <> ''""")
def first_full_dates(spark: SparkSession, d: str) -> DataFrame:
    """First "Month D, YYYY" anywhere in a text; null for a day that doesn't exist."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", D.first_full_date(F.col("text")).alias("x")).where("x.found").select("doc_id", "x.day")


_ES = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query(f"""
WITH s AS (SELECT row_id, unnest(relevantEvidenceSnippet) AS t, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos, CAST(observedAt AS DATE) AS seen FROM hbo_production_evidence),
m AS (SELECT *, regexp_extract(lower(t), '\\b([0-9]{{1,2}}) de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?: de ([0-9]{{4}}))?\\b', ['d', 'm', 'y']) AS g FROM s),
c AS (SELECT *, try_cast(coalesce(nullif(g.y, ''), strftime(seen, '%Y')) || '-' || lpad(CAST(list_position({_ES}, g.m) AS VARCHAR), 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) AS day FROM m WHERE g.m <> '')
SELECT row_id, pos, CASE WHEN g.y <> '' OR day - seen BETWEEN 0 AND 183 THEN day END AS day FROM c""")
def spanish_dates_near(spark: SparkSession, d: str) -> DataFrame:
    """Spanish dates; one without year counts if it is at most half a year after the observation, in the same year."""
    e = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t"), F.col("observedAt").cast("date").alias("seen"))
    return e.select("row_id", "pos", D.spanish_date_near(F.col("t"), F.col("seen")).alias("x")).where("x.found").select("row_id", "pos", "x.day")


@query("SELECT row_id, announcementDate BETWEEN DATE '1900-01-01' AND CAST(observedAt AS DATE) AS plausible FROM hbo_production_evidence WHERE announcementDate IS NOT NULL AND observedAt IS NOT NULL")
def plausible_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hbo_production_evidence").where("announcementDate is not null and observedAt is not null")
    return e.select("row_id", D.plausible(F.col("announcementDate"), F.col("observedAt").cast("date")).alias("plausible"))


@query("SELECT e.row_id AS row_id, s.provider AS provider, s.title AS registered FROM hbo_production_evidence e JOIN sources s ON s.tmdbId = e.tmdbId")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Facts with their registry entry."""
    found = J.look_up(table(spark, d, "hbo_production_evidence"), F.col("tmdbId"), table(spark, d, "sources"), "tmdbId", "s_")
    return found.where("s_tmdbId is not null").select("row_id", F.col("s_provider").alias("provider"), F.col("s_title").alias("registered"))


_W = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'of', 'for', 'with')))"


@query(f"""
WITH a AS (SELECT DISTINCT tmdbId, x AS alias, {_W.format('x')} AS w FROM (SELECT tmdbId, unnest(aliases) AS x FROM sources) WHERE regexp_matches(x, '^[ -~]*$')), t AS (SELECT id, {_W.format('title')} AS w FROM series_metadata WHERE regexp_matches(title, '^[ -~]*$')),
p AS (SELECT tmdbId, alias, id, len(list_intersect(a.w, t.w)) AS shared, len(a.w) AS n FROM a JOIN t ON list_has_any(a.w, t.w))
SELECT tmdbId, alias, id, CASE WHEN shared = n THEN 3 WHEN shared >= greatest(1, (n + 1) // 2) THEN 2 ELSE 1 END AS score FROM p""")
def alias_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Registered aliases against titles by shared words: a join on the words, then counts for each pair."""
    plain = r"^[\x20-\x7e]*$"
    aliases = table(spark, d, "sources").select("tmdbId", F.explode("aliases").alias("alias")).where(F.col("alias").rlike(plain)).distinct()
    titles = table(spark, d, "series_metadata").select("id", "title").where(F.col("title").rlike(plain))
    return J.shared_words(aliases, ["tmdbId", "alias"], X.words(F.col("alias")), titles, ["id"], X.words(F.col("title"))).select("tmdbId", "alias", "id", "score")


@query("""
WITH c AS (SELECT caseId, arg_min(passed, (observedAt, row_id)) AS before, arg_max(passed, (observedAt, row_id)) AS after FROM hbo_production_evidence WHERE caseId IS NOT NULL AND passed IS NOT NULL AND observedAt IS NOT NULL GROUP BY caseId)
SELECT CASE WHEN before AND after THEN 'kept' WHEN after THEN 'gained' WHEN before THEN 'lost' ELSE 'missing' END AS outcome, count(*) AS cases FROM c GROUP BY 1""")
def first_against_last(spark: SparkSession, d: str) -> DataFrame:
    """A/B comparison of each case's first and last run; a case with very many rows is combined map-side."""
    e = table(spark, d, "hbo_production_evidence").where("caseId is not null and passed is not null and observedAt is not null")
    at = F.struct("observedAt", "row_id")
    c = e.groupBy("caseId").agg(F.min_by("passed", at).alias("before"), F.max_by("passed", at).alias("after"))
    outcome = F.when(F.col("before") & F.col("after"), "kept").when(F.col("after"), "gained").when(F.col("before"), "lost").otherwise("missing")
    return c.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("cases"))


@query("""
WITH f AS (SELECT row_id, ' ' || trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, trim(regexp_replace(lower(requestedTitle), '[^a-z0-9]+', ' ', 'g')) AS a FROM (SELECT row_id, requestedTitle, coalesce(array_to_string(relevantEvidenceSnippet, ' . '), '') AS t FROM hbo_production_evidence WHERE relevantEvidenceSnippet IS NOT NULL AND regexp_matches(requestedTitle, '^[ -~]+$'))
WHERE regexp_matches(t, '^[ -~]*$'))
SELECT row_id, (length(t) - length(replace(t, ' ' || a || ' ', ''))) / (length(a) + 2) > (length(t) - length(replace(t, ' the ' || a || ' ', ''))) / (length(a) + 6) AS named FROM f WHERE a <> ''""")
def title_named_without_article(spark: SparkSession, d: str) -> DataFrame:
    """Whether a snippet names its series by word, at least once without a "the" before it that isn't part of the name."""
    t = F.array_join("relevantEvidenceSnippet", " . ")
    e = table(spark, d, "hbo_production_evidence").where("relevantEvidenceSnippet is not null").where(F.col("requestedTitle").rlike(r"^[\x20-\x7e]+$"))
    rows = e.select("row_id", t.alias("t"), "requestedTitle").where(F.col("t").rlike(r"^[\x20-\x7e]*$")).where(X.folded(F.col("requestedTitle")) != "")
    return rows.select("row_id", X.named_alone(F.col("t"), F.col("requestedTitle")).alias("named"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events WHERE event_type <> 'purchase' OR epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-30 00:00:00') - 7 * 86400000000")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """Completed entries (purchases) go after seven days, the end of which stays; pending ones never do."""
    from factloom.streaming.folds import expire

    e = table(spark, d, "events").withColumn("when", F.col("ts").cast("timestamp"))
    return expire(e, "when", "2024-01-30 00:00:00", 7 * 86_400, F.col("event_type") != "purchase").select("event_id", F.unix_micros("when").alias("micros"))


@query("""
SELECT row_id, (old.tmdbId, old.title, old.nextSeasonNumber, old.status, old.releaseDate, old.releaseYear, old.sourceName, old.sourceUrl, old.announcementDate) IS NOT DISTINCT FROM
  (new.tmdbId, new.title, new.nextSeasonNumber, new.status, new.releaseDate, new.releaseYear, new.sourceName, new.sourceUrl, new.announcementDate) AS same FROM changes WHERE old IS NOT NULL AND new IS NOT NULL""")
def same_but_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether two versions of a record differ in nothing but when they were checked."""
    c = table(spark, d, "changes").where("old is not null and new is not null")
    return c.select("row_id", F.col("old").dropFields("lastChecked").eqNullSafe(F.col("new").dropFields("lastChecked")).alias("same"))


@query("SELECT row_id, len(list_filter(sourceUrls, lambda u: u LIKE 'https://%')) = len(sourceUrls) AS all_safe, len(list_filter(sourceUrls, lambda u: contains(u, 'press'))) > 0 AS any_press FROM changes WHERE sourceUrls IS NOT NULL AND list_count(sourceUrls) = len(sourceUrls)")
def array_any_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changes").where("sourceUrls is not null").where(F.forall("sourceUrls", lambda u: u.isNotNull()))
    return c.select("row_id", F.forall("sourceUrls", lambda u: F.startswith(u, F.lit("https://"))).alias("all_safe"), F.exists("sourceUrls", lambda u: F.contains(u, F.lit("press"))).alias("any_press"))


@query("SELECT event_id, CAST(greatest(1, ceil(value - 10)) AS BIGINT) AS wait FROM events WHERE value IS NOT NULL")
def whole_waits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait, whole and at least one."""
    return table(spark, d, "events").where("value is not null").select("event_id", F.greatest(F.lit(1), F.ceil(F.col("value") - 10)).alias("wait"))


@query("""
WITH f AS (SELECT row_id, regexp_replace(lower(coalesce(accessObservation, '')), '\\s+', ' ', 'g') AS t, httpStatus FROM wbd_hbo_max_web_research)
SELECT row_id, CASE WHEN httpStatus IN (401, 403) OR regexp_matches(t, 'captcha|verify you are human|access denied|unusual traffic|checking your browser') THEN 'BLOCKED' WHEN httpStatus = 404 OR regexp_matches(t, 'not found') THEN 'MISSING' WHEN httpStatus >= 500 THEN 'FAILED' WHEN httpStatus IS NULL THEN 'UNKNOWN' ELSE 'OPEN' END AS access FROM f""")
def access_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Access class of a page from its status and the phrases seen on it."""
    t = F.coalesce(X.collapsed(F.lower("accessObservation")), F.lit(""))
    return table(spark, d, "wbd_hbo_max_web_research").select("row_id", X.access_class(t, F.col("httpStatus")).alias("access"))


@query("""
WITH t AS (SELECT row_id, title FROM hbo_max_qualification_cases WHERE title IS NOT NULL), d AS (SELECT row_id, trim(regexp_replace(lower(replace(title || '…', '…', '...')), '\\s*\\.{3,}\\s*', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '\\s*(\\.{3,}|…)\\s*', ' ', 'g')) AS b FROM t)
SELECT row_id, a = b AS same FROM d""")
def ellipsis_aside(spark: SparkSession, d: str) -> DataFrame:
    """Titles are the same whether an ellipsis follows or not, in either spelling."""
    c = table(spark, d, "hbo_max_qualification_cases").where("title is not null")
    return c.select("row_id", (X.without_ellipsis(F.concat("title", F.lit("…"))) == X.without_ellipsis(F.col("title"))).alias("same"))


@query("""
WITH p AS (SELECT DISTINCT tmdbId FROM official_series_data WHERE tmdbId IS NOT NULL AND snapshot_id = (SELECT min(snapshot_id) FROM official_series_data)), n AS (SELECT * FROM official_series_data WHERE snapshot_id = (SELECT max(snapshot_id) FROM official_series_data))
SELECT 'deleted' AS rule, tmdbId FROM p WHERE tmdbId NOT IN (SELECT tmdbId FROM n WHERE tmdbId IS NOT NULL)
UNION ALL SELECT 'duplicate', tmdbId FROM n WHERE tmdbId IS NOT NULL GROUP BY tmdbId HAVING count(*) > 1
UNION ALL SELECT 'unregistered', tmdbId FROM (SELECT DISTINCT tmdbId FROM n WHERE tmdbId IS NOT NULL) WHERE tmdbId NOT IN (SELECT tmdbId FROM sources UNION SELECT tmdbId FROM series_metadata)
UNION ALL SELECT 'dated', tmdbId FROM n WHERE upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) = 'RELEASE_DATE_CONFIRMED' AND releaseDate IS NULL
UNION ALL SELECT 'year', tmdbId FROM n WHERE releaseDate IS NOT NULL AND releaseYear IS DISTINCT FROM year(releaseDate)""")
def dataset_violations(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot against the registry, the first snapshot and its own rules; empty if all is well."""
    rows = table(spark, d, "official_series_data")
    ends = F.broadcast(rows.agg(F.min("snapshot_id").alias("first"), F.max("snapshot_id").alias("last")))
    both = rows.join(ends, F.col("snapshot_id").isin(F.col("first"), F.col("last")))
    old, new = both.where("snapshot_id = first").select("tmdbId").where("tmdbId is not null"), both.where("snapshot_id = last")
    keyed = new.where("tmdbId is not null")
    known = table(spark, d, "series_metadata").select("tmdbId").unionByName(table(spark, d, "sources").select("tmdbId"))
    rules = {"dated": "not (upper(trim(status)) <=> 'RELEASE_DATE_CONFIRMED') or releaseDate is not null", "year": "releaseDate is null or releaseYear <=> year(releaseDate)"}
    return (
        old.distinct().join(keyed.select("tmdbId"), "tmdbId", "left_anti").select(F.lit("deleted").alias("rule"), "tmdbId")
        .unionByName(V.duplicates(keyed, ["tmdbId"]).select(F.lit("duplicate").alias("rule"), "tmdbId"))
        .unionByName(V.orphans(keyed.select("tmdbId").distinct(), "tmdbId", known, "tmdbId").select(F.lit("unregistered").alias("rule"), "tmdbId"))
        .unionByName(V.violations(new.withColumn("status", strip_outer(F.col("status"))), "tmdbId", rules).select("rule", "tmdbId"))
    )
