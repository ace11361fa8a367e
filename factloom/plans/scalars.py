"""Queries for text, URL and date functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Width forms and blanks by code point, accents by DuckDB's own function.
_FOLD = (
    "trim(regexp_replace(lower(regexp_replace(strip_accents(array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)"
    " WHEN unicode(c) IN (160, 8239, 8199, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' ' WHEN list_contains([8544, 8548, 8553, 8556, 8557, 8558, 8559], (unicode(c) - 8544) % 16 + 8544) AND unicode(c) BETWEEN 8544 AND 8575 THEN substr('ivxlcdm', CAST(list_position([8544, 8548, 8553, 8556, 8557, 8558, 8559], (unicode(c) - 8544) % 16 + 8544) AS BIGINT), 1)"
    " WHEN unicode(c) IN (8216, 8217, 8220, 8221) THEN chr(39) ELSE c END), '')), '[^\\x00-\\x7f]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
)


def _fold(column: str) -> str:
    for joined, plain in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("ⅱ", "ii"), ("ⅲ", "iii"), ("ⅳ", "iv")):
        column = f"replace({column}, '{joined}', '{plain}')"
    return _FOLD.format(column)


@query(f"SELECT row_id, {_fold('requestedTitle')} AS folded, replace({_fold('requestedTitle')}, ' ', '-') AS slug FROM hbo_production_evidence")
def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.col("requestedTitle")
    folded = table(spark, d, "hbo_production_evidence").select("row_id", X.normalized(title).alias("folded"))
    return folded.select("row_id", "folded", F.replace("folded", F.lit(" "), F.lit("-")).alias("slug"))


@query(f"""SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(string_split({_fold('title')}, ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'of', 'for', 'with')))), ' ') AS words FROM hbo_max_qualification_cases""")
def title_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hbo_max_qualification_cases").select("row_id", X.normalized(F.col("title")).alias("t"))
    return rows.select("row_id", F.array_join(F.array_sort(X.words(F.col("t"))), " ").alias("words"))


@query("""SELECT row_id, lower(regexp_extract(sourceUrl, '^https?://([^/?#:@]+)', 1)) AS host, coalesce(regexp_extract(sourceUrl, '^https?://[^/?#]+([^?#]*)', 1), '') AS path,
regexp_matches(sourceUrl, '^https://') AND lower(regexp_extract(sourceUrl, '^https://([^/?#:@]+)(/|$)', 1)) IN ('press.lumora.example', 'news.vantelle.example') AS allowed FROM hbo_production_evidence WHERE sourceUrl IS NOT NULL""")
def domain_allowlist(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("sourceUrl")
    domains = F.array(F.lit("press.lumora.example"), F.lit("news.vantelle.example"))
    e = table(spark, d, "hbo_production_evidence").where("sourceUrl is not null")
    return e.select("row_id", U.host(url).alias("host"), F.coalesce(U.part(url, 5), F.lit("")).alias("path"), U.on_domains(url, domains).alias("allowed"))


@query("""WITH u AS (SELECT row_id, regexp_extract(url, '^([^?#]*)', 1) AS base, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^(utm_[a-z_]*|fbclid|gclid|mc_cid|mc_eid)$'))) AS q FROM wbd_hbo_max_web_research WHERE url IS NOT NULL)
SELECT row_id, regexp_replace(lower(regexp_extract(base, '^(https?://[^/]+)', 1)) || regexp_extract(base, '^https?://[^/]+(.*)$', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM u""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Whole URLs in canonical form, queries included."""
    return table(spark, d, "wbd_hbo_max_web_research").where("url is not null").select("row_id", U.canonical(F.col("url")).alias("url"))


@query("SELECT row_id, list_has_any(string_split_regex(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]+'), ['media', 'press', 'news']) AS in_newsroom FROM wbd_hbo_max_web_research WHERE url IS NOT NULL")
def path_classes(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("media", "press", "news")))
    rows = table(spark, d, "wbd_hbo_max_web_research").where("url is not null")
    return rows.select("row_id", F.coalesce(F.arrays_overlap(U.path_tokens(F.col("url")), words), F.lit(False)).alias("in_newsroom"))


@query("SELECT row_id, epoch_us(CAST(timestamp AS TIMESTAMPTZ)) AS micros, CAST(floor(epoch(CAST(timestamp AS TIMESTAMPTZ)) / 86400) AS BIGINT) AS day FROM changes")
def instants(spark: SparkSession, d: str) -> DataFrame:
    t = D.instant(F.col("timestamp"))
    return table(spark, d, "changes").select("row_id", F.unix_micros(t).alias("micros"), F.floor(F.unix_seconds(t) / 86400).alias("day"))


@query("SELECT row_id, receivedAt + INTERVAL 24 HOUR < TIMESTAMPTZ '2026-01-01 00:00:00+00' AS stale FROM changes")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "changes").select("row_id", D.is_stale(F.col("receivedAt"), now, 24).alias("stale"))


@query("""WITH s AS (SELECT row_id, unnest(relevantEvidenceSnippet) AS t, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos FROM hbo_production_evidence),
m AS (SELECT row_id, pos, t, lower(regexp_extract(t, '(?i)\\b(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\\b', 1)) AS x, regexp_extract(t, '(?i)\\b([0-9]{1,2}) de (?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre) de ([0-9]{4})\\b', ['d', 'y']) AS g, lower(regexp_extract(t, '(?i)\\b[0-9]{1,2} de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre) de [0-9]{4}\\b', 1)) AS mon FROM s)
SELECT row_id, pos, make_date(CAST(g.y AS INTEGER), list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], mon), CAST(g.d AS INTEGER)) AS day FROM m WHERE mon <> ''""")
def spanish_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t"))
    return e.select("row_id", "pos", D.spanish_date(F.col("t")).alias("day")).where("day is not null")


@query("""SELECT row_id, replace(replace(replace(base64(encode(caseId)), '+', '-'), '/', '_'), '=', '') AS code, caseId AS back FROM hbo_max_qualification_cases""")
def base64url_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hbo_max_qualification_cases").withColumn("code", X.base64url(F.col("caseId")))
    return rows.select("row_id", "code", X.from_base64url(F.col("code")).alias("back"))


@query("""WITH e AS (SELECT row_id, coalesce(array_to_string(relevantEvidenceSnippet, ' '), '') AS t FROM hbo_production_evidence WHERE relevantEvidenceSnippet IS NOT NULL)
SELECT row_id, len(regexp_extract_all(lower(t), '\\b[0-9]+(st|nd|rd|th|e|ª|ᵉ)?\\.? (season|saison|staffel|temporada|sezona)')) AS seasons, len(regexp_extract_all(t, '20[0-9]{2}')) AS years, len(regexp_extract_all(lower(t), 'renew|renueva|verlängert|cancel|otkaz')) AS actions FROM e""")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each of three patterns occurs in a row's snippets."""
    e = table(spark, d, "hbo_production_evidence").where("relevantEvidenceSnippet is not null").select("row_id", F.array_join("relevantEvidenceSnippet", " ").alias("t"))

    def times(c, p: str):
        return F.regexp_count(c, F.lit(p)).cast("long")

    return e.select(
        "row_id", times(F.lower("t"), r"\b[0-9]+(st|nd|rd|th|e|ª|ᵉ)?\.? (season|saison|staffel|temporada|sezona)").alias("seasons"),
        times(F.col("t"), "20[0-9]{2}").alias("years"), times(F.lower("t"), "renew|renueva|verlängert|cancel|otkaz").alias("actions"),
    )
