"""Queries that go through sources, sinks and the remaining scalar functions, and give back what SQL says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.operators import validate as V
from factloom.session import scratch, table
from factloom.sources import files, sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read again with an explicit schema, one bad line of which would stop it all."""
    at = scratch(spark, "jsonl")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    e.write.json(at)
    return files.json_lines(spark, at, e.schema)


@query("SELECT tmdbId, title, provider, officialUrl, array_to_string(allowedDomains, '|') AS domains FROM sources")
def json_document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The registry (a dozen sources by definition) as one JSON document with its rows in an array."""
    at, s = scratch(spark, "document"), table(spark, d, "sources")
    document = s.groupBy().agg(F.lit(1).alias("schemaVersion"), F.collect_list(F.struct(*s.columns)).alias("series"))
    document.write.json(at)
    rows = files.json_document(spark, at, document.schema)
    return rows.select("tmdbId", "title", "provider", "officialUrl", F.array_join("allowedDomains", "|").alias("domains"))


@query("SELECT 'data' AS part, count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'log', count(*), sum(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0")
def published_together(spark: SparkSession, d: str) -> DataFrame:
    """Data and log published as one version, twice; the second one counts."""
    store, o = sinks.VersionedSet(spark, scratch(spark, "published")), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("O", "F"):
        some = o.where(F.col("o_orderstatus") == status)
        store.publish_all({"data": some, "log": some.where("o_orderkey % 7 = 0")})
    parts = [t.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")) for n, t in sorted(store.read_all().items())]
    return parts[0].unionByName(parts[1])


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY ALL")
def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """A log to which only real changes are appended: an empty batch writes nothing."""
    at, c = scratch(spark, "log"), table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    for rows in (c.where("c_acctbal < -500"), c.where("false"), c.where("c_acctbal >= -500 and c_acctbal < 0")):
        sinks.append_log(rows, at)
    log = files.json_lines(spark, at, c.schema)
    return log.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("""
SELECT row_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || '?' || CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?(.*)$', 1) || '&' ELSE '' END || 'api_key=***&page=' || row_id % 9 AS shown
FROM wbd_hbo_max_web_research WHERE url IS NOT NULL AND NOT contains(url, '#')""")
def public_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs with a secret parameter and a fragment added, as they may be shown."""
    w = table(spark, d, "wbd_hbo_max_web_research").where("url is not null and not contains(url, '#')")
    secret = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("api_key=k"), F.col("row_id").cast("string"), F.lit("&page="), (F.col("row_id") % 9).cast("string"), F.lit("#top"))
    return w.select("row_id", U.public(secret).alias("shown"))


@query("SELECT event_id, 'user ' || user_id || ' password=*** token: *** done' AS line FROM events")
def redacted_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" password=p"), F.col("event_id").cast("string"), F.lit(" token: t"), F.col("event_id").cast("string"), F.lit(" done"))
    return e.select("event_id", X.redacted(line).alias("line"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def collapsed_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each whole text with its blanks collapsed."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.collapsed(F.col("text"))).alias("digest"))


@query("SELECT id, CASE WHEN regexp_matches(firstAirDate, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(firstAirDate, 1, 10) AS DATE) END AS day FROM series_metadata")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "series_metadata").select("id", D.iso_date(F.col("firstAirDate")).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(greatest(event_id % 30000, 1), 21600) WHEN event_id % 3 = 1 THEN least(greatest(event_id % 50000, 1), 21600) END AS wait FROM events")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Retry-After headers in seconds, as dates, and broken ones."""
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    as_date = F.date_format(F.timestamp_seconds(F.unix_seconds(now) + F.col("event_id") % 50000), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 30000).cast("string")).when(F.col("event_id") % 3 == 1, as_date).otherwise("soon")
    return table(spark, d, "events").select("event_id", D.retry_after(header, now).alias("wait"))


_NUM = "one|first|two|second|three|third|four|fourth|five|fifth|six|sixth|seven|seventh|eight|eighth|nine|ninth|ten|tenth"
_LIST = "['one','first','two','second','three','third','four','fourth','five','fifth','six','sixth','seven','seventh','eight','eighth','nine','ninth','ten','tenth']"


@query(f"""
WITH s AS (SELECT row_id, CAST(generate_subscripts(relevantEvidenceSnippet, 1) - 1 AS INTEGER) AS pos, lower(unnest(relevantEvidenceSnippet)) AS t FROM hbo_production_evidence),
w AS (SELECT row_id, pos, regexp_extract(t, '(?:^|[^\\pL\\pN_])season ([0-9]+|{_NUM})(?:$|[^\\pL\\pN_])', 1) AS a, regexp_extract(t, '(?:^|[^\\pL\\pN_])([0-9]+|{_NUM})(?:st|nd|rd|th)? (?:and final )?season(?:$|[^\\pL\\pN_])', 1) AS b FROM s)
SELECT row_id, pos, CAST(coalesce(try_cast(nullif(a, '') AS INTEGER), (nullif(list_position({_LIST}, a), 0) + 1) // 2, try_cast(nullif(b, '') AS INTEGER), (nullif(list_position({_LIST}, b), 0) + 1) // 2) AS INTEGER) AS season FROM w WHERE a <> '' OR b <> ''""")
def snippet_seasons(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "hbo_production_evidence").select("row_id", F.posexplode("relevantEvidenceSnippet").alias("pos", "t"))
    return s.select("row_id", "pos", X.season_number(F.col("t")).alias("season")).where("season is not null")


@query("SELECT row_id, lower(regexp_extract(sourceUrl, '^https://([^/?#:@]+)(?::443)?(?:[/?#]|$)', 1)) IN ('press.lumora.example', 'media.kestral.example') AS exact FROM hbo_production_evidence WHERE sourceUrl IS NOT NULL")
def exact_hosts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hbo_production_evidence").where("sourceUrl is not null")
    return e.select("row_id", U.on_hosts(F.col("sourceUrl"), ["press.lumora.example", "media.kestral.example"]).alias("exact"))


@query("""
SELECT 'count' AS rule, CAST(NULL AS INTEGER) AS tmdbId FROM (SELECT count(*) AS n FROM sources) WHERE n <> 12
UNION ALL SELECT 'duplicate', tmdbId FROM sources GROUP BY tmdbId HAVING count(*) > 1
UNION ALL SELECT 'domain', tmdbId FROM sources WHERE len(list_filter(allowedDomains, lambda x: lower(regexp_extract(officialUrl, '^https?://([^/?#:@]+)', 1)) = lower(x) OR lower(regexp_extract(officialUrl, '^https?://([^/?#:@]+)', 1)) LIKE '%.' || lower(x))) = 0
UNION ALL SELECT 'url', tmdbId FROM sources WHERE officialUrl NOT LIKE 'https://%' UNION ALL SELECT 'names', tmdbId FROM sources WHERE len(aliases) = 0""")
def registry_violations(spark: SparkSession, d: str) -> DataFrame:
    """The registry against its rules: twelve distinct sources with names, each on one of its own domains; empty if all is well."""
    s = table(spark, d, "sources").withColumn("own", U.on_domains(F.col("officialUrl"), F.col("allowedDomains")))
    counted = s.agg(F.count("*").alias("n")).where("n != 12").select(F.lit("count").alias("rule"), F.lit(None).cast("int").alias("tmdbId"))
    rules = {"domain": "own or not startswith(officialUrl, 'https://')", "url": "startswith(officialUrl, 'https://')", "names": "size(aliases) > 0"}
    return counted.unionByName(V.duplicates(s, ["tmdbId"]).select(F.lit("duplicate").alias("rule"), "tmdbId")).unionByName(V.violations(s, "tmdbId", rules).select("rule", "tmdbId"))


_MON = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_M3 = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


@query(f"""
WITH a AS (SELECT doc_id, publication_date AS p, regexp_extract(text, '(?i)\\b({_MON})\\.? ([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,? ([0-9]{{4}}))?\\b', ['m', 'd', 'y']) AS x, regexp_extract(text, '(?i)\\b([0-9]{{1,2}})(?:st|nd|rd|th)? ({_MON})\\.?(?:,? ([0-9]{{4}}))?\\b', ['d', 'm', 'y']) AS z FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, p, CASE WHEN x.m <> '' THEN x.m ELSE z.m END AS m, CASE WHEN x.m <> '' THEN x.d ELSE z.d END AS d, nullif(CASE WHEN x.m <> '' THEN x.y ELSE z.y END, '') AS y FROM a),
c AS (SELECT *, '-' || lpad(CAST(list_position({_M3}, lower(m[1:3])) AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS md FROM b WHERE m <> '')
SELECT doc_id, CASE WHEN y IS NOT NULL THEN try_cast(y || md AS DATE) WHEN try_cast(year(p) || md AS DATE) < p THEN try_cast((year(p) + 1) || md AS DATE) ELSE try_cast(year(p) || md AS DATE) END AS day FROM c""")
def english_dates(spark: SparkSession, d: str) -> DataFrame:
    """First English date of each text; without a year that of the publication, or the next if it would precede it."""
    rows = table(spark, d, "documents").where("text is not null").where(F.col("text").rlike(D.ANY_ENGLISH_DATE))
    return rows.select("doc_id", D.english_date(F.col("text"), F.col("publication_date")).alias("day"))


@query("SELECT row_id, '1|=' || replace(replace(replace(base64(encode(caseId)), '+', '-'), '/', '_'), '=', '') || '|' || CASE WHEN title IS NULL THEN '-' ELSE '=' || replace(replace(replace(base64(encode(title)), '+', '-'), '/', '_'), '=', '') END AS line, caseId, title FROM hbo_max_qualification_cases")
def line_codec(spark: SparkSession, d: str) -> DataFrame:
    """Fields as one line and back again."""
    from factloom.functions import codes as C

    rows = table(spark, d, "hbo_max_qualification_cases").select("row_id", C.encode_line(1, [F.col("caseId"), F.col("title")]).alias("line"))
    return rows.select("row_id", "line", C.decode_line(F.col("line"), 1, ["caseId", "title"]).alias("x")).select("row_id", "line", "x.*")


@query("SELECT event_id, md5(props) IS NOT NULL AND json_keys(props) = ['k'] AND json_type(props, '$.k') = 'UBIGINT' AS strict FROM events")
def strict_objects(spark: SparkSession, d: str) -> DataFrame:
    """Whether a JSON text is exactly the object that is expected: its keys once each, values of the right type."""
    return table(spark, d, "events").select("event_id", files.strict_object(F.col("props"), {"k": "int"}).alias("strict"))


def _hmac_sql(message: str, secret: bytes) -> str:
    """HMAC-SHA256 by its definition: the two pads are constants of the secret."""
    key = secret.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


_SECRET = b"not a secret"


@query(f"SELECT event_id, {_hmac_sql(chr(39) + chr(39) + ' || CAST(floor(epoch(ts) / 86400) AS BIGINT) || ' + chr(39) + ':' + chr(39) + ' || user_id', _SECRET)} AS pseudonym FROM events")
def daily_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Keyed pseudonyms of users that change at midnight UTC."""
    from factloom.functions import codes as C

    e = table(spark, d, "events")
    return e.select("event_id", C.daily_pseudonym(F.col("user_id").cast("string"), F.col("ts").cast("timestamp"), _SECRET).alias("pseudonym"))


@query("""SELECT user_id, array_to_string(list_sort(list(t)), ',') AS last_three FROM (SELECT user_id, epoch_us(ts) AS t FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) GROUP BY user_id""")
def last_three_times(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last three instants in order; the others go before the shuffle."""
    from factloom.operators import ordering as O

    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    top = O.top_per_group(e, "user_id", [F.desc("t"), F.desc("event_id")], 3)
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.cast("string")), ",").alias("last_three"))


@query("""
WITH s AS (SELECT DISTINCT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS previous FROM (SELECT DISTINCT snapshot_id FROM official_series_data)),
r AS (SELECT DISTINCT snapshot_id, tmdbId, sourceUrl FROM official_series_data WHERE tmdbId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id, tmdbId ORDER BY row_id) = 1),
o AS (SELECT * FROM r WHERE snapshot_id = (SELECT max(previous) FROM s)), n AS (SELECT * FROM r WHERE snapshot_id = (SELECT max(snapshot_id) FROM s)),
c AS (SELECT count(*) AS k FROM o FULL JOIN n ON o.tmdbId = n.tmdbId WHERE o.sourceUrl IS DISTINCT FROM n.sourceUrl OR o.tmdbId IS NULL OR n.tmdbId IS NULL), l AS (SELECT max(row_id) AS last FROM changes)
SELECT 'changed ids' AS rule, k AS n FROM c WHERE k <> 1 UNION ALL SELECT 'log lines added', count(*) FROM changes WHERE row_id > (SELECT last - 2 FROM l) HAVING count(*) <> 1""")
def publication_boundary(spark: SparkSession, d: str) -> DataFrame:
    """A publication may change one id and add one line to the log, and must keep all lines before; here it does more."""
    from factloom.operators import joins as J

    rows = table(spark, d, "official_series_data").where("tmdbId is not null")
    ends = F.broadcast(rows.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(2).agg(F.min("snapshot_id").alias("first"), F.max("snapshot_id").alias("last")))
    both = rows.join(ends, F.col("snapshot_id").isin(F.col("first"), F.col("last")))
    old, new = (J.last_by_key(both.where(f"snapshot_id = {s}").select("tmdbId", "row_id", "sourceUrl"), ["tmdbId"], [-F.col("row_id")]) for s in ("first", "last"))
    log = table(spark, d, "changes").select(F.col("row_id").alias("position"), F.coalesce("title", F.lit("")).alias("line"))
    last = F.broadcast(log.agg(F.max("position").alias("end")))
    before = log.join(last, F.col("position") <= F.col("end") - 2).drop("end")
    return V.publication_boundary(old, new, "tmdbId", ["sourceUrl"], before, log)


@query("""
SELECT row_id, array_to_string(regexp_extract_all(replace(lower(nfc_normalize(array_to_string(list_transform(string_split(replace(replace(title, '&amp;', '&'), '&#39;', chr(39)), ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN (160, 12288) THEN ' ' ELSE c END), ''))), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS t
FROM official_series_data WHERE regexp_matches(title, '^[\\x20-\\x7e\\x{a0}-\\x{17f}\\x{300}-\\x{301}\\x{ff01}-\\x{ff5e}\\x{3000}]*$')""")
def accent_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of Latin letters in compatibility form with their accents, words joined by single blanks."""
    rows = table(spark, d, "official_series_data").where(F.col("title").rlike(r"^[\x20-\x7e\u00a0-\u017f\u0300-\u0301\uff01-\uff5e\u3000]*$"))
    return rows.select("row_id", X.kept_accents(F.col("title")).alias("t"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


_BLANKS = "trim(regexp_replace({}, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' ')"


@query(f"""
SELECT doc_id, {_BLANKS.format("coalesce(title, '') || ' | site'")} AS title, {_BLANKS.format("coalesce(title, '-')")} AS heading, CAST(2 AS INTEGER) AS links, url AS first_href, {_BLANKS.format("'read ' || coalesce(title, '')")} AS anchor, md5({_BLANKS.format("coalesce(title, '-')")} || ' / The text. / read' || CASE WHEN {_BLANKS.format("coalesce(title, '')")} = '' THEN '' ELSE ' / ' || {_BLANKS.format("coalesce(title, '')")} END) AS shown, coalesce(lang, '') = 'xx' AS challenge
FROM documents WHERE url IS NOT NULL""")
def wrapped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of each document's title and URL, with a menu, a script and a related block, and what is read from them."""
    from factloom.sources import pages

    title = _escaped(F.coalesce("title", F.lit("")))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit(" | site</title><script>var a = '<p>no</p>';</script></head><body><nav>Menu</nav><h1>"), _escaped(F.coalesce("title", F.lit("-"))),
        F.lit("</h1><p>The text.<p><a href=\""), _escaped(F.col("url")), F.lit("\">read <b>"), title, F.lit("</b></a><div class='related'>Other <a href='/x'>one</a></div><footer>End</footer></body></html>"),
    )
    rows = table(spark, d, "documents").where("url is not null").select("doc_id", pages.parsed_page(html).alias("p"))
    return rows.select(
        "doc_id", "p.title", "p.heading", F.size("p.links").alias("links"), F.col("p.links")[0]["href"].alias("first_href"), F.col("p.links")[0]["anchor"].alias("anchor"),
        F.md5(F.replace("p.text", F.lit("\n"), F.lit(" / "))).alias("shown"), "p.challenge",
    )


@query("SELECT doc_id, strftime(publication_date, '%Y-%m-%d') AS day FROM documents WHERE url IS NOT NULL AND publication_date IS NOT NULL")
def published_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of publication from JSON-LD made for each document, beside a node of another page that must not count."""
    from factloom.sources import pages

    docs = table(spark, d, "documents").where("url is not null and publication_date is not null")
    node = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.lit("News").alias("headline"), F.col("url"), F.concat(F.date_format("publication_date", "yyyy-MM-dd"), F.lit("T08:00:00Z")).alias("datePublished")))
    other = F.lit('{"@type":"NewsArticle","headline":"News","url":"https://other.example/","datePublished":"1999-01-01"}')
    html = F.concat(*[x for script in (node, other, F.lit("{broken")) for x in (F.lit('<script type="application/ld+json">'), script, F.lit("</script>"))], F.lit("<h1> News </h1>"))
    return docs.select("doc_id", pages.published(html, F.col("url")).alias("day"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'urlset' WHEN 1 THEN 'index' WHEN 3 THEN 'urlset' END AS kind, CASE doc_id % 4 WHEN 0 THEN url || '|' || url || '/b' WHEN 1 THEN url ELSE '' END AS links FROM documents WHERE url IS NOT NULL""")
def sitemap_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps of four kinds: a list, an index, one with a DOCTYPE, and one over the limit, which gives nothing at all."""
    from factloom.sources import pages

    url, k = _escaped(F.col("url")), F.col("doc_id") % 4
    loc = F.concat(F.lit("<loc>"), url, F.lit("</loc>"))
    two = F.concat(F.lit("<urlset><url>"), loc, F.lit("</url><url><loc>"), url, F.lit("/b</loc></url></urlset>"))
    xml = F.when(k == 0, two).when(k == 1, F.concat(F.lit("<sitemapindex><sitemap>"), loc, F.lit("</sitemap></sitemapindex>"))).when(k == 2, F.concat(F.lit("<!DOCTYPE x>"), two)).otherwise(
        F.concat(F.lit("<urlset>"), F.repeat(F.concat(F.lit("<url>"), loc, F.lit("</url>")), 4), F.lit("</urlset>"))
    )
    rows = table(spark, d, "documents").where("url is not null").select("doc_id", pages.sitemap(xml, most_urls=3).alias("s"))
    return rows.select("doc_id", "s.kind", F.array_join("s.links", "|").alias("links"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR contains(text, chr(65533)) THEN NULL ELSE md5(text) END AS digest FROM documents WHERE text IS NOT NULL")
def strictly_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as bytes in a declared or undeclared charset and back; an unknown charset gives nothing."""
    from factloom.sources import pages

    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"), F.when(k == 0, "utf-8").when(k == 2, "no-such-charset").alias("c"))
    return docs.select("doc_id", F.md5(pages.decoded_html(F.col("b"), F.col("c"))).alias("digest"))


@query("SELECT row_id, regexp_extract(url, '^https?://[^/?#]+', 0) || '/a/' || row_id || '?x=1' AS url FROM wbd_hbo_max_web_research WHERE url IS NOT NULL")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative links against the page they stand on."""
    from factloom.sources import pages

    w = table(spark, d, "wbd_hbo_max_web_research").where("url is not null")
    return w.select("row_id", pages.resolved(F.col("url"), F.concat(F.lit("/b/../a/"), F.col("row_id").cast("string"), F.lit("?x=1#top"))).alias("url"))


@query("SELECT row_id, regexp_extract(url, '^https?://[^/?#]+', 0) || '/find?s=' || row_id || '+a%26b' AS asked FROM wbd_hbo_max_web_research WHERE url IS NOT NULL AND url LIKE 'https://%.example/%'")
def search_forms(spark: SparkSession, d: str) -> DataFrame:
    """The URL that a page's search form asks for; forms of another method or without the field are passed over."""
    from factloom.sources import pages

    html = F.lit("<form method=post action='/no'><input name=s></form><form action='/other'><input name=q></form><form action='/find#x'><input name='s'></form>")
    w = table(spark, d, "wbd_hbo_max_web_research").where("url like 'https://%.example/%'")
    return w.select("row_id", pages.search_url(html, F.col("url"), "s", ["example"], F.concat(F.col("row_id").cast("string"), F.lit(" a&b"))).alias("asked"))
