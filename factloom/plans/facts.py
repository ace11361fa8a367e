"""Queries for claims, their merging into records, promotion and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import binding as B
from factloom.operators import facts as A
from factloom.operators import joins as J
from factloom.operators.history import strip_outer
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def claims_en(spark: SparkSession, d: str) -> DataFrame:
    """Facts that each document states of the series it is about."""
    docs = table(spark, d, "documents").select("doc_id", "text", B.alias_array(F.col("title")).alias("names"), "publication_date")
    return B.bound_claims(docs, "text", "names", "publication_date")


@query()
def claims_es(spark: SparkSession, d: str) -> DataFrame:
    """Facts and regional dates of Spanish snippets about the series that was asked for."""
    e = table(spark, d, "hbo_production_evidence").where("language = 'es'")
    rows = e.select("row_id", B.alias_array(F.col("requestedTitle")).alias("names"), F.col("observedAt").cast("date").alias("seen"), F.posexplode("relevantEvidenceSnippet").alias("pos", "text"))
    return B.bound_claims(rows, "text", "names", "seen", spanish=True)


@query()
def replayed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's facts come out again if only their excerpts are read."""
    docs = table(spark, d, "documents").select("doc_id", "text", B.alias_array(F.col("title")).alias("names"), "publication_date")
    found = B.bound_claims(docs.withColumn("kept", F.struct("names", "publication_date")), "text", "names", "publication_date")
    stored = found.select("doc_id", F.col("sentence").alias("place"), F.col("kind").alias("stored_kind"), F.col("season").alias("stored_season"), F.col("excerpt").alias("text"), "kept.names", "kept.publication_date").distinct()
    again = B.replayed(stored, ["doc_id", "place", "stored_kind", "stored_season"], "text", "names", "publication_date", "stored_season", "stored_kind")
    return again.groupBy("stored_kind").agg(F.count("*").alias("facts"), F.count_if("replayed").alias("replayed"))


_CASES = [
    ("F1", "en", "Paper Ferry renewed for season 4", "RENEWED 4"), ("F2", "en", "Paper Ferry renewed for a fourth and final season", "FINAL_SEASON 4"),
    ("F3", "en", "Paper Ferry season 4 premieres October 16, 2026", "RELEASE_DATE_CONFIRMED 4 2026-10-16"), ("F4", "en", "Paper Ferry season 4 canceled", "CANCELED 4"),
    ("F5", "en", "Paper Ferry ended well while Iron Lantern was renewed for season 3", ""), ("F6", "en", "Paper Ferry season 4 premieres in 2027", "RENEWED 4 2027"),
    ("F7", "en", "Paper Ferry was renewed for season 3 and season 2 premieres May 5, 2026", "RELEASE_DATE_CONFIRMED 2 2026-05-05; RENEWED 3"),
    ("F8", "en", "Paper Ferry season 3 was published on June 1, 2026", ""), ("F8b", "en", "Production on season 3 of Paper Ferry begins June 1, 2026", "RENEWED 3"),
    ("F9", "en", "On September 4, 2026 Season four of Paper Ferry premieres October 1, 2026", "RELEASE_DATE_CONFIRMED 4 2026-10-01"),
    ("F10", "en", "Published January 3, 2026, Paper Ferry season 2 premieres March 5, 2026", "RELEASE_DATE_CONFIRMED 2 2026-03-05"),
    ("F11", "es", "Paper Ferry renovada para una tercera temporada, la segunda temporada se estrena el 3 de mayo de 2026", "RENEWED 3"),
    ("F12", "es", "Paper Ferry sigue en antena; Iron Lantern tendrá una cuarta temporada", ""), ("F13", "es", "Lumora no renueva Paper Ferry por una tercera temporada", ""),
    ("F14", "es", "Paper Ferry tendrá una quinta y última temporada, que se estrena el 3 de mayo de 2026", "FINAL_SEASON 5; REGIONAL_DATE 5 2026-05-03"),
    ("F15a", "en", "Hulu renewed Paper Ferry for a fourth season", "RENEWED 4"), ("F15b", "en", "Paper Ferry has been picked up for a second season", "RENEWED 2"),
    ("F15c", "en", "It is false that Paper Ferry has been picked up for a second season", ""), ("F15d", "en", "Paper Ferry season 2 and season 3 canceled", ""),
    ("F15e", "en", "The fourth and final season of comedy series Paper Ferry arrives May 1", "FINAL_SEASON 4; RELEASE_DATE_CONFIRMED 4 2026-05-01"), ("F15f", "en", "Paper Ferry is not renewed for season 3", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{want}')" for c, _, _, want in _CASES) + ") AS t(case_id, facts)")
def claim_cases(spark: SparkSession, d: str) -> DataFrame:
    """The claim cases of the fixtures with the facts that must come out of each."""
    cases = spark.createDataFrame([(c, lang, text) for c, lang, text, _ in _CASES], "case_id string, lang string, text string")
    rows = cases.withColumn("names", F.array(F.lit("Paper Ferry"))).withColumn("seen", F.lit("2026-01-10").cast("date"))
    found = B.bound_claims(rows.where("lang = 'en'"), "text", "names", "seen").unionByName(B.bound_claims(rows.where("lang = 'es'"), "text", "names", "seen", spanish=True))
    told = F.concat_ws(" ", "kind", F.col("season").cast("string"), F.coalesce(F.col("day").cast("string"), F.col("year").cast("string")))
    facts = found.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(told)), "; ").alias("facts"))
    return cases.select("case_id").join(facts, "case_id", "left").select("case_id", F.coalesce("facts", F.lit("")).alias("facts"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hbo_production_evidence").where("tmdbId is not null and nextSeasonNumber is not null and status is not null")
    rule = (
        F.when(F.col("status") == "CANCELED", "explicit-cancellation").when(F.col("status") == "FINAL_SEASON", "explicit-final-season").when(F.col("status") == "RELEASE_DATE_CONFIRMED", "explicit-premiere")
        .when(F.col("releaseDate").isNull() & F.col("releaseYear").isNotNull(), "explicit-release-year").otherwise("explicit-renewal")
    )
    revised = F.coalesce(F.col("row_id") % 3 == 0, F.lit(False))
    return e.select(
        "tmdbId", F.col("requestedTitle").alias("title"), "nextSeasonNumber", "status", "releaseDate", "releaseYear", "sourceName", "sourceUrl", "announcementDate",
        rule.alias("rule"), revised.alias("dateRevision"), F.col("row_id").alias("ord"),
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "official_series_data").where("tmdbId is not null")
    last = J.last_by_key(rows, ["tmdbId"], [F.col("snapshot_id"), F.col("lastChecked"), F.col("row_id")])
    return last.withColumn("status", F.upper(strip_outer(F.col("status"))))


_MERGED = """
WITH f AS (SELECT tmdbId, requestedTitle AS title, nextSeasonNumber AS season, status, releaseDate AS day, releaseYear AS yr, sourceName, sourceUrl, announcementDate AS ann, row_id AS ord, row_id % 3 = 0 AS rev,
    CASE WHEN status = 'CANCELED' THEN 'explicit-cancellation' WHEN status = 'FINAL_SEASON' THEN 'explicit-final-season' WHEN status = 'RELEASE_DATE_CONFIRMED' THEN 'explicit-premiere' WHEN releaseDate IS NULL AND releaseYear IS NOT NULL THEN 'explicit-release-year' ELSE 'explicit-renewal' END AS rule,
    CASE status WHEN 'CANCELED' THEN 4 WHEN 'FINAL_SEASON' THEN 3 WHEN 'RENEWED' THEN 1 ELSE 0 END AS w
  FROM hbo_production_evidence WHERE tmdbId IS NOT NULL AND nextSeasonNumber IS NOT NULL AND status IS NOT NULL),
o AS (SELECT tmdbId, title, nextSeasonNumber AS season, upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS status, releaseDate AS day, releaseYear AS yr, sourceName, sourceUrl, announcementDate AS ann FROM official_series_data WHERE tmdbId IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY snapshot_id DESC, lastChecked DESC NULLS LAST, row_id DESC) = 1),
top AS (SELECT * FROM f QUALIFY season = max(season) OVER (PARTITION BY tmdbId)),
p AS (SELECT *, row_number() OVER (PARTITION BY tmdbId ORDER BY w DESC, day IS NOT NULL DESC, coalesce(ann, DATE '0001-01-01') DESC, ord) AS place FROM top),
life AS (SELECT * FROM p WHERE rule NOT IN ('explicit-premiere', 'explicit-release-year') QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY place) = 1),
dated AS (SELECT * FROM p WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY place) = 1),
yeared AS (SELECT * FROM p WHERE yr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY place) = 1),
revs AS (SELECT * FROM p WHERE day IS NOT NULL AND rev AND ann IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY ann DESC, place) = 1),
days AS (SELECT tmdbId, day, ann FROM p WHERE day IS NOT NULL UNION ALL SELECT o.tmdbId, o.day, o.ann FROM o JOIN p ON p.tmdbId = o.tmdbId AND p.place = 1 AND p.season = o.season WHERE o.day IS NOT NULL),
nd AS (SELECT d.tmdbId, count(DISTINCT d.day) > 1 AS several, bool_or(r.tmdbId IS NULL OR (d.day <> r.day AND (d.ann IS NULL OR d.ann >= r.ann))) AS beaten FROM days d LEFT JOIN revs r ON r.tmdbId = d.tmdbId GROUP BY d.tmdbId),
b AS (SELECT coalesce(t.tmdbId, o.tmdbId) AS tmdbId, t.tmdbId IS NULL AS nofacts, t.season AS season, coalesce(o.season = t.season, false) AS same, coalesce(several, false) AS several, coalesce(beaten, false) AS beaten, o AS o, t AS t, l AS l, y AS y, r AS r, g AS g
  FROM (SELECT * FROM p WHERE place = 1) t FULL JOIN o ON o.tmdbId = t.tmdbId LEFT JOIN life l ON l.tmdbId = t.tmdbId LEFT JOIN dated g ON g.tmdbId = t.tmdbId LEFT JOIN yeared y ON y.tmdbId = t.tmdbId LEFT JOIN revs r ON r.tmdbId = t.tmdbId LEFT JOIN nd ON nd.tmdbId = t.tmdbId),
s AS (SELECT *, CASE WHEN same AND o.status IN ('FINAL_SEASON', 'CANCELED') THEN o.status WHEN same AND o.status = 'RELEASE_DATE_CONFIRMED' AND (l.status IS NULL OR l.status = 'RENEWED') THEN o.status WHEN same THEN coalesce(l.status, o.status) ELSE coalesce(l.status, t.status) END AS said,
  CASE WHEN several THEN r.day ELSE g.day END AS dday FROM b),
u AS (SELECT *, CASE WHEN said <> 'CANCELED' THEN coalesce(dday, CASE WHEN same THEN o.day END) END AS day FROM s),
v AS (SELECT *, CASE WHEN said = 'RELEASE_DATE_CONFIRMED' AND day IS NULL THEN 'RENEWED' ELSE said END AS status, CASE WHEN said = 'CANCELED' THEN NULL WHEN day IS NOT NULL THEN year(day) ELSE coalesce(y.yr, CASE WHEN same THEN o.yr END) END AS yr FROM u),
k AS (SELECT *, CASE WHEN nofacts OR coalesce(season < o.season, false) THEN 'unchanged' WHEN several AND beaten THEN 'conflicting dates'
    WHEN dday IS NULL AND same AND y.yr IS NOT NULL AND (coalesce(y.yr <> year(o.day), false) OR coalesce(y.yr <> o.yr, false)) THEN 'conflicting years'
    WHEN o.tmdbId IS NOT NULL AND o.season IS NOT DISTINCT FROM season AND o.status IS NOT DISTINCT FROM status AND o.day IS NOT DISTINCT FROM day AND o.yr IS NOT DISTINCT FROM yr THEN 'unchanged' ELSE 'changed' END AS outcome,
  CASE WHEN same AND o.status = status AND ((status IN ('FINAL_SEASON', 'CANCELED') AND (l.status IS NULL OR l.status <> status)) OR l.status IS NULL) THEN 'o' WHEN l.status IS NOT NULL THEN 'l' WHEN dday IS NOT NULL THEN CASE WHEN several THEN 'r' ELSE 'g' END ELSE 't' END AS src FROM v),
m AS (SELECT tmdbId, outcome, CASE WHEN outcome = 'changed' THEN season ELSE o.season END AS nextSeasonNumber, CASE WHEN outcome = 'changed' THEN status ELSE o.status END AS status, CASE WHEN outcome = 'changed' THEN day ELSE o.day END AS releaseDate,
  CAST(CASE WHEN outcome = 'changed' THEN yr ELSE o.yr END AS INTEGER) AS releaseYear,
  CASE WHEN outcome <> 'changed' OR src = 'o' THEN o.sourceUrl WHEN src = 'l' THEN l.sourceUrl WHEN src = 'r' THEN r.sourceUrl WHEN src = 'g' THEN g.sourceUrl ELSE t.sourceUrl END AS sourceUrl,
  CASE WHEN outcome = 'changed' THEN CASE src WHEN 'o' THEN 'previous-status-evidence' WHEN 'l' THEN l.rule WHEN 'r' THEN r.rule WHEN 'g' THEN g.rule ELSE t.rule END END AS rule FROM k)
"""


@query(_MERGED + """SELECT m.*, CASE WHEN outcome = 'changed' THEN coalesce((SELECT string_agg(DISTINCT sourceUrl, '|' ORDER BY sourceUrl) FROM p WHERE p.tmdbId = m.tmdbId AND p.sourceUrl <> m.sourceUrl), '') END AS supporting FROM m""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Facts merged into the records of the latest snapshot."""
    merged = A.merge_facts(_records(spark, d), _facts(spark, d))
    return merged.select("tmdbId", "outcome", "nextSeasonNumber", "status", "releaseDate", "releaseYear", "sourceUrl", "rule", "supporting")


@query(_MERGED + """, q AS (SELECT tmdbId, season, day, arg_min(sourceUrl, ord) AS url FROM f WHERE rule = 'explicit-premiere' AND day IS NOT NULL GROUP BY ALL)
SELECT m.tmdbId AS tmdbId, CASE WHEN status = 'RENEWED' AND releaseDate IS NOT NULL THEN 'RELEASE_DATE_CONFIRMED' ELSE status END AS status, CASE WHEN status = 'RENEWED' AND releaseDate IS NOT NULL AND q.tmdbId IS NOT NULL THEN q.url ELSE sourceUrl END AS sourceUrl
FROM m LEFT JOIN q ON q.tmdbId = m.tmdbId AND q.season = m.nextSeasonNumber AND q.day = m.releaseDate""")
def promoted_records(spark: SparkSession, d: str) -> DataFrame:
    """Merged records, of which renewed ones with a day are confirmed by their premiere fact."""
    facts = _facts(spark, d)
    return A.promoted(A.merge_facts(_records(spark, d), facts), facts).select("tmdbId", "status", "sourceUrl")


@query(_MERGED + """SELECT m.tmdbId AS tmdbId, concat_ws(',', CASE WHEN m.nextSeasonNumber IS DISTINCT FROM o.season THEN 'nextSeasonNumber' END, CASE WHEN m.releaseDate IS DISTINCT FROM o.day THEN 'releaseDate' END, CASE WHEN m.releaseYear IS DISTINCT FROM o.yr THEN 'releaseYear' END,
  CASE WHEN m.sourceUrl IS DISTINCT FROM o.sourceUrl THEN 'sourceUrl' END, CASE WHEN m.status IS DISTINCT FROM o.status THEN 'status' END) AS fields FROM m JOIN o ON o.tmdbId = m.tmdbId
WHERE (m.nextSeasonNumber, m.status, m.releaseDate, m.releaseYear, m.sourceUrl) IS DISTINCT FROM (o.season, o.status, o.day, o.yr, o.sourceUrl)""")
def rebuilt_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Records rebuilt from the facts against the stored ones: in which fields they differ."""
    old = _records(spark, d)
    fields = ["nextSeasonNumber", "status", "releaseDate", "releaseYear", "sourceUrl"]
    found = A.mismatches(old, A.merge_facts(old, _facts(spark, d)), "tmdbId", fields)
    return found.select(F.col("key").alias("tmdbId"), F.array_join("changed_fields", ",").alias("fields"))


_FACT = "tmdbId int, title string, nextSeasonNumber int, status string, releaseDate date, releaseYear int, sourceName string, sourceUrl string, announcementDate date, rule string, dateRevision boolean, ord long"
_MERGES = [
    # case, old (season, status, day), facts (season, status, day, announced, rule, revision), outcome, season, status, day
    ("G1", None, [(4, "RENEWED", None, "2026-01-01", "explicit-renewal", False), (4, "RELEASE_DATE_CONFIRMED", "2026-10-16", "2026-02-01", "explicit-premiere", False)], "changed 4 RENEWED 2026-10-16"),
    ("G2", None, [(4, "RELEASE_DATE_CONFIRMED", "2026-10-16", "2026-02-01", "explicit-premiere", False), (4, "RELEASE_DATE_CONFIRMED", "2026-11-16", "2026-03-01", "explicit-premiere", False)], "conflicting dates"),
    ("G3", None, [(4, "RELEASE_DATE_CONFIRMED", "2026-10-16", "2026-02-01", "explicit-premiere", False), (4, "RELEASE_DATE_CONFIRMED", "2026-11-16", "2026-03-01", "explicit-premiere", True)], "changed 4 RELEASE_DATE_CONFIRMED 2026-11-16"),
    ("G4", (4, "RELEASE_DATE_CONFIRMED", "2026-10-16"), [(4, "RELEASE_DATE_CONFIRMED", "2026-11-16", "2026-03-01", "explicit-premiere", False)], "conflicting dates 4 RELEASE_DATE_CONFIRMED 2026-10-16"),
    ("G5", None, [(4, "CANCELED", None, "2026-01-01", "explicit-cancellation", False), (4, "RELEASE_DATE_CONFIRMED", "2026-10-16", "2026-02-01", "explicit-premiere", False)], "changed 4 CANCELED"),
    ("G6", (4, "FINAL_SEASON", None), [(4, "RELEASE_DATE_CONFIRMED", "2026-10-16", "2026-02-01", "explicit-premiere", False)], "changed 4 FINAL_SEASON 2026-10-16"),
    ("G7", (2, "RENEWED", None), [(3, "RENEWED", None, "2026-01-01", "explicit-renewal", False), (2, "RELEASE_DATE_CONFIRMED", "2026-05-05", "2026-02-01", "explicit-premiere", False)], "changed 3 RENEWED"),
    ("G10", (4, "RENEWED", None), [(4, "RENEWED", None, "2026-01-01", "explicit-renewal", False)], "unchanged 4 RENEWED"),
    ("G11", (4, "RENEWED", "2026-10-16"), [(4, "RENEWED", None, "2026-01-01", "explicit-release-year", False)], "conflicting years 4 RENEWED 2026-10-16"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{want}'), ('{c} backwards', '{want}')" for c, _, _, want in _MERGES) + ") AS t(case_id, record)")
def merge_cases(spark: SparkSession, d: str) -> DataFrame:
    """The merge cases of the fixtures, their facts in both orders."""
    import datetime as dt

    names, old, facts = [], [], []
    for case, was, said, _ in _MERGES:
        for way in ("", " backwards"):
            key = len(names)
            names.append((key, case + way))
            if was:
                day = dt.date.fromisoformat(was[2]) if was[2] else None
                old.append((key, "t", was[0], was[1], day, day.year if day else None, "s", "https://o", None, "r", False, 0))
            for ord_, (season, status, day, announced, rule, revised) in enumerate(said if not way else said[::-1]):
                on = dt.date.fromisoformat(day) if day else None
                year = on.year if on else 2027 if rule == "explicit-release-year" else None
                facts.append((key, "t", season, status, on, year, "s", f"https://{rule}", dt.date.fromisoformat(announced), rule, revised, ord_))
    merged = A.merge_facts(spark.createDataFrame(old, _FACT), spark.createDataFrame(facts, _FACT))
    told = F.concat_ws(" ", "outcome", F.col("nextSeasonNumber").cast("string"), "status", F.col("releaseDate").cast("string"))
    return spark.createDataFrame(names, "k int, case_id string").join(merged, F.col("k") == F.col("tmdbId")).select("case_id", told.alias("record"))
