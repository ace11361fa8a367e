"""Facts merged into records, promoted, and compared with what is stored.

A fact has tmdbId, title, nextSeasonNumber, status, releaseDate, releaseYear, sourceName, sourceUrl, announcementDate, rule,
dateRevision and ord, the place in which it came. Facts of a series are put in order by season, strength of the status,
whether they have a date, and announcement, each the greater first; ties stay in the order in which they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strength of the statuses; rules that give a date or a year and no decision about a season.
STRENGTH = {"CANCELED": 4, "FINAL_SEASON": 3, "RENEWED": 1, "RELEASE_DATE_CONFIRMED": 0}
DATES_ONLY = ("explicit-premiere", "explicit-release-year")
#: What makes a record new.
COMPARED = ("nextSeasonNumber", "status", "releaseDate", "releaseYear")
SOURCE = ("title", "sourceName", "sourceUrl", "announcementDate", "rule")


def strength(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in STRENGTH.items() for x in (F.lit(k), F.lit(v))]), status), F.lit(0))


def _place() -> Column:
    """Sorts a season's facts: the greatest comes first."""
    return F.struct(strength(F.col("status")), F.col("releaseDate").isNotNull(), F.coalesce(F.col("announcementDate"), F.lit("0001-01-01").cast("date")), -F.col("ord"))


def merge_facts(old: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each series of ``old`` (unique tmdbId) or ``facts``: its record and what became of it.

    ``outcome`` is changed, unchanged, or a conflict: of dates, if facts of the season (or the old record) give several
    days and no explicit revision is newer than all others; of years, if a year without a day contradicts the old record.
    A conflict and an unchanged record leave the old one. Facts of seasons before the old one's don't count.

    * The status is that of the first lifecycle fact; without one the old one's, else that of the first fact. Of the
      same season final and canceled stay, and a confirmed date isn't lost to a renewal.
    * A canceled season has no date; a confirmed date without a date becomes a renewal.
    * The source is the fact that proves the status, or the old record if that proves it already.

    Facts are combined map-side by (series, season, day) first, so a series with very many of them sends a row for
    each day it names; the second step is on (series, season), the join with the old record on the series.
    Rows without tmdbId, season or status don't count. ``supporting`` joins the other URLs, in order.
    """
    said = facts.where("tmdbId is not null and nextSeasonNumber is not null and status is not null")
    fact = F.struct("status", "releaseDate", "releaseYear", *SOURCE)
    life, dated, yeared, revision = ~F.col("rule").isin(*DATES_ONLY), F.col("releaseDate").isNotNull(), F.col("releaseYear").isNotNull(), F.col("dateRevision") & F.col("releaseDate").isNotNull() & F.col("announcementDate").isNotNull()
    far = F.lit("9999-12-31").cast("date")

    def first(cond: Column) -> Column:
        return F.max(F.when(cond, F.struct(_place().alias("place"), fact.alias("fact"))))

    by_day = said.groupBy("tmdbId", "nextSeasonNumber", "releaseDate").agg(
        first(F.lit(True)).alias("top"), first(life).alias("life"), first(yeared).alias("yeared"),
        F.max(F.when(revision, F.struct(F.col("announcementDate").alias("at"), _place().alias("place"), fact.alias("fact")))).alias("revision"),
        F.max(F.coalesce("announcementDate", far)).alias("latest"), F.collect_set("sourceUrl").alias("urls"),
    )
    by_season = by_day.groupBy("tmdbId", "nextSeasonNumber").agg(
        F.max("top").alias("top"), F.max("life").alias("life"), F.max("yeared").alias("yeared"), F.max(F.when(dated, F.col("top"))).alias("dated"), F.max("revision").alias("revision"),
        F.collect_list(F.when(dated, F.struct(F.col("releaseDate").alias("day"), "latest"))).alias("days"), F.array_distinct(F.flatten(F.collect_list("urls"))).alias("urls"),
    )
    newest = by_season.groupBy(F.col("tmdbId").alias("key")).agg(F.max_by(F.struct("*"), "nextSeasonNumber").alias("n"))
    held = old.where("tmdbId is not null").select(F.col("tmdbId").alias("old_key"), F.struct("tmdbId", *COMPARED, *(c for c in SOURCE if c != "rule")).alias("o"))
    both = held.join(newest, F.col("old_key") == F.col("key"), "full")
    season, has_old = F.col("n.nextSeasonNumber"), F.col("o").isNotNull()
    same = has_old & (F.col("o.nextSeasonNumber") == season)
    same = F.coalesce(same, F.lit(False))
    life_status, sticky = F.col("n.life.fact.status"), F.col("o.status").isin("FINAL_SEASON", "CANCELED")
    status = (
        F.when(same & sticky, F.col("o.status"))
        .when(same & (F.col("o.status") == "RELEASE_DATE_CONFIRMED") & (life_status.isNull() | (life_status == "RENEWED")), F.col("o.status"))
        .when(same, F.coalesce(life_status, F.col("o.status"))).otherwise(F.coalesce(life_status, F.col("n.top.fact.status")))
    )
    days = F.when(same & F.col("o.releaseDate").isNotNull(), F.concat("n.days", F.array(F.struct(F.col("o.releaseDate").alias("day"), F.coalesce(F.col("o.announcementDate"), far).alias("latest"))))).otherwise(F.col("n.days"))
    revised = F.col("n.revision.fact")
    several = F.size(F.array_distinct(F.transform("days", lambda x: x["day"]))) > 1
    beaten = revised.isNull() | F.exists("days", lambda x: (x["day"] != revised["releaseDate"]) & (x["latest"] >= revised["announcementDate"]))
    dated_fact = F.when(several, revised).otherwise(F.col("n.dated.fact"))
    year_only = F.col("n.yeared.fact.releaseYear")
    other_year = (
        F.col("dated").isNull() & same & year_only.isNotNull()
        & (F.coalesce(year_only != F.year("o.releaseDate"), F.lit(False)) | F.coalesce(year_only != F.col("o.releaseYear"), F.lit(False)))
    )
    told = both.withColumn("days", days).withColumn("dated", dated_fact).withColumn("said", status)
    day = F.coalesce(F.col("dated.releaseDate"), F.when(same, F.col("o.releaseDate")))
    told = told.withColumn("day", F.when(F.col("said") != "CANCELED", day))
    told = told.withColumn("final", F.when((F.col("said") == "RELEASE_DATE_CONFIRMED") & F.col("day").isNull(), "RENEWED").otherwise(F.col("said")))
    year = F.when(F.col("said") == "CANCELED", None).when(F.col("day").isNotNull(), F.year("day")).otherwise(F.coalesce(year_only, F.when(same, F.col("o.releaseYear"))))
    keeps = same & (F.col("o.status") == F.col("final")) & (
        (F.col("final").isin("FINAL_SEASON", "CANCELED") & (life_status.isNull() | (life_status != F.col("final")))) | life_status.isNull()
    )
    from_old = F.struct(*[(F.col(f"o.{c}") if c != "rule" else F.lit("previous-status-evidence")).alias(c) for c in SOURCE])
    picked = F.coalesce(F.col("n.life.fact"), F.col("dated"), F.col("n.top.fact"))
    source = F.when(keeps, from_old).otherwise(F.struct(*[picked[c].alias(c) for c in SOURCE]))
    stale = F.col("n").isNull() | F.coalesce(season < F.col("o.nextSeasonNumber"), F.lit(False))
    unchanged = has_old & F.col("o.nextSeasonNumber").eqNullSafe(season) & F.col("o.status").eqNullSafe(F.col("final")) & F.col("o.releaseDate").eqNullSafe(F.col("day")) & F.col("o.releaseYear").eqNullSafe(F.col("year"))
    told = told.withColumn("year", year).withColumn("source", source)
    outcome = F.when(stale, "unchanged").when(several & beaten, "conflicting dates").when(other_year, "conflicting years").when(unchanged, "unchanged").otherwise("changed")
    told = told.withColumn("outcome", outcome)
    new = F.col("outcome") == "changed"
    others = F.array_join(F.array_sort(F.filter("n.urls", lambda u: u != F.col("source.sourceUrl"))), "|")

    def value(name: str, fresh: Column) -> Column:
        return F.when(new, fresh).otherwise(F.col(f"o.{name}")).alias(name)

    return told.select(
        F.coalesce("key", "old_key").alias("tmdbId"), "outcome", value("nextSeasonNumber", season), value("status", F.col("final")), value("releaseDate", F.col("day")), value("releaseYear", F.col("year")),
        *[value(c, F.col(f"source.{c}")) for c in SOURCE if c != "rule"], F.when(new, F.col("source.rule")).alias("rule"), F.when(new, others).alias("supporting"),
    )


def promoted(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Renewed records with a day become confirmed; their source is then the first premiere fact of that season and day."""
    premiere = facts.where("rule = 'explicit-premiere' and releaseDate is not null").groupBy(F.col("tmdbId").alias("_k"), F.col("nextSeasonNumber").alias("_s"), F.col("releaseDate").alias("_d")).agg(
        F.min_by(F.struct("sourceName", "sourceUrl", "announcementDate"), "ord").alias("_p")
    )
    due = (F.col("status") == "RENEWED") & F.col("releaseDate").isNotNull()
    met = records.join(premiere, (F.col("tmdbId") == F.col("_k")) & (F.col("nextSeasonNumber") == F.col("_s")) & (F.col("releaseDate") == F.col("_d")), "left")
    moved = {c: F.when(due & F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in ("sourceName", "sourceUrl", "announcementDate")}
    return met.withColumns({**moved, "status": F.when(due, "RELEASE_DATE_CONFIRMED").otherwise(F.col("status"))}).select(*records.columns)


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the sorted names of the fields in which two tables with unique keys differ, where they do; one shuffle."""
    from factloom.operators.joins import version_diff

    return version_diff(left, right, key, fields).where("change = 'changed'").select("key", "changed_fields")
