"""Constraints as queries for the rows that break them; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses of a record.
STATUSES = ("RENEWED", "RELEASE_DATE_CONFIRMED", "FINAL_SEASON", "CANCELED")

RECORD_RULES: dict[str, Column | str] = {
    "id": "tmdbId > 0",
    "season": "nextSeasonNumber > 0",
    "status": f"status in {STATUSES}",
    "year": "releaseDate is null or releaseYear <=> year(releaseDate)",
    "dated": "not (status <=> 'RELEASE_DATE_CONFIRMED') or releaseDate is not null",
    "url": "startswith(sourceUrl, 'https://')",
}


def violations(rows: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """(rule, key) for each rule that a row breaks, in one pass; a rule that comes out null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), key)


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key is one."""
    return rows.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def mass_change(changes: DataFrame, unit: str, most: int) -> DataFrame:
    """Changes of each unit (a run, a snapshot) and whether they are too many to be let through."""
    return changes.groupBy(unit).agg(F.count("*").alias("changes")).withColumn("blocked", F.col("changes") > most)


def publication_boundary(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], old_log: DataFrame, new_log: DataFrame, ids: int = 1, lines: int = 1) -> DataFrame:
    """What a publication did beyond its bounds, as rows (rule, n): none if it is well.

    It may change, add or remove ``ids`` keys and append ``lines`` to the log (position, line); "log lines lost" counts lines of
    the old log that the new one has not or has otherwise. Both tables have unique keys, logs unique positions.
    """
    from factloom.operators.joins import version_diff

    changed = version_diff(old, new, key, fields).agg(F.count("*").alias("n")).where(F.col("n") != ids)
    kept = old_log.select("position", "line").join(new_log.select("position", F.col("line").alias("_new")), "position", "left")
    lost = kept.agg(F.count_if(~F.col("line").eqNullSafe(F.col("_new"))).alias("n")).where("n > 0")
    added = new_log.join(old_log.select("position"), "position", "left_anti").agg(F.count("*").alias("n")).where(F.col("n") != lines)
    parts = (("changed ids", changed), ("log lines lost", lost), ("log lines added", added))
    return parts[0][1].select(F.lit(parts[0][0]).alias("rule"), "n").unionByName(parts[1][1].select(F.lit(parts[1][0]).alias("rule"), "n")).unionByName(parts[2][1].select(F.lit(parts[2][0]).alias("rule"), "n"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, change) of two manifests (path, sha256) that were added, removed or changed."""
    from factloom.operators.joins import version_diff

    return version_diff(old, new, "path", ["sha256"]).select(F.col("key").alias("path"), "change")


def is_appended(old_log: str, new_log: str, lines: int = 1) -> bool:
    """Whether a log grew by exactly so many lines and kept what it had."""
    return new_log.startswith(old_log) and new_log[len(old_log) :].count("\n") == lines and new_log.endswith("\n")
