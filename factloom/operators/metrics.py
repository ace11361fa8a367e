"""Measures over cases: funnels, coverage, breakdowns, rankings, conflicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded half to even; null if the whole is 0."""
    return F.when(whole > 0, F.bround(100 * part / whole, digits))


def funnel(stages: Mapping[str, Column]) -> list[Column]:
    """Counts of rows that passed a stage and all before it; null counts as not passed."""
    out, passed = [], F.lit(True)
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return out


def breakdown(rows: DataFrame, group: str, label: str) -> DataFrame:
    """One map label -> count for each group, sorted by label; rows without label don't count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("breakdown"))


def zero_filled(rows: DataFrame, group: str, label: str, domain: Sequence[str]) -> DataFrame:
    """Counts of each label of a fixed domain, 0 where there is none."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(label) == d).alias(d.lower()) for d in domain])


def weighted_and_macro(groups: DataFrame, part: str, whole: str) -> DataFrame:
    """Coverage over all groups together, and the mean of the groups' own coverages (empty groups left out)."""
    own = F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole))
    return groups.agg(
        pct(F.sum(part), F.sum(whole)).alias("weighted_pct"), F.bround(F.avg(own), 2).alias("macro_pct"), F.count(own).alias("groups")
    )


def only_value(c: Column) -> Column:
    """The value that all rows agree on; null if they don't or there is none."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct non-null value, and the values."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def share_table(rows: DataFrame, label: str, group: str, domain: DataFrame) -> DataFrame:
    """Each label of ``domain`` with its count, sorted affected groups and share of all."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(group)).alias("affected"))
    full = domain.join(counted, label, "left").select(
        label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("affected", F.array().cast("array<string>")).alias("affected")
    )
    return full.withColumn("share_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def best_by(metric: str, name: str, highest: bool = True) -> Column:
    """The name with the greatest (or least) metric, the lesser name on ties among the least and the greater among the greatest."""
    by = F.struct(metric, name)
    return F.max_by(F.col(name), by) if highest else F.min_by(F.col(name), by)
