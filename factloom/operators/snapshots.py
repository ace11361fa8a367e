"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most snapshots of which the list is broadcast.
FEW = 10_000


def row_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash of a row in which null is a value of its own (the built-in hash skips nulls)."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def _neighbours(listed: DataFrame) -> DataFrame:
    """Rows (snapshot, previous, next) of the distinct snapshots."""
    some = listed.limit(FEW + 1).collect()
    if len(some) > FEW:
        order = Window.orderBy("snapshot")
        return listed.select("snapshot", F.lag("snapshot").over(order).alias("previous"), F.lead("snapshot").over(order).alias("next"))
    names = [None, *sorted(r[0] for r in some), None]
    kind = listed.schema["snapshot"].dataType
    fields = T.StructType([T.StructField(c, kind) for c in ("snapshot", "previous", "next")])
    return F.broadcast(listed.sparkSession.createDataFrame(list(zip(names[1:-1], names, names[2:], strict=False)), fields))


def snapshot_changes(
    rows: DataFrame, snapshot: str, key: str, compared: Sequence[Column], latest: Sequence[Column]
) -> DataFrame:
    """Rows (snapshot, key, change_kind) for each difference between a snapshot and the one before it.

    Each row takes part twice, as the later side of its own snapshot and as the earlier side of the
    next one; one aggregation on (snapshot, key) keeps each side's latest row hash and classifies.
    The aggregation combines map-side, so a key or snapshot with a third of all rows shrinks to one
    row per task before the shuffle. Of several rows of a key in a snapshot that with the greatest
    ``latest`` counts (null is least); what is still equal is decided by the row hash. Rows without
    key or snapshot don't count, the first snapshot gives no rows, an empty table none.
    The list of snapshots (one entry for each delivery) is read first and broadcast if it has at most
    ``FEW`` entries, so that the rows go through the one shuffle only; a longer list is joined as Spark
    sees fit.
    """
    slim = rows.select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"),
        F.struct(*[c.alias(f"l{i}") for i, c in enumerate(latest)], row_hash(compared).alias("hash")).alias("version"),
    ).where("snapshot is not null and key is not null")
    neighbours = _neighbours(slim.select("snapshot").distinct())
    sides = F.array(
        F.struct(F.when(F.col("previous").isNotNull(), F.col("snapshot")).alias("at"), F.lit(True).alias("later")),
        F.struct(F.col("next").alias("at"), F.lit(False).alias("later")),
    )
    tagged = (
        slim.join(neighbours, "snapshot")
        .select("key", "version", F.explode(sides).alias("side"))
        .where("side.at is not null")
        .select("side.at", "key", F.when(F.col("side.later"), F.col("version")).alias("new"), F.when(~F.col("side.later"), F.col("version")).alias("old"))
    )
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.hash") != F.col("new.hash"), "changed")
    )
    return (
        tagged.groupBy("at", "key")
        .agg(F.max("new").alias("new"), F.max("old").alias("old"))
        .select(F.col("at").alias("snapshot"), "key", kind.alias("change_kind"))
        .where("change_kind is not null")
    )
