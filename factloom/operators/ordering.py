"""Windows: strongest row, versions, rotation, rolling counts, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. Works as an aggregation, map-side first.

    ``order`` gives columns of which the greatest wins, nulls least.
    """
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("row")).select(key, "row.*")


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int | Mapping[str, int]) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle too.

    ``k`` may give another number for each group; groups that it doesn't name have none.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    if isinstance(k, int):
        return rows.withColumn("place", place).where(F.col("place") <= k)
    limits = F.create_map(*[x for name, n in k.items() for x in (F.lit(name), F.lit(n))])
    top = rows.where(F.col(group).isin(*k)).withColumn("place", place).where(F.col("place") <= max(k.values()))
    return top.where(F.col("place") <= F.try_element_at(limits, F.col(group)))


def version_gate(payloads: DataFrame, key: str, arrival: str, version: str, block: Column | None = None) -> DataFrame:
    """Each payload against the greatest version that came before: NEWER, SAME or OLDER; NEWER if first.

    ``block`` cuts the arrivals of a key into stretches that follow one another (a day, say), so that a key with very many
    payloads is spread: a maximum for each stretch, a running maximum over the stretches, and one within each.
    """
    earlier = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    if block is None:
        told = payloads.withColumn("_seen", F.max(version).over(earlier))
    else:
        cut = payloads.withColumn("_block", block)
        most = cut.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at")).agg(F.max(version).alias("_most"))
        before = most.withColumn("_before", F.max("_most").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)))
        within = Window.partitionBy(key, "_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
        met = cut.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
        told = met.withColumn("_seen", F.greatest("_before", F.max(version).over(within))).drop("_key", "_at", "_most", "_before", "_block")
    seen = F.col("_seen")
    verdict = F.when(seen.isNull() | (F.col(version) > seen), "NEWER").when(F.col(version) == seen, "SAME").otherwise("OLDER")
    return told.withColumn("verdict", verdict).drop("_seen")


def rotation(ids: DataFrame, id_column: str, day_number: int, stride: int, limit: int) -> DataFrame:
    """The ``limit`` ids whose turn it is: a start that moves by ``stride`` a day over the sorted ids, round and round.

    Positions come from counts per range partition and a running number within it, so the ids are never
    sorted in one task.
    """
    spread = ids.select(id_column).where(F.col(id_column).isNotNull()).distinct().repartitionByRange(id_column).sortWithinPartitions(id_column)
    numbered = spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    placed = numbered.join(offsets.withColumn("total", total), "part")
    turn = F.pmod(F.col("before") + F.col("at") - F.pmod(F.lit(day_number * stride), F.col("total")), F.col("total"))
    return placed.withColumn("turn", turn).where(F.col("turn") < limit).select(id_column, "turn")


def rolling_count(events: DataFrame, key: str, at: Column, width: int, block: int | None = None) -> DataFrame:
    """Events with ``in_window``: those of the key in the last ``width`` units, both ends counted.

    Time is cut into blocks of ``block`` units, at least ``width`` (24 times that if none is given). An event is also sent to the
    next block, so that each finds its window in its own block and a hot key is spread over as many groups as it has blocks.
    """
    block = block or 24 * width
    if block < width:
        raise ValueError("a block must be at least as long as the window")
    here = F.floor(F.col("_at") / block)
    sent = events.withColumn("_at", at).withColumn("_here", here).withColumn("_block", F.explode(F.array(F.col("_here"), F.col("_here") + 1)))
    near = sent.where((F.col("_block") == F.col("_here")) | (F.col("_at") >= F.col("_block") * block - width))
    window = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-width, 0)
    return near.withColumn("in_window", F.count("*").over(window)).where("_block = _here").drop("_at", "_here", "_block")


def settled(events: DataFrame, key: str, at: Column, tie: str, quiet: int, block: int | None = None) -> DataFrame:
    """Events that are followed by none of the same key for more than ``quiet`` units (debounce).

    In blocks of time as :func:`rolling_count`; an event near the start of a block is also sent to the one before.
    """
    block = block or 24 * quiet
    if block < quiet:
        raise ValueError("a block must be at least as long as the pause")
    sent = events.withColumn("_at", at).withColumn("_here", F.floor(F.col("_at") / block)).withColumn("_block", F.explode(F.array(F.col("_here"), F.col("_here") - 1)))
    near = sent.where((F.col("_block") == F.col("_here")) | (F.col("_at") <= (F.col("_block") + 1) * block + quiet))
    following = F.lead("_at").over(Window.partitionBy(key, "_block").orderBy("_at", tie))
    told = near.withColumn("_next", following).where("_block = _here").where(F.col("_next").isNull() | (F.col("_next") - F.col("_at") > quiet))
    return told.drop("_at", "_here", "_block", "_next")
