"""History of changing attributes as presence bitmaps.

An entity's observations are numbered in order of time. For each pair of entity and attribute value
a bitmap has one bit per observation, set where the value held. A maximal run of set bits is a
validity interval; an observation at which the value did not hold leaves a zero and so ends the run.

Layout: the timeline is cut into blocks of ``block`` time units and each bitmap into 64-bit words,
keyed by (entity, block, value, word). A block holds at most ``block`` instants of one entity
whatever the number of delivered rows, so that an entity with a third of all rows is spread over
as many tasks as it has blocks. Runs that cross a block's edge are joined from one small row
per entity and block. The runs are written to the shared folder, since they are looked at twice, for
the edges and for what lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import scratch

WORD = 64
DAY = 86_400


def strip_outer(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def last_of_chain(edges: Column) -> Column:
    """The state in which a set of simultaneous transitions ends.

    ``edges`` is an array of distinct structs (o, n). Each transition starts where another one
    ended, so the end is the state that is entered once more than it is left. Transitions from
    a state to itself are ignored beside others. If they form a closed circle, they end where they
    began: null, meaning that the state stays as it was. Of several ends (a transition is missing)
    the greatest is taken.
    """
    moves = F.filter(edges, lambda e: ~e["o"].eqNullSafe(e["n"]))
    ends = F.filter(
        F.array_distinct(F.transform(moves, lambda e: e["n"])),
        lambda s: F.size(F.filter(moves, lambda e: e["n"] == s)) > F.size(F.filter(moves, lambda e: e["o"].eqNullSafe(s))),
    )
    return F.when(F.size(moves) == 0, F.array_max(F.transform(edges, lambda e: e["n"]))).otherwise(F.array_max(ends))


def states_by_instant(changes: DataFrame, entity: str, instant: str, old: str, new: str) -> DataFrame:
    """One row (entity, t, state) per instant at which an entity's state is known.

    Rows without entity, instant or new state are left out. Repeated rows count once: the set of
    transitions of an instant is built map-side, so repeats never reach the shuffle, and the
    shuffle is on (entity, instant), which spreads an entity that has many rows.
    """
    edges = changes.select(
        F.col(entity).alias("entity"), F.col(instant).cast("long").alias("t"),
        F.struct(F.upper(strip_outer(F.col(old))).alias("o"), F.upper(strip_outer(F.col(new))).alias("n")).alias("e"),
    ).where("entity is not null and t is not null and e.n is not null")
    grouped = edges.groupBy("entity", "t").agg(F.collect_set("e").alias("edges"))
    single = F.col("edges")[0]["n"]
    state = F.when(F.size("edges") == 1, single).otherwise(last_of_chain(F.col("edges")))
    return grouped.select("entity", "t", state.alias("state")).where("state is not null")


def bitmap_runs(observed: DataFrame, block: int = DAY) -> DataFrame:
    """Starts of the runs of set bits within each (entity, block): entity, block, t, state."""
    by_block = observed.withColumn("block", F.floor(F.col("t") / block)).repartition("entity", "block")
    ordinal = F.row_number().over(Window.partitionBy("entity", "block").orderBy("t")) - 1
    words = (
        by_block.withColumn("ordinal", ordinal)
        .withColumn("word", F.floor(F.col("ordinal") / WORD))
        .withColumn("pos", (F.col("ordinal") % WORD).cast("int"))
        .groupBy("entity", "block", "state", "word")
        .agg(F.expr("bit_or(shiftleft(1L, pos))").alias("bits"), F.collect_list(F.struct("pos", "t")).alias("at"))
    )
    before = Window.partitionBy("entity", "block", "state").orderBy("word")
    carried = (F.lag("word").over(before) == F.col("word") - 1) & (F.lag("bits").over(before) < 0)
    starts = words.withColumn("carry", F.when(carried, F.lit(1)).otherwise(F.lit(0)).cast("long")).withColumn(
        "starts", F.expr("bits & ~(shiftleft(bits, 1) | carry)")
    )
    first = F.filter("at", lambda x: F.call_function("getbit", F.col("starts"), x["pos"]) == 1)
    return starts.select("entity", "block", "state", F.explode(F.transform(first, lambda x: x["t"])).alias("t"))


def marked_runs(runs: DataFrame) -> DataFrame:
    """Run starts with their place in the (entity, block), the next one's instant, and the last one of the block; no shuffle."""
    by_block = Window.partitionBy("entity", "block")
    return runs.select(
        "entity", "block", "t", "state", F.row_number().over(by_block.orderBy("t")).alias("place"), F.lead("t").over(by_block.orderBy("t")).alias("next"),
        F.count("*").over(by_block).alias("n"), F.max(F.struct("t", "state")).over(by_block).alias("tail"),
    )


def join_blocks(marked: DataFrame) -> DataFrame:
    """Validity intervals (entity, state, valid_from, valid_to) from the run starts of all blocks.

    valid_to is the start of the entity's next interval and null for its last one. A run that goes on from the block before
    starts no interval. All that depends on other blocks is the first and the last run of a block, so
    one row for each block goes through a window by entity; what lies between them comes out as it is.
    """
    between = marked.where("place > 1 and place < n").select("entity", "state", F.col("t").alias("valid_from"), F.col("next").alias("valid_to"))
    edge = marked.where("place = 1")
    by_entity = Window.partitionBy("entity").orderBy("block")
    backwards = Window.partitionBy("entity").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    told = (
        edge.withColumn("goes_on", F.coalesce(F.lag("tail.state").over(by_entity) == F.col("state"), F.lit(False)))
        .withColumn("opens", F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("t")))
        .withColumn("later", F.last("opens", ignorenulls=True).over(backwards))
    )
    first = F.when(~F.col("goes_on"), F.struct("state", F.col("t").alias("valid_from"), F.coalesce("next", "later").alias("valid_to")))
    last = F.when(F.col("n") > 1, F.struct(F.col("tail.state").alias("state"), F.col("tail.t").alias("valid_from"), F.col("later").alias("valid_to")))
    return between.unionByName(told.select("entity", F.inline(F.array_compact(F.array(first, last)))))


def state_history(changes: DataFrame, entity: str, instant: str, old: str, new: str, block: int = DAY) -> DataFrame:
    """Longest periods in which each entity keeps one state, from a feed of state changes.

    Returns entity, state, valid_from, valid_to (seconds; null while the period lasts). A row whose
    new state is null leaves the state as it is. Empty input gives no rows; columns other than the
    four named ones are not looked at, so clashing names do no harm.
    """
    marked = marked_runs(bitmap_runs(states_by_instant(changes, entity, instant, old, new), block))
    at = scratch(changes.sparkSession, "history")
    marked.write.parquet(at)
    return join_blocks(changes.sparkSession.read.schema(marked.schema).parquet(at))


def snapshot_history(snapshots: DataFrame, snapshot: str, entity: str, attribute: str) -> DataFrame:
    """Validity intervals of an attribute from periodic full snapshots.

    One bit per snapshot for each (entity, value), numbered by the snapshots' rank. Returns entity,
    state, first_snapshot, last_snapshot for each run of consecutive snapshots that show the value.
    A snapshot in which the entity is missing or shows another value ends the run; null is a value.
    Several values in one snapshot each get their own bit. Rows without entity or snapshot are left
    out. The list of snapshots is joined by rank; its size is the number of deliveries.
    """
    rows = snapshots.select(
        F.col(entity).alias("entity"), F.col(snapshot).alias("snapshot"), F.col(attribute).alias("state")
    ).where("entity is not null and snapshot is not null")
    ranks = rows.groupBy("snapshot").count().select("snapshot", (F.row_number().over(Window.orderBy("snapshot")) - 1).alias("n"))
    words = (
        rows.join(ranks, "snapshot")
        .withColumn("word", F.floor(F.col("n") / WORD))
        .groupBy("entity", "state", "word")
        .agg(F.expr("bit_or(shiftleft(1L, cast(n % 64 as int)))").alias("bits"))
    )
    around = Window.partitionBy("entity", "state").orderBy("word")
    below = (F.lag("word").over(around) == F.col("word") - 1) & (F.lag("bits").over(around) < 0)
    above = (F.lead("word").over(around) == F.col("word") + 1) & (F.lead("bits").over(around) % 2 != 0)
    edges = (
        words.withColumn("lo", F.when(below, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        .withColumn("hi", F.when(above, F.expr("shiftleft(1L, 63)")).otherwise(F.lit(0).cast("long")))
        .withColumn("starts", F.expr("bits & ~(shiftleft(bits, 1) | lo)"))
        .withColumn("ends", F.expr("bits & ~(shiftrightunsigned(bits, 1) | hi)"))
    )

    def places(mask: str) -> Column:
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", F.col(mask), i) == 1),
            lambda i: F.col("word") * WORD + i,
        )

    numbered = edges.select("entity", "state", F.explode(F.concat(
        F.transform(places("starts"), lambda p: F.struct(p.alias("n"), F.lit(0).alias("end"))),
        F.transform(places("ends"), lambda p: F.struct(p.alias("n"), F.lit(1).alias("end"))),
    )).alias("x")).select("entity", "state", "x.n", "x.end")
    order = Window.partitionBy("entity", "state").orderBy("n", "end")
    pairs = numbered.withColumn("last", F.lead("n").over(order)).where("end = 0")
    return (
        pairs.join(ranks.select(F.col("n"), F.col("snapshot").alias("first_snapshot")), "n")
        .join(ranks.select(F.col("n").alias("last"), F.col("snapshot").alias("last_snapshot")), "last")
        .select("entity", "state", "first_snapshot", "last_snapshot")
    )
