"""A queue of pending requests as tables: admission, snapshot, completion, status, import, bounded batches."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(events: DataFrame, at: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events with ``segment``: stretches of time without a pause longer than ``width``, which have nothing to do with each other.

    Time is cut into blocks of ``width``; a run of blocks that have events is one segment. Only the distinct blocks
    are put in order, so the work is that of the time covered, not of the events.
    """
    block = F.floor(F.col(at) / width)
    occupied = events.select(*keys, block.alias("_block")).distinct()
    order = Window.partitionBy(*keys).orderBy("_block")
    opens = F.when(F.col("_block") - F.lag("_block").over(order) == 1, None).otherwise(F.col("_block"))
    runs = occupied.withColumn("_opens", opens).withColumn("segment", F.last("_opens", ignorenulls=True).over(order)).drop("_opens")
    return events.withColumn("_block", block).join(runs, [*keys, "_block"]).drop("_block")


def admission(events: DataFrame, key: str, at: str, event: str, own: int, total: int, width: float) -> DataFrame:
    """Rows (key, event, admitted, retry_after): at most ``own`` admitted events of a key and ``total`` of all within ``width`` seconds.

    The far end of the window counts. Only admitted events are remembered, so each decision depends on those before it:
    events are walked in order of time and event, one task for each stretch of time (see :func:`segments`). Memory is the
    events admitted within one window. A refused one is told when to come again, in whole seconds, at least 1. Rows with
    a null key or time are left out.
    """
    kept = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, event, F.col(at).cast("double").alias("_at"))
    ranged = segments(kept, "_at", width).repartition("segment").sortWithinPartitions("segment", "_at", event).select(key, event, "_at", "segment")
    names, kinds = [key, event, "admitted", "retry_after"], [kept.schema[key].dataType.simpleString(), kept.schema[event].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, all_, each = None, deque(), {}
        for batch in batches:
            admitted, waits = [], []
            for who, now, segment in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if segment != here:
                    here, all_, each = segment, deque(), {}
                while all_ and all_[0][0] < now - width:
                    _, gone = all_.popleft()
                    theirs = each[gone]
                    theirs.popleft()
                    if not theirs:
                        del each[gone]
                mine = each.get(who, ())
                full = [q for q, most in ((all_, total), (mine, own)) if len(q) >= most]
                if full:
                    first = max(q[0][0] if q is all_ else q[0] for q in full)
                    admitted.append(False)
                    waits.append(max(1, math.ceil(first + width - now)))
                else:
                    all_.append((now, who))
                    each.setdefault(who, deque()).append(now)
                    admitted.append(True)
                    waits.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(admitted, pa.bool_()), pa.array(waits, pa.int64())], names=names)

    return ranged.mapInArrow(run, f"`{key}` {kinds[0]}, `{event}` {kinds[1]}, admitted boolean, retry_after long")


def snapshot_step(pending: DataFrame, now: Column, most: int, again: Column) -> DataFrame:
    """The queue after a snapshot was handed out: all rows with ``handed_out`` and the new ``next_eligible_at``.

    ``pending`` has unique ids in tmdb_id with requested_at, next_eligible_at, completed_at. Due rows in order of
    (next_eligible_at, requested_at, tmdb_id); the first ``most`` are handed out and become due again after ``again``. Nothing
    leaves the queue. The top is taken by tasks first; it is a few rows, which are broadcast.
    """
    due = pending.where(F.col("completed_at").isNull() & (F.col("next_eligible_at") <= now))
    top = due.orderBy("next_eligible_at", "requested_at", "tmdb_id").limit(most).select(F.col("tmdb_id").alias("_id"))
    marked = pending.join(F.broadcast(top), F.col("tmdb_id") == F.col("_id"), "left").withColumn("handed_out", F.col("_id").isNotNull()).drop("_id")
    return marked.withColumn("next_eligible_at", F.when(F.col("handed_out"), now + again).otherwise(F.col("next_eligible_at")))


def conditional_complete(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """Rows (batch, tmdb_id, state) for acks (batch, tmdb_id, receipt, proof_ok) on the queue (tmdb_id, receipt, completed_at).

    One bad proof rejects its whole batch. Otherwise an ack is stale if its receipt isn't the current one or the id
    unknown, already_complete, or complete; of repeated acks in one batch each gets the same state.
    """
    batches = acks.groupBy(F.col("batch").alias("_b")).agg(F.bool_and(F.coalesce("proof_ok", F.lit(False))).alias("_good"))
    queue = pending.select(F.col("tmdb_id").alias("_id"), F.col("receipt").alias("_receipt"), F.col("completed_at").alias("_done"))
    met = acks.join(batches, F.col("batch").eqNullSafe(F.col("_b"))).join(queue, F.col("tmdb_id") == F.col("_id"), "left")
    current = F.coalesce(F.col("_receipt") == F.col("receipt"), F.lit(False))
    state = F.when(~F.col("_good"), "rejected").when(~current, "stale").when(F.col("_done").isNotNull(), "already_complete").otherwise("complete")
    return met.select("batch", "tmdb_id", state.alias("state"))


def receipt_status(pending: DataFrame, asked: DataFrame) -> DataFrame:
    """(tmdb_id, receipt, status): pending or complete; a wrong receipt can't be told from an absent id, both are unknown."""
    queue = pending.select(F.col("tmdb_id").alias("_id"), F.col("receipt").alias("_receipt"), F.col("completed_at").alias("_done"))
    met = asked.join(queue, (F.col("tmdb_id") == F.col("_id")) & (F.col("receipt") == F.col("_receipt")), "left")
    return met.select("tmdb_id", "receipt", F.when(F.col("_id").isNull(), "unknown").when(F.col("_done").isNull(), "pending").otherwise("complete").alias("status"))


def imported(pending: DataFrame, legacy: DataFrame, now: Column, horizon: Column, delay: Column, capacity: int) -> DataFrame:
    """Legacy rows (tmdb_id, at) that go into the queue: not older than ``horizon``, not in it yet, oldest first, up to its capacity.

    Capacity is that of unfinished rows. Returns tmdb_id, requested_at, next_eligible_at, the latter ``at`` plus ``delay`` but not
    before now. Room and rows are counted in tasks first; the ones let in are at most ``capacity``.
    """
    room = pending.agg((F.lit(capacity) - F.count_if(F.col("completed_at").isNull())).alias("room"))
    fresh = legacy.where(F.col("tmdb_id").isNotNull() & (F.col("at") >= now - horizon)).groupBy("tmdb_id").agg(F.min("at").alias("at"))
    waiting = fresh.join(pending.select("tmdb_id"), "tmdb_id", "left_anti").orderBy("at", "tmdb_id").limit(capacity)
    numbered = waiting.withColumn("_n", F.row_number().over(Window.orderBy("at", "tmdb_id")))
    let_in = numbered.join(F.broadcast(room), F.col("_n") <= F.col("room"))
    return let_in.select("tmdb_id", F.col("at").alias("requested_at"), F.greatest(now, F.col("at") + delay).alias("next_eligible_at"))


def bounded_batch(items: DataFrame, group: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Of each group the first ``most`` items in order, up to and with the first that failed; nothing after it is touched."""
    by = Window.partitionBy(group).orderBy(*order)
    first = items.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    before = F.count_if(failed).over(Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_failed", before).where("_failed = 0").drop("_failed")
