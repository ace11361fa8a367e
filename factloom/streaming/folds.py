"""Keyed folds: one step function, run over a sorted batch or over a stream with state.

A step takes the key's state (a JSON-able dict, None at first) and one event (a dict) and returns the new state
and an output dict or None. In a batch each task walks its keys in order of time and holds one state at
a time, so a key with a third of all rows costs time but no memory; its decisions depend on each other,
hence they can't be spread. In a stream the state lives in the state store.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict | None, dict], tuple[dict | None, dict | None]]


def fold(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """Outputs of ``step`` over each key's events in ``order``; rows with a null key are left out.

    ``schema`` describes the outputs, its first column is the key. Ties in ``order`` are broken by nothing, so it
    should be total. No events give no rows.
    """
    names = [part.split()[0] for part in schema.split(",")]
    ranged = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], None
                state, told = step(state, row)
                if told is not None:
                    out.append({names[0]: now, **told})
            yield pd.DataFrame(out, columns=names)

    return ranged.mapInPandas(run, schema)


#: A fold over the columns of one key's events: state and columns in, state and output columns out.
Columns = Callable[[object, dict[str, np.ndarray]], tuple[object, list]]


def fold_columns(events: DataFrame, key: str, order: list[str], step: Columns, schema: str) -> DataFrame:
    """The same over arrays: ``step`` gets the events of a key in a batch as columns and returns those of the output after the key.

    A key that reaches over several batches takes its state along. For steps that can skip events or need no Python for each.
    """
    names = [part.split()[0] for part in schema.split(",")]
    kept = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            keys = columns[key]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            out: list[list] = [[] for _ in names]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != now:
                    now, state = keys[a], None
                state, told = step(state, {n: c[a:b] for n, c in columns.items()})
                for column, part in zip(out, [keys[a:b], *told], strict=True):
                    column.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return kept.mapInArrow(run, schema)


def cool_down_columns(seconds: float, at: str = "t", event: str = "event_id") -> Columns:
    """:func:`cool_down` over arrays: from one accepted event the next is found by bisection, the ones between are never touched."""

    def step(last, columns):
        times, accepted = columns[at], np.zeros(len(columns[at]), dtype=bool)
        i = 0 if last is None else int(np.searchsorted(times - last, seconds, side="left"))
        while i < len(times):
            accepted[i], last = True, times[i]
            i = i + 1 + int(np.searchsorted(times[i + 1 :] - last, seconds, side="left"))
        return last, [columns[event], accepted]

    return step


def rate_limit_columns(limit: int, window: float, at: str = "t", event: str = "event_id") -> Columns:
    """:func:`rate_limit` over arrays; only the last ``limit`` admitted times matter."""

    def step(kept, columns):
        kept = deque() if kept is None else kept
        times = columns[at].tolist()
        admitted, waits = np.zeros(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
        for i, now in enumerate(times):
            while kept and kept[0] < now - window:
                kept.popleft()
            if len(kept) < limit:
                kept.append(now)
                admitted[i] = True
            else:
                waits[i] = max(1, math.ceil(kept[0] + window - now))
        return kept, [columns[event], admitted, waits]

    return step


def rolling_quota_columns(limit: int, window: float, slack: float = 1.0, at: str = "t", event: str = "event_id") -> Columns:
    """:func:`rolling_quota` over arrays of times that don't go back."""

    def step(kept, columns):
        kept = deque() if kept is None else kept
        times = columns[at].tolist()
        granted, delays = np.zeros(len(times), dtype=bool), np.zeros(len(times))
        for i, now in enumerate(times):
            while kept and kept[0] <= now - window:
                kept.popleft()
            if len(kept) < limit:
                kept.append(now)
                granted[i] = True
            else:
                delays[i] = kept[0] + window + slack - now
        return kept, [columns[event], granted, delays]

    return step


class _Fold(StatefulProcessor):
    def __init__(self, step: Step, names: list[str], order: list[str]) -> None:
        self.step, self.names, self.order = step, names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = self.kept.get()
        state = json.loads(held[0]) if held else None
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            state, told = self.step(state, row)
            if told is not None:
                out.append({self.names[0]: key[0], **told})
        if state is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The same over a stream. Events of a batch are put in order; one that arrives in a later batch is late.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    names = [part.split()[0] for part in schema.split(",")]
    return events.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(
        _Fold(step, names, order), schema, "Append", "None"
    )


def rate_limit(limit: int, window: float, at: str = "t", event: str = "event_id") -> Step:
    """Admit an event if fewer than ``limit`` admitted ones lie within ``window`` seconds, its far end included.

    Only admitted events count later. A refused one is told when to come again, in whole seconds, at least 1.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        now = row[at]
        kept = [x for x in (state or {}).get("kept", []) if x >= now - window]
        admitted = len(kept) < limit
        wait = 0 if admitted else max(1, math.ceil(kept[0] + window - now))
        return {"kept": [*kept, now] if admitted else kept}, {event: row[event], "admitted": admitted, "retry_after": wait}

    return step


def cool_down(seconds: float, at: str = "t", event: str = "event_id") -> Step:
    """Accept an event if the last accepted one is at least ``seconds`` old; repeats don't prolong the pause."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        last = (state or {}).get("last")
        accepted = last is None or row[at] - last >= seconds
        return {"last": row[at] if accepted else last}, {event: row[event], "accepted": accepted}

    return step


def rolling_quota(limit: int, window: float, slack: float = 1.0, at: str = "t", event: str = "event_id") -> Step:
    """At most ``limit`` in ``window`` seconds; a refused event is told the delay until one falls out, plus ``slack``.

    Remembered times in the future (a clock that went back) are dropped.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        now = row[at]
        kept = [x for x in (state or {}).get("kept", []) if now - window < x <= now][-limit:]
        granted = len(kept) < limit
        delay = 0.0 if granted else kept[0] + window + slack - now
        return {"kept": [*kept, now] if granted else kept}, {event: row[event], "granted": granted, "delay": delay}

    return step


def newest_version(version: str = "version", event: str = "event_id") -> Step:
    """Take an event if its version is greater than all before; else tell whether it is the same or older."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        seen = (state or {}).get("version")
        verdict = "NEWER" if seen is None or row[version] > seen else "SAME" if row[version] == seen else "OLDER"
        return {"version": row[version] if verdict == "NEWER" else seen}, {event: row[event], "verdict": verdict}

    return step


def pending_set(delay: float = 600.0, at: str = "t", kind: str = "kind", receipt: str = "receipt") -> Step:
    """A keyed queue entry: submit, snapshot and complete events.

    A submit opens the entry or, while it is pending, replaces its receipt only. A snapshot hands it out if it
    is due and makes it due again after ``delay``. A complete with the current receipt closes it, with another one
    it is stale, on a closed entry it has no effect.
    """

    def step(state: dict | None, row: dict) -> tuple[dict | None, dict]:
        now, what = row[at], row[kind]
        if what == "submit":
            if state is None or state["done"] is not None:
                state = {"since": now, "due": now, "done": None}
            state = {**state, "receipt": row[receipt]}
            return state, {"t": now, "outcome": "pending"}
        if state is None:
            return None, {"t": now, "outcome": "unknown"}
        if what == "snapshot":
            due = state["done"] is None and state["due"] <= now
            return ({**state, "due": now + delay} if due else state), {"t": now, "outcome": "handed_out" if due else "not_due"}
        if state["done"] is not None:
            return state, {"t": now, "outcome": "already_complete"}
        if state["receipt"] != row[receipt]:
            return state, {"t": now, "outcome": "stale"}
        return {**state, "done": now}, {"t": now, "outcome": "complete"}

    return step


def pending_entry(delay: float = 600.0, at: str = "t", event: str = "event_id") -> Step:
    """:func:`pending_set` with the event's own id as a submit's receipt; a complete brings the current one unless it is ``wrong``."""
    inner = pending_set(delay, at)

    def step(state: dict | None, row: dict) -> tuple[dict | None, dict]:
        brought = row[event] if row["kind"] == "submit" or state is None else -1 if row["wrong"] else state["receipt"]
        state, told = inner(state, {**row, "receipt": brought})
        return state, {event: row[event], "outcome": told["outcome"]}

    return step


def obligation(pause: float = 86_400.0, at: str = "t", event: str = "event_id") -> Step:
    """An obligation's phases: prepare, activate, submitted (with a receipt, or without as the old protocol has it), told, verified.

    PREPARED, SUBMIT, RECEIPT, CANONICAL, then nothing. Without a receipt it is LEGACY; told three times that
    nothing came of it, it is submitted anew, due after ``pause``. An event that doesn't fit the phase changes nothing; a
    second prepare joins the first.
    """

    def step(state: dict | None, row: dict) -> tuple[dict | None, dict]:
        phase, what = (state or {}).get("phase", ""), row["kind"]
        if what == "prepare" and state is None:
            state = {"phase": "PREPARED", "due": row[at], "tries": 0}
        elif what == "activate" and phase == "PREPARED":
            state = {**state, "phase": "SUBMIT", "due": row[at]}
        elif what == "submitted" and phase == "SUBMIT":
            state = {**state, "phase": "LEGACY" if row["receipt"] is None else "RECEIPT", "receipt": row["receipt"]}
        elif what == "told" and phase == "RECEIPT":
            state = {**state, "phase": "CANONICAL"}
        elif what == "told" and phase == "LEGACY":
            tries = (state["tries"] + 1) % 3
            state = {**state, "tries": tries, **({} if tries else {"phase": "SUBMIT", "due": row[at] + pause})}
        elif what == "verified" and phase == "CANONICAL":
            state = None
        return state, {event: row[event], "phase": (state or {}).get("phase", "")}

    return step


def tumbling_counts(events: DataFrame, at: str, label: str, width: str, late: str | None = None) -> DataFrame:
    """Counts of each label in windows of ``width``; for streams with the watermark ``late``."""
    marked = events.withWatermark(at, late) if late else events
    counted = marked.groupBy(F.window(at, width), label).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), label, "n")


def sliding_counts(events: DataFrame, at: str, width: str, slide: str, late: str | None = None) -> DataFrame:
    marked = events.withWatermark(at, late) if late else events
    return marked.groupBy(F.window(at, width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each key, ended by a pause of ``gap``."""
    marked = events.withWatermark(at, late) if late else events
    grouped = marked.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), "n")


def drop_repeats(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Stream without repeats of a key that arrive within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def watch_view(tracked: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """A stream (or table) of tracked series with the columns of dimensions beside them, null where there is nothing.

    Each dimension is (table, column of ``tracked``, key of the table, which must be unique). Tables that a stream is joined with are read
    anew by each batch, so the view shows them as they are by then; a stream isn't held in state for that.
    """
    out = tracked
    for table, column, key in dimensions:
        named = table.select(F.col(key).alias(f"_{key}"), *[c for c in table.columns if c != key])
        out = out.join(named, F.col(column) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return out


def expire(rows: DataFrame, at: str, now, width_seconds: int, keep=None) -> DataFrame:
    """Rows no older than ``width_seconds`` (the far end stays), and those for which ``keep`` holds."""
    young = F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(width_seconds)))
    return rows.where(young if keep is None else young | keep)
