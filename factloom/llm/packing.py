"""Filling containers of fixed capacity: bounded-space online best-fit.

``BestFit`` keeps at most ``open_bins`` bins open. A bitset has bit f set if an open bin has f units
free, so the tightest bin for an item of size s is the lowest set bit from s on. If no open bin has
room a new one is opened; if that is one too many, the fullest (the lowest set bit of all) closes.

``pack`` runs it twice. First each task packs the rows of its own partition, without a shuffle; memory
is bounded by the open bins. Bins still open at the end of a partition then go through it once more
as whole items of the size of their content, a few bins for each first-round task, spread over
``groups`` tasks. Items are never split in that round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins open at a time, for each capacity and task.
OPEN_BINS = 128


class BestFit:
    """Bins of one capacity. ``add`` returns the bins that close, each as (content, free)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.most = capacity, open_bins
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _put(self, free: int, content: list) -> None:
        self.by_free.setdefault(free, []).append(content)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        same = self.by_free[free]
        content = same.pop()
        if not same:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return content

    def add(self, item, size: int) -> Iterator[tuple[list, int]]:
        """Put an item of a size from 0 to the capacity into the tightest bin."""
        if not 0 <= size <= self.capacity:
            raise ValueError("the item doesn't fit into any bin")
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            content = self._take(free)
        else:
            free, content = self.capacity, []
            if self.count >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                yield self._take(fullest), fullest
        content.append(item)
        if free == size:
            yield content, 0
        else:
            self._put(free - size, content)

    def close(self) -> Iterator[tuple[list, int]]:
        for free, same in self.by_free.items():
            for content in same:
                yield content, free
        self.bits, self.count, self.by_free = 0, 0, {}


def pieces(size: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, size) of an item's pieces: itself if it fits, else full ones and a rest."""
    if size <= capacity:
        yield 0, 0, size
        return
    for k, start in enumerate(range(0, size, capacity)):
        yield k, start, min(capacity, size - start)


_FIRST = "capacity_id int, capacity int, bin string, left_open boolean, fill long, id long, piece int, start long, size long"


def _first_round(capacities: dict[int, int], open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packers = {c: BestFit(size, open_bins) for c, size in capacities.items()}
        made = dict.fromkeys(capacities, 0)
        rows: list[list] = [[] for _ in range(9)]

        def out(c: int, content: list, free: int, left_open: bool) -> None:
            name = f"{c}-{task}-{made[c]}"
            made[c] += 1
            for item in content:
                for column, value in zip(rows, (c, capacities[c], name, left_open, capacities[c] - free, *item), strict=True):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ("capacity_id", "capacity", "bin", "left_open", "fill", "id", "piece", "start", "size")
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=list(names))
            for column in rows:
                column.clear()
            return batch

        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c, packer in packers.items():
                    for k, start, part in pieces(size, capacities[c]):
                        for content, free in packer.add((key, k, start, part), part):
                            out(c, content, free, False)
            if len(rows[0]) > 10_000:
                yield flush()
        for c, packer in packers.items():
            for content, free in packer.close():
                out(c, content, free, True)
        yield flush()

    return run


def _second_round(open_bins: int):
    def run(key: tuple, bins: pa.Table) -> pa.Table:
        capacity_id, capacity, group = (k.as_py() for k in key)
        packer, names, into = BestFit(capacity, open_bins), [], []
        ordered = bins.sort_by([("fill", "descending"), ("bin", "ascending")])
        closed = []
        for name, fill in zip(ordered.column("bin").to_pylist(), ordered.column("fill").to_pylist(), strict=True):
            closed += [content for content, _ in packer.add(name, fill)]
        closed += [content for content, _ in packer.close()]
        for n, content in enumerate(closed):
            for name in content:
                names.append(name)
                into.append(f"{capacity_id}-m{group}-{n}")
        return pa.table({"bin": pa.array(names, pa.string()), "container": pa.array(into, pa.string())})

    return run


def pack(
    spark: SparkSession, items: DataFrame, capacities: dict[int, int], at: str, open_bins: int = OPEN_BINS, bins_per_group: int = 50_000
) -> DataFrame:
    """Assign items (id, size) to containers of each capacity.

    Returns capacity_id, container, id, piece, start, size, one row for each piece; an item that
    fits has one piece. Items of size 0 take part (they need no room), null sizes count as 0, a null
    id is kept. Repeated ids are items of their own. No items: no rows. ``at`` is a new folder on shared
    storage for the first round's result, so that sizes are computed once. ``capacities`` is a driver-side
    dict, a handful of settings; each item is packed for every one of them.
    The second round takes about ``bins_per_group`` bins a task; their number is counted first.
    """
    if not capacities:
        return spark.createDataFrame([], "capacity_id int, container string, id long, piece int, start long, size long")
    slim = items.select(F.col(items.columns[0]).cast("long").alias("id"), F.coalesce(F.col(items.columns[1]), F.lit(0)).cast("long").alias("size"))
    slim.mapInArrow(_first_round(capacities, open_bins), _FIRST).write.parquet(at)
    packed = spark.read.schema(_FIRST).parquet(at)
    left = packed.where("left_open").groupBy("capacity_id", "capacity", "bin").agg(F.first("fill").alias("fill"))
    groups = left.count() // bins_per_group + 1
    spread = left.withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int"))
    moved = spread.groupBy("capacity_id", "capacity", "part").applyInArrow(_second_round(open_bins), "bin string, container string")
    out = ["capacity_id", "container", "id", "piece", "start", "size"]
    return (
        packed.where("not left_open").withColumn("container", F.col("bin")).select(*out)
        .unionByName(packed.where("left_open").join(moved, "bin").select(*out))
    )
