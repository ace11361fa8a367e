"""A table rebuilt from a feed of inserts, updates and deletes, as a log-structured merge table.

``append`` writes a run: of each key only the entries at its newest instant in the run, as a flush of a
memory table would leave them, found by a group limit that already works before the shuffle. A run is cut into
buckets by hash of the key, each bucket a file sorted by key and sequence. ``merged`` walks the runs of each bucket side
by side, a few batches of each at a time, and lets each key's newest entries win, tombstones included; neither a
shuffle nor a sort of the table is needed for that. ``current`` drops the tombstones. ``compact`` replaces many
runs by one; it runs by itself beyond ``fanout`` runs. Runs live in the shared folder, so a lost
executor costs no more than its tasks.

Which runs count is told by one small file that is replaced in a single step. An append or a compaction that dies
leaves the table as it was; runs that a compaction replaced are deleted by the next change of the table, so
that whoever reads them meanwhile can finish.

An entry is (key, seq, old_id, new_id, record): one change, with ids that name the record before and
after it. Entries of one key at one instant form a chain, each one's old being the preceding one's new;
they may be spread over several runs, hence the chain is only resolved when runs are merged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import hadoop, replace_file

#: Rows of a run that a merge holds at a time.
BATCH = 1 << 14
ENTRY = ("key", "seq", "old_id", "new_id", "record")


def newest(entries: DataFrame, *keys: str) -> DataFrame:
    """The entries at each key's newest instant, repeats of a change once.

    rank() = 1 becomes a group limit that is also applied before the shuffle: a key that holds
    a third of all rows sends each task's newest entries only. Repeats share the newest instant, so
    they are removed afterwards by an aggregation on the same keys, which needs no further shuffle.
    """
    by_key = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    top = entries.withColumn("place", F.rank().over(by_key)).where("place = 1").drop("place")
    return top.dropDuplicates([*keys, "seq", "old_id", "new_id"])


def chain_end(changes: Column) -> Column:
    """The change with which a set of simultaneous changes (old_id, new_id, record) ends.

    The last one's new record is left by no other change. Ids are compared null-safe (null: no
    record). If the changes form a closed circle or a link is missing, several could be last; then the
    one with a record and the greatest values is taken.
    """
    ends = F.filter(
        changes,
        lambda c: F.size(F.filter(changes, lambda d: d["new_id"].eqNullSafe(c["new_id"])))
        > F.size(F.filter(changes, lambda d: d["old_id"].eqNullSafe(c["new_id"]))),
    )
    ranked = F.transform(
        F.when(F.size(ends) > 0, ends).otherwise(changes),
        lambda c: F.struct(c["new_id"].isNotNull().alias("held"), c["new_id"].alias("id"), c["record"].alias("record")),
    )
    return F.array_max(ranked)


class _Cursor:
    """A sorted file, read batch by batch."""

    def __init__(self, uri: str, schema: pa.Schema) -> None:
        from pyarrow import fs, parquet

        files, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
        self.schema = schema
        # Reads coming columns by name only, so that what a folder's name looks like doesn't matter.
        self.file = parquet.ParquetFile(files.open_input_file(path), coerce_int96_timestamp_unit="us")
        self.batches = self.file.iter_batches(BATCH, columns=list(ENTRY))
        self.rows, self.keys, self.more = schema.empty_table(), np.empty(0), True
        self.read()

    def read(self) -> None:
        batch = next(self.batches, None)
        if batch is None:
            self.more = False
            return
        self._hold(pa.concat_tables([self.rows, pa.table(batch).select(list(ENTRY)).cast(self.schema)]))

    def _hold(self, rows: pa.Table) -> None:
        self.rows, self.keys = rows, rows.column("key").to_numpy()

    def take(self, n: int) -> tuple[pa.Table, np.ndarray]:
        taken = self.rows.slice(0, n), self.keys[:n]
        self._hold(self.rows.slice(n))
        return taken


def merged_runs(uris: list[str], schema: pa.Schema) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """K-way merge of sorted files: tables of the newest entries, and where each key begins in them.

    Up to the least of the keys at which a file's batch in hand ends everything is at hand, so that part is put in
    order (a stable merge of presorted pieces) and given out. Memory is a batch for each file.
    """
    cursors = [_Cursor(uri, schema) for uri in uris]
    while True:
        for c in cursors:
            while c.more and not len(c.keys):
                c.read()
        cursors = [c for c in cursors if len(c.keys)]
        if not cursors:
            return
        ends = [c.keys[-1] for c in cursors if c.more]
        if ends:
            edge = min(ends)
            counts = [int(np.searchsorted(c.keys, edge, side="left")) for c in cursors]
            if not any(counts):
                for c in cursors:
                    if c.more and c.keys[-1] == edge:
                        c.read()
                continue
        else:
            counts = [len(c.keys) for c in cursors]
        pieces = [c.take(n) for c, n in zip(cursors, counts, strict=True) if n]
        yield _newest_of(pa.concat_tables([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))


def _newest_of(rows: pa.Table, keys: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Of presorted pieces in a row the entries at each key's newest instant, repeats of a change once."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    seq = rows.column("seq")
    rank = np.unique(seq.to_numpy(), return_inverse=True)[1].astype(np.int64)[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    top = rank == np.repeat(np.maximum.reduceat(rank, starts), sizes)
    kept, group = order[top], np.repeat(np.arange(len(starts)), sizes)[top]
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(several):
        ids = rows.select(["old_id", "new_id"]).take(pa.array(kept[several])).to_pydict()
        seen, again = set(), []
        for at, g, *change in zip(several.tolist(), group[several].tolist(), ids["old_id"], ids["new_id"], strict=True):
            mark = (g, *change)
            if mark in seen:
                again.append(at)
            seen.add(mark)
        kept, group = np.delete(kept, again), np.delete(group, again)
    return rows.take(pa.array(kept)), np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


class MergeTable:
    """A log-structured merge table below ``path``, its runs cut into ``buckets``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        known = self._listed()
        self.runs: list[str] = known.get("runs", [])
        self.replaced: list[str] = known.get("replaced", [])
        self.buckets: int = known.get("buckets") or buckets or spark.sparkContext.defaultParallelism
        self.schema = T.StructType.fromJson(known["schema"]) if known.get("schema") else None

    def _listed(self) -> dict:
        at, fs = hadoop(self.spark, f"{self.path}/manifest.json")
        return json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0]) if fs.exists(at) else {}

    def _list(self, runs: list[str], replaced: list[str]) -> None:
        """Runs count once they are listed; what the change before replaced goes now."""
        known = {"runs": runs, "replaced": replaced, "buckets": self.buckets, "schema": json.loads(self.schema.json())}
        replace_file(self.spark, f"{self.path}/manifest.json", json.dumps(known))
        live = {r.split("/")[0] for r in [*runs, *replaced]}
        for folder in {r.split("/")[0] for r in self.replaced} - live:
            at, fs = hadoop(self.spark, f"{self.path}/{folder}")
            fs.delete(at, True)
        self.runs, self.replaced = runs, replaced

    def _sorted(self, entries: DataFrame, *keys: str) -> DataFrame:
        """The newest entries, one partition for each bucket, each of them sorted."""
        slim = newest(entries.select(*keys, *(c for c in ENTRY if c not in keys)), *keys)
        if self.schema is None:
            self.schema = slim.select(*ENTRY).schema
        return slim.repartition(self.buckets, "key").sortWithinPartitions(*dict.fromkeys([*keys, "key", "seq"]))

    def _next(self) -> int:
        """A number greater than those of all runs known, so that no run is written over one that is read."""
        return 1 + max((int(m[1]) for m in (re.match(r"[a-z]+-(\d+)", r) for r in [*self.runs, *self.replaced]) if m), default=-1)

    def append(self, entries: DataFrame, name: str | None = None) -> None:
        """Add ``entries`` as one sorted run."""
        name = name or f"run-{self._next():06d}"
        if name in self.runs:
            raise ValueError(f"run {name} is there already")
        self._sorted(entries, "key").write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._list([*self.runs, name], self.replaced)
        if len(self.runs) > self.fanout:
            self.compact()

    def append_by(self, entries: DataFrame, run: Column) -> None:
        """Add ``entries`` as several sorted runs in one job, one for each value of ``run``.

        ``run`` should be something like the month of receipt, so that runs are few and each
        late delivery comes in a run of its own time. Each of them is listed and counts for the fanout.
        """
        name = f"runs-{self._next():06d}"
        kept = self._sorted(entries.withColumn("run", run), "run", "key")
        kept.write.mode("overwrite").partitionBy("run").parquet(f"{self.path}/{name}")
        at, fs = hadoop(self.spark, f"{self.path}/{name}")
        written = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        if not written:
            return
        self._list([*self.runs, *(f"{name}/{w}" for w in written)], self.replaced)
        if len(self.runs) > self.fanout:
            self.compact()

    def _files(self) -> dict[int, list[str]]:
        """Bucket -> files of all runs; a file's number is its bucket."""
        found: dict[int, list[str]] = {}
        for run in self.runs:
            at, fs = hadoop(self.spark, f"{self.path}/{run}")
            files = fs.listFiles(at, True)
            while files.hasNext():
                file = files.next().getPath()
                number = re.match(r"part-(\d+)-", file.getName())
                if number:
                    found.setdefault(int(number[1]), []).append(file.toString())
        return found

    def _groups(self) -> DataFrame:
        """Rows (key, seq, changes): each key's newest changes over all runs, bucket by bucket."""
        fields = self.schema if self.schema is not None else T.StructType([T.StructField(c, T.StringType()) for c in ENTRY])
        change = T.StructType([fields[c] for c in ENTRY[2:]])
        out = T.StructType([fields["key"], fields["seq"], T.StructField("changes", T.ArrayType(change, False))])
        files = self._files()
        if not files:
            return self.spark.createDataFrame([], out)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    for rows, starts in merged_runs(files.get(bucket, []), schema):
                        rows = rows.combine_chunks()
                        changes = pa.StructArray.from_arrays([_whole(rows.column(c)) for c in ENTRY[2:]], fields=[rows.schema.field(c) for c in ENTRY[2:]])
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(changes)), pa.int32()), changes)
                        first = rows.take(pa.array(starts))
                        yield pa.RecordBatch.from_arrays([_whole(first.column("key")), _whole(first.column("seq")), lists], names=["key", "seq", "changes"])

        return self.spark.range(0, self.buckets, 1, self.buckets).mapInArrow(run, out)

    def merged(self) -> DataFrame:
        """Each key's newest entries over all runs."""
        return self._groups().select("key", "seq", F.inline("changes"))

    def current(self) -> DataFrame:
        """Rows (key, seq, record) in force: the newest change's record, without withdrawn keys."""
        only = F.col("changes")[0]
        end = F.when(
            F.size("changes") == 1, F.struct(only["new_id"].isNotNull().alias("held"), only["new_id"].alias("id"), only["record"].alias("record"))
        ).otherwise(chain_end(F.col("changes")))
        return self._groups().select("key", "seq", end.alias("end")).where("end.held").select("key", "seq", "end.record")

    def compact(self) -> None:
        """Replace all runs by one. Tombstones stay, since a late run may hold older changes of the key.

        A bucket comes out of the merge in order and is written by the task that merged it, as the file of its number.
        """
        if not self.runs:
            return
        name = f"level-{self._next():06d}"
        self.merged().write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._list([name], [*self.replaced, *self.runs])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def feed_entries(changes: DataFrame, key: str, instant: str, old: str, new: str, **kept: Column) -> DataFrame:
    """Entries of a change feed whose ``old`` and ``new`` are structs (null: no record).

    The key is that of the row, else of the new, else of the old record. ``instant`` is a string with
    any UTC offset; rows without key or readable instant, and rows with neither record, don't count.
    Ids are SHA-256 over the record's JSON, so equal records get equal ids whatever was delivered.
    """

    def record_id(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.sha2(F.to_json(F.col(c), {"ignoreNullFields": "false"}), 256))

    return changes.select(
        F.coalesce(F.col(key), F.col(f"{new}.{key}"), F.col(f"{old}.{key}")).alias("key"),
        F.try_to_timestamp(F.trim(F.col(instant))).alias("seq"),
        record_id(old).alias("old_id"), record_id(new).alias("new_id"), F.col(new).alias("record"),
        *[c.alias(n) for n, c in kept.items()],
    ).where("key is not null and seq is not null and (old_id is not null or new_id is not null)")
