import random

from pyspark.sql import functions as F

from factloom.operators.changefeed import MergeTable, feed_entries
from factloom.operators.snapshots import snapshot_changes

REC = "struct<tmdbId:int,v:string>"


def test_snapshot_kinds(spark):
    data = [(1, 10, 1, "a"), (1, 11, 1, None), (1, 12, 1, "x"), (1, 12, 2, "y"), (3, 10, 1, "b"), (3, 11, 1, None), (3, 13, 1, "n"), (3, 13, 1, "n"), (3, 12, None, "x"), (3, 12, 0, "y"), (3, None, 1, "q")]
    df = spark.createDataFrame(data, "snap int, id int, checked int, v string").withColumn("hash", F.lit(1))
    got = sorted(tuple(r) for r in snapshot_changes(df, "snap", "id", [F.col("v")], [F.col("checked")]).collect())
    assert got == [(3, 10, "changed"), (3, 13, "added")]
    assert snapshot_changes(df.limit(0), "snap", "id", [F.col("v")], [F.col("checked")]).count() == 0


def test_null_moves_between_columns(spark):
    df = spark.createDataFrame([(1, 1, 5, None), (2, 1, None, 5)], "snap int, id int, a int, b int")
    assert [r.change_kind for r in snapshot_changes(df, "snap", "id", [F.col("a"), F.col("b")], [F.lit(0)]).collect()] == ["changed"]


def current(rows):
    return sorted((r["key"], r["record"]["v"]) for r in rows.collect())


def feed(spark, data):
    df = spark.createDataFrame(data, f"tmdbId int, ts string, old {REC}, new {REC}, got int")
    return feed_entries(df, "tmdbId", "ts", "old", "new", got=F.col("got"))


def r(v):
    return None if v is None else (1, v)


def test_chain_offsets_repeats_and_late_runs(spark, tmp_path):
    data = [
        (None, "2026-01-01T02:00:00+02:00", None, r("a"), 1), (1, "2026-01-01T00:00:00Z", r("a"), r("b"), 3), (1, "2026-01-01T01:00:00+01:00", r("b"), r("c"), 1),
        (1, "2025-12-31T00:00:00Z", r("z"), r("y"), 4), (1, "2026-01-01T00:00:00.000Z", r("a"), r("b"), 2), (2, "2026-01-01T00:00:00Z", None, (2, "k"), 1),
        (2, "2026-01-02T00:00:00Z", (2, "k"), None, 1), (3, "not a time", None, (3, "n"), 1),
    ]
    entries = feed(spark, data)
    table = MergeTable(spark, f"file://{tmp_path}/t", fanout=3)
    for got in (1, 2, 3, 4):
        table.append(entries.where(F.col("got") == got))
    assert current(table.current()) == [(1, "c")]
    again = MergeTable(spark, f"file://{tmp_path}/t")
    assert again.runs == table.runs and current(again.current()) == [(1, "c")]
    at_once = MergeTable(spark, f"file://{tmp_path}/u")
    at_once.append_by(entries, F.col("got"))
    assert current(at_once.current()) == [(1, "c")]
    at_once.compact()
    assert len(at_once.runs) == 1 and current(at_once.current()) == [(1, "c")]


def test_reinsertion_at_one_instant(spark, tmp_path):
    t = "2026-01-01T00:00:00Z"
    table = MergeTable(spark, f"file://{tmp_path}/t")
    table.append(feed(spark, [(1, t, r("a"), None, 1), (1, t, None, r("b"), 1)]))
    assert current(table.current()) == [(1, "b")]


def test_against_replay(spark, tmp_path):
    random.seed(7)
    state, data = {}, []
    for i in range(300):
        k = random.choice([1, 1, 1, 2, 3])
        new = None if state.get(k) and random.random() < 0.3 else (k, f"v{i}")
        data.append((k, f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z", state.get(k), new, random.randrange(4)))
        state[k] = new
    data += random.sample(data, 60)
    random.shuffle(data)
    table = MergeTable(spark, f"file://{tmp_path}/t")
    table.append_by(feed(spark, data), F.col("got"))
    assert current(table.current()) == sorted(v for v in state.values() if v)


def test_each_run_counts_for_the_fanout(spark, tmp_path):
    def changes(first):
        return feed(spark, [(1, f"2026-01-{first + i:02}T00:00:00Z", r(f"v{first + i - 1}"), r(f"v{first + i}"), i) for i in range(4)])

    table = MergeTable(spark, f"file://{tmp_path}/t", fanout=4)
    table.append_by(changes(1), F.col("got"))
    assert len(table.runs) == 4 and current(table.current()) == [(1, "v4")]
    for first in (5, 9, 13):
        table.append_by(changes(first), F.col("got"))
        assert len(table.runs) == 1 and current(table.current()) == [(1, f"v{first + 3}")]
    assert MergeTable(spark, f"file://{tmp_path}/t").runs == table.runs
    table.append_by(feed(spark, []), F.col("got"))
    assert current(table.current()) == [(1, "v16")]


def test_compaction_never_overwrites_what_it_reads(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", fanout=1)
    for i in range(1, 5):
        table.append(feed(spark, [(1, f"2026-01-0{i}T00:00:00Z", r(f"v{i - 1}"), r(f"v{i}"), 1)]))
        assert len(table.runs) == 1 and current(table.current()) == [(1, f"v{i}")]


def test_empty_feed(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t")
    table.append(feed(spark, []))
    assert current(table.current()) == []
