import random

from pyspark.sql import functions as F

from factloom.operators.history import snapshot_history, state_history

SCHEMA = "tmdbId int, timestamp timestamp, oldState string, newState string, state string, bits long"


def rows(spark, data):
    df = spark.createDataFrame([(k, t, o, n) for k, t, o, n in data], "tmdbId int, t long, oldState string, newState string")
    return df.withColumn("timestamp", F.timestamp_seconds("t")).withColumn("state", F.lit("clash")).withColumn("bits", F.lit(1))


def history(spark, data, block=7):
    out = state_history(rows(spark, data), "tmdbId", "timestamp", "oldState", "newState", block)
    return sorted((r["entity"], r["valid_from"], r["valid_to"], r["state"]) for r in out.collect())


def brute(data):
    by = {}
    for k, t, o, n in set(data):
        if k is not None and n is not None:
            by.setdefault(k, {}).setdefault(t, set()).add((None if o is None else o.strip().upper(), n.strip().upper()))
    out = []
    for k, instants in by.items():
        now, start = None, None
        for t in sorted(instants):
            edges = {e for e in instants[t] if e[0] != e[1]} or instants[t]
            news, olds = [n for _, n in edges], [o for o, _ in edges]
            if all(o == n for o, n in edges):
                end = max(news)
            else:
                ends = [n for n in set(news) if news.count(n) > olds.count(n)]
                end = max(ends) if ends else None
            if end is not None and end != now:
                if now is not None:
                    out.append((k, start, t, now))
                now, start = end, t
        if now is not None:
            out.append((k, start, None, now))
    return sorted(out, key=str)


def test_periods_across_blocks_and_words(spark):
    data = [(1, t, None, "a" if t < 150 else "b") for t in range(0, 300)]
    assert history(spark, data, block=90) == [(1, 0, 150, "A"), (1, 150, None, "B")]


def test_same_second_follows_the_chain_whatever_the_order(spark):
    data = [(1, 5, "C", "D"), (1, 5, "A", "B"), (1, 5, "B", "C"), (1, 9, "x", " d\t"), (1, 9, "x", " d\t")]
    assert history(spark, data) == [(1, 5, None, "D")]


def test_circle_leaves_the_state_and_null_changes_nothing(spark):
    assert history(spark, [(1, 1, None, "A"), (1, 2, "A", "B"), (1, 2, "B", "A"), (1, 3, "A", None), (None, 4, "A", "B")]) == [(1, 1, None, "A")]


def test_empty(spark):
    assert history(spark, []) == []


def test_against_brute_force(spark):
    random.seed(4)
    states = ["a", "B ", "c", None]
    data = [(random.choice([1, 1, 1, 2, None]), random.randrange(60), random.choice(states), random.choice(states)) for _ in range(400)]
    for block in (1, 5, 1000):
        assert sorted(history(spark, data, block), key=str) == brute(data)


def test_snapshot_runs_have_gaps(spark):
    data = [(s, 1, "x") for s in range(0, 200) if s != 100] + [(100, 2, "y"), (5, None, "z"), (7, 1, None)]
    df = spark.createDataFrame(data, "snap int, id int, v string")
    got = sorted((r.entity, str(r.state), r.first_snapshot, r.last_snapshot) for r in snapshot_history(df, "snap", "id", "v").collect())
    assert got == [(1, "None", 7, 7), (1, "x", 0, 99), (1, "x", 101, 199), (2, "y", 100, 100)]
