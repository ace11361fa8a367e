import datetime as dt
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import binding as B
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.operators import joins as J
from factloom.operators import ordering as O
from factloom.operators import queue as Q
from factloom.operators import validate as V
from factloom.operators.graph import index_crawl, linked_from
from factloom.plans.facts import _CASES
from factloom.session import shared_dir
from factloom.sources import pages, sinks
from factloom.streaming import folds

DAY = dt.date(2026, 1, 10)


def said(text, aliases=("Paper Ferry",), day=DAY):
    return [(f["kind"], f["season"], f["day"] and str(f["day"]), f["year"]) for f in B.claims_of(text, list(aliases), day)]


@pytest.mark.parametrize("text", [
    "Paper Ferry may be renewed for season 3", "Paper Ferry has been picked up for a second season, according to unconfirmed reports", "Iron Lantern, unlike Paper Ferry, was renewed for season 2",
    "Paper Ferry fans saw Iron Lantern renewed for season 2", "Paper Ferry; season 3 premieres May 5, 2026", "Production on season 3 of Paper Ferry has not begun", "A season of Paper Ferry", "",
])
def test_no_claim(text):
    assert said(text) == []


def test_claims_of_nothing():
    assert B.claims_of(None, ["x"], DAY) == [] and B.claims_of("x renewed for season 2", [], DAY) == [] and B.claims_of("x renewed for season 2", ["", None], None) == []
    assert said("Paper Ferry season 3 premieres May 5", day=None) == [] and said("Paper Ferry season 3 premieres February 30, 2026") == []


def test_quotes_and_years():
    assert said("“Paper Ferry” season 2 premieres June 3") == [("RELEASE_DATE_CONFIRMED", 2, "2026-06-03", 2026)]
    assert said("Paper Ferry season 2 premieres January 3") == [("RELEASE_DATE_CONFIRMED", 2, "2027-01-03", 2027)]


def test_excerpts_are_read_again(spark):
    long = "After a long summer of talks in which nobody wanted to say anything at all about money or about the weather on the coast, " * 2
    rows = [(1, f"{long}Paper Ferry was renewed for season 3"), (2, "Paper Ferry season 4 canceled"), (3, None)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("names", F.array(F.lit("Paper Ferry"))).withColumn("seen", F.lit(DAY)).withColumn("kind", F.lit("clash").cast("string"))
    found = B.bound_claims(df.drop("kind"), "text", "names", "seen").collect()
    assert {(r.id, r.kind) for r in found} <= {(1, "RENEWED"), (2, "CANCELED")} and all(len(r.excerpt) <= 200 for r in found)
    stored = spark.createDataFrame([(2, "Paper Ferry season 4 canceled", 4, "CANCELED"), (3, "Paper Ferry", 4, "CANCELED")], "id int, text string, s int, k string").withColumn("names", F.array(F.lit("Paper Ferry"))).withColumn("seen", F.lit(DAY))
    assert {r.id: r.replayed for r in B.replayed(stored, ["id"], "text", "names", "seen", "s", "k").collect()} == {2: True, 3: False}


def test_cases_have_distinct_names():
    assert len({c for c, *_ in _CASES}) == len(_CASES)


def test_admission_against_brute_force(spark):
    random.seed(3)
    times = sorted(random.choice([random.uniform(0, 4000), random.uniform(9000, 9500)]) for _ in range(400))
    data = [(random.choice([1, 1, 1, 2, 3]), i, float(t)) for i, t in enumerate(times)]
    got = {r.event_id: (r.admitted, r.retry_after) for r in Q.admission(spark.createDataFrame(data + [(None, 900, 1.0), (1, 901, None)], "k int, event_id int, t double"), "k", "t", "event_id", 3, 7, 300.0).collect()}
    kept, want = deque(), {}
    for k, i, t in data:
        while kept and kept[0][0] < t - 300:
            kept.popleft()
        mine = [x for x in kept if x[1] == k]
        full = ([kept[0][0]] if len(kept) >= 7 else []) + ([mine[0][0]] if len(mine) >= 3 else [])
        want[i] = (not full, max(1, int(np.ceil(max(full) + 300 - t))) if full else 0)
        if not full:
            kept.append((t, k))
    assert got == want


def test_segments_keep_what_belongs_together(spark):
    df = spark.createDataFrame([(0.0,), (9.0,), (15.0,), (31.0,), (45.0,)], "t double")
    assert {r.t: r.segment for r in Q.segments(df, "t", 10.0).collect()} == {0.0: 0, 9.0: 0, 15.0: 0, 31.0: 3, 45.0: 3}


def test_snapshots_hand_out_in_turn(spark):
    queue = spark.createDataFrame([(i, 0, 0, None) for i in (3, 1, 2, 4)] + [(9, 0, 0, 1)], "tmdb_id int, requested_at long, next_eligible_at long, completed_at long")
    first = Q.snapshot_step(queue, F.lit(10), 3, F.lit(600))
    assert sorted(r.tmdb_id for r in first.where("handed_out").collect()) == [1, 2, 3]
    again = Q.snapshot_step(first.drop("handed_out"), F.lit(11), 3, F.lit(600))
    assert [r.tmdb_id for r in again.where("handed_out").collect()] == [4] and again.count() == 5
    assert sorted(r.tmdb_id for r in Q.snapshot_step(again.drop("handed_out"), F.lit(610), 3, F.lit(600)).where("handed_out").collect()) == [1, 2, 3]


def test_completion_is_conditional_and_atomic(spark):
    queue = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", None)], "tmdb_id int, receipt string, completed_at long")
    acks = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (1, 3, "x", True), (1, 7, "a", True), (2, 1, "a", True), (2, 3, "c", False), (3, 3, "c", None)], "batch int, tmdb_id int, receipt string, proof_ok boolean")
    got = sorted(map(tuple, Q.conditional_complete(queue, acks).collect()))
    assert got == [(1, 1, "complete"), (1, 2, "already_complete"), (1, 3, "stale"), (1, 7, "stale"), (2, 1, "rejected"), (2, 3, "rejected"), (3, 3, "rejected")]
    asked = spark.createDataFrame([(1, "a"), (1, "z"), (2, "b"), (8, "q")], "tmdb_id int, receipt string")
    assert {(r.tmdb_id, r.receipt): r.status for r in Q.receipt_status(queue, asked).collect()} == {(1, "a"): "pending", (1, "z"): "unknown", (2, "b"): "complete", (8, "q"): "unknown"}


def test_import_stops_at_capacity(spark):
    queue = spark.createDataFrame([(1, None), (2, 5)], "tmdb_id int, completed_at long")
    legacy = spark.createDataFrame([(1, 50), (3, 70), (4, 60), (5, 10), (6, 65), (4, 90)], "tmdb_id int, at long")
    got = [(r.tmdb_id, r.requested_at, r.next_eligible_at) for r in Q.imported(queue, legacy, F.lit(100), F.lit(60), F.lit(20), 3).collect()]
    assert sorted(got) == [(4, 60, 100), (6, 65, 100)]


def test_batches_stop_at_the_first_failure(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("b", 2, True), ("b", 3, True), ("b", 4, True)], "g string, n int, ok boolean")
    assert sorted((r.g, r.n) for r in Q.bounded_batch(df, "g", ["n"], ~F.col("ok"), 3).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]


@pytest.mark.parametrize("rows, columns, schema", [
    (folds.rate_limit(2, 50.0), folds.rate_limit_columns(2, 50.0), "k int, event_id int, admitted boolean, retry_after long"),
    (folds.cool_down(40.0), folds.cool_down_columns(40.0), "k int, event_id int, accepted boolean"),
    (folds.rolling_quota(2, 60.0), folds.rolling_quota_columns(2, 60.0), "k int, event_id int, granted boolean, delay double"),
])
def test_folds_over_arrays_do_what_folds_over_rows_do(spark, rows, columns, schema):
    random.seed(5)
    data = [(random.choice([1, 1, 2]), i, float(t)) for i, t in enumerate(sorted(random.randrange(900) for _ in range(300)))]
    df = spark.createDataFrame(data + [(None, 999, 1.0)], "k int, event_id int, t double")
    a = folds.fold(df, "k", ["t", "event_id"], rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        b = sorted(map(tuple, folds.fold_columns(df, "k", ["t", "event_id"], columns, schema).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, a.collect())) == b and folds.fold_columns(df.limit(0), "k", ["t", "event_id"], columns, schema).count() == 0


def test_time_blocks_change_nothing(spark):
    random.seed(8)
    df = spark.createDataFrame([(random.choice([1, 1, 1, 2]), random.randrange(600), i, random.randrange(40)) for i in range(400)], "k int, t long, id int, v int")
    from pyspark.sql import Window

    plain = df.withColumn("n", F.count("*").over(Window.partitionBy("k").orderBy("t").rangeBetween(-20, 0)))
    assert sorted((r.id, r.n) for r in plain.collect()) == sorted((r.id, r.in_window) for r in O.rolling_count(df, "k", F.col("t"), 20, 30).collect())
    following = df.withColumn("x", F.lead("t").over(Window.partitionBy("k").orderBy("t", "id"))).where("x is null or x - t > 2")
    assert sorted(r.id for r in following.collect()) == sorted(r.id for r in O.settled(df, "k", F.col("t"), "id", 2, 2).collect())
    a, b = (sorted((r.id, r.verdict) for r in O.version_gate(df.withColumn("at", F.struct("t", "id")), "k", "at", "v", block).collect()) for block in (None, F.floor(F.col("t") / 50)))
    assert a == b


def test_limits_for_each_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)] + [("c", 1)], "g string, n int")
    assert sorted((r.g, r.n) for r in O.top_per_group(df, "g", [F.col("n")], {"a": 1, "b": 3}).collect()) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_any_number_of_phrases(spark):
    texts = spark.createDataFrame([(1, "a paper ferry and an iron lantern"), (2, None), (3, "paper")], "id int, t string")
    phrases = spark.createDataFrame([(f"word{i}",) for i in range(20_000)] + [("paper",), ("iron lantern",), ("",), (None,)], "p string")
    for most in (16_000_000, 50_000):
        assert sorted((r.id, r.phrase) for r in J.contained(texts, "t", phrases, "p", most).collect()) == [(1, "iron lantern"), (1, "paper"), (3, "paper")]
    assert J.contained(texts, "t", phrases.limit(0), "p").count() == 0


def test_lookups_are_checked_for_identity(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    answers = spark.createDataFrame([(1, 1, "One"), (2, 9, "Nine"), (1, 1, "One")], "asked int, own int, title string")
    local = spark.createDataFrame([(1, 1, "Uno"), (2, 2, "Dos")], "asked int, own int, title string")
    assert {r.id: (r["name"], r.local_name) for r in J.identified(rows, "id", answers, "asked", "own", local).collect()} == {1: ("One", "Uno"), 2: (None, "Dos"), 3: (None, None), None: (None, None)}


def test_shared_words(spark):
    a = spark.createDataFrame([(1, "paper ferry club"), (2, "iron"), (3, "")], "i int, t string")
    b = spark.createDataFrame([(7, "paper ferry"), (8, "the iron lantern"), (9, "paper ferry club house")], "j int, t string")
    got = {(r.i, r.j): r.score for r in J.shared_words(a, ["i"], X.words(F.col("t")), b, ["j"], X.words(F.col("t"))).collect()}
    assert got == {(1, 7): 2, (1, 9): 3, (2, 8): 3}


def test_normal_forms(spark):
    rows = spark.createDataFrame([("Ｆｕｌｌ Őszi ŘEKA", 1), ("Straße – “Ça”", 2), (None, 3), ("", 4)], "t string, i int")
    got = {r.i: (r.a, r.b) for r in rows.select("i", X.folded(F.col("t")).alias("a"), X.normalized(F.col("t")).alias("b")).collect()}
    assert got[1] == ("full oszi reka",) * 2 and got[2][0] == got[2][1] and got[3] == (None, None) and got[4] == ("", "")
    kept = spark.createDataFrame([("Ｆｕｌｌ &amp; Ço&ntilde;o!",)], "t string").select(X.kept_accents(F.col("t"))).first()[0]
    assert kept == "full çoño" and spark.createDataFrame([("1ª — A\xa0B®",)], "t string").select(X.spanish_plain(F.col("t"))).first()[0] == "1a - a b"


def test_listing_urls(spark):
    rows = [("https://A.example/x/?page=2&language=es", "https://a.example/x?language=es&page=2"), ("https://a.example/x?page=0", None), ("https://a.example/x?q=1", None), ("https://a.example/x%2Fy", None), ("https://a.example/../x", None), ("https://a.example/x", "https://a.example/x")]
    df = spark.createDataFrame(rows, "u string, want string").withColumn("got", U.listing(F.col("u"), {"language": "[a-z]{2}", "page": "[1-9][0-9]{0,2}"}))
    assert all(r.got == r.want for r in df.collect())


def test_crawl_merges_anchors(spark):
    shared_dir(spark)
    links = spark.createDataFrame([("e", "i1", "more"), ("i1", "a", "A one"), ("e", "a", "A two"), ("i1", "i2", "next"), ("i2", "b", "B"), ("i2", "i1", "back"), (None, "a", "x"), ("i1", "a", "A one")], "source string, target string, anchor string")
    entries = spark.createDataFrame([("e",), (None,)], "node string")
    index = lambda t: F.startswith(t, F.lit("i"))
    assert sorted(map(tuple, index_crawl(links, entries, 2, index).collect())) == [("a", 1, "A one | A two", 2)]
    assert {r.node for r in index_crawl(links, entries, 3, index).collect()} == {"a", "b"}
    assert sorted(r.node for r in linked_from(links, entries).collect()) == ["a", "i1"]


def test_depth_first_walks_keep_to_their_budget(spark):
    from factloom.operators.graph import qualification_walk

    shared_dir(spark)
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("a", "x"), ("a", "s"), ("x", "y"), ("b", "z"), (None, "q"), ("t", None)], "source string, target string")
    seeds = spark.createDataFrame([("s",), ("t",), (None,), ("s",)], "node string")
    got = sorted(map(tuple, qualification_walk(edges, seeds, 5, 3).collect()))
    assert got == [("s", 0, "s"), ("s", 1, "a"), ("s", 2, "x"), ("s", 3, "y"), ("s", 4, "b"), ("t", 0, "t")]


def test_mass_changes_are_blocked(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 4, "s int")
    assert {r.s: r.blocked for r in V.mass_change(df, "s", 4).collect()} == {1: True, 2: False}


HTML = """<html><head><title>T</title><script type="application/ld+json">{"@type": "NewsArticle", "headline": "The  End", "url": "https://a.example/p", "datePublished": "2026-03-04T10:00:00Z"}</script></head>
<body><nav><a href="/n">Nav</a></nav><h1>The End</h1><form action="/find" method="GET"><input name="s"><input name="x"></form><p>Text<div class="related">Other <p>more</div> and <a href="/m">a <b>link</b></a></body></html>"""


def test_pages_are_walked(spark):
    p = pages.parse(HTML)
    assert (p.title, p.heading, p.parts) == ("T", "The End", ["The End", "Text", "and", "a", "link"]) and p.links == [("/n", "Nav"), ("/m", "a link")]
    assert pages.parse(None).parts == [] and pages.parse("<p>a</b></p></div>b<br/>c").parts == ["a", "b", "c"]
    df = spark.createDataFrame([(HTML, "https://a.example/p", "x y"), (HTML, "https://b.example/", None), (None, None, "q")], "h string, u string, q string")
    rows = df.select(pages.published(F.col("h"), F.col("u")).alias("d"), pages.search_url(F.col("h"), F.col("u"), "s", ["a.example"], F.col("q")).alias("s")).collect()
    assert [(r.d, r.s) for r in rows] == [("2026-03-04", "https://a.example/find?s=x+y"), (None, None), (None, None)]


def test_sitemaps_have_limits(spark):
    def urls(n):
        return "<urlset>" + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(n)) + "</urlset>"

    df = spark.createDataFrame([(0, urls(3)), (1, urls(6)), (2, "<sitemapindex><sitemap><loc>https://a.example/s</loc></sitemap></sitemapindex>"), (3, "<!DOCTYPE x>" + urls(1)), (4, "<urlset>"), (5, None), (6, "<x/>")], "i int, x string")
    got = {r.i: (r.s.kind, len(r.s.links)) for r in df.select("i", pages.sitemap(F.col("x"), most_urls=5).alias("s")).collect()}
    assert got == {0: ("urlset", 3), 1: ("urlset", 0), 2: ("index", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 0)}


def test_tables_are_published_together(spark, tmp_path):
    store = sinks.VersionedSet(spark, f"file://{tmp_path}/s")
    assert store.read_all() == {}
    store.publish_all({"data": spark.range(3), "log": spark.range(1)})
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.publish_all({"data": spark.range(9), "log": broken})
    assert {n: t.count() for n, t in store.read_all().items()} == {"data": 3, "log": 1}


def test_reports(spark, tmp_path):
    cases = spark.createDataFrame([(1, "fine")], "id int, t string")
    sinks.write_report(spark, {"n": 1}, "R", cases, f"file://{tmp_path}/r")
    assert (tmp_path / "r" / "report.json").exists() and (tmp_path / "r" / "report.md").read_text().startswith("# R") and spark.read.json(f"file://{tmp_path}/r/cases.jsonl").count() == 1
    with pytest.raises(ValueError):
        sinks.write_report(spark, {}, "R", cases.withColumn("t", F.lit("password = hunter2")), f"file://{tmp_path}/q")


def test_a_writer_that_dies_leaves_the_table_alone(spark, tmp_path):
    from factloom.operators.changefeed import MergeTable

    rows = spark.createDataFrame([(k, s, None, f"{k}", f"v{s}") for k in range(50) for s in range(4)], "key int, seq int, old_id string, new_id string, record string")
    table = MergeTable(spark, f"file://{tmp_path}/t", fanout=3, buckets=4)
    for s in range(3):
        table.append(rows.where(F.col("seq") == s))
    with pytest.raises(Exception):
        table.append(rows.withColumn("record", F.raise_error(F.lit("no")).cast("string")))
    again = MergeTable(spark, f"file://{tmp_path}/t")
    assert len(again.runs) == 3 and {r.record for r in again.current().collect()} == {"v2"}
    again.append(rows.where("seq = 3"))
    assert len(again.runs) == 4 and again.buckets == 4
    third = MergeTable(spark, f"file://{tmp_path}/t", fanout=2)
    third.append(rows.where("seq = 0"))
    assert len(third.runs) == 1 and {(r.key, r.record) for r in third.current().collect()} == {(k, "v3") for k in range(50)}
    plan = third.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    held = {p.name for p in (tmp_path / "t").iterdir()}
    third.append(rows.where("seq = 1"))
    assert any(n.startswith("run-") for n in held) and not any(n in {p.name for p in (tmp_path / "t").iterdir()} for n in held if n.startswith("run-0000") and n not in {r.split("/")[0] for r in [*third.runs, *third.replaced]})


def test_keys_of_other_types_merge(spark, tmp_path):
    from factloom.operators.changefeed import MergeTable

    rows = spark.createDataFrame([(k, dt.datetime(2026, 1, 1 + s), None, "x", (s,)) for k in ("a", "é", "z") for s in range(3)], "key string, seq timestamp, old_id string, new_id string, record struct<v:int>")
    table = MergeTable(spark, f"file://{tmp_path}/t")
    for s in range(3):
        table.append(rows.where(F.col("record.v") == (s + 1) % 3))
    assert sorted((r.key, r.record.v) for r in table.current().collect()) == [("a", 2), ("z", 2), ("é", 2)]


def test_long_fields_come_back_whole(spark):
    from factloom.functions import codes as C

    text = "x" * (2 << 20)
    df = spark.createDataFrame([(text,)], "t string")
    line = df.select(C.encode_line(1, [F.col("t")]).alias("l"))
    assert line.select(C.decode_line(F.col("l"), 1, ["t"]).alias("x")).first().x.t == text


def test_sqlite_does_the_work(spark, tmp_path):
    import sqlite3

    from factloom.sources import files

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (k INTEGER, v TEXT, w REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"v{i}", i / 2) for i in range(100)])
    path = str(tmp_path / "x.db")
    assert [tuple(r) for r in files.sqlite_table(spark, path, "t", "k long, v string", "k >= 10", "k DESC", 2).collect()] == [(99, "v99"), (98, "v98")]
    assert sorted(r.k for r in files.sqlite_table(spark, path, "t", "k long", "k % 2 = 0", tasks=4).collect()) == list(range(0, 100, 2))
    with pytest.raises(ValueError):
        files.sqlite_table(spark, path, "t", "k long", limit=1, tasks=2)


def test_publication_has_bounds(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string")
    log = spark.createDataFrame([(1, "x"), (2, "y")], "position int, line string")
    more, other = log.unionByName(spark.createDataFrame([(3, "z")], log.schema)), spark.createDataFrame([(1, "X"), (2, "y"), (3, "z")], log.schema)
    assert V.publication_boundary(old, new, "id", ["v"], log, more).count() == 0
    assert {(r.rule, r.n) for r in V.publication_boundary(old, old, "id", ["v"], log, other).collect()} == {("changed ids", 0), ("log lines lost", 1)}
    files = [spark.createDataFrame(rows, "path string, sha256 string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")])]
    assert {(r.path, r.change) for r in V.changed_files(*files).collect()} == {("b", "changed"), ("c", "added")}


def test_a_view_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "id int, name string").write.parquet(f"{tmp_path}/in")
    official, meta = spark.createDataFrame([(1, "RENEWED")], "key int, status string"), spark.createDataFrame([(2, 2026)], "key int, year int")
    stream = spark.readStream.schema("id int, name string").parquet(f"{tmp_path}/in")
    q = folds.watch_view(stream, (official, "id", "key"), (meta, "id", "key")).writeStream.format("memory").queryName("view").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("view").collect())) == [(1, "x", "RENEWED", None), (2, "y", None, 2026), (9, "z", None, None)]
