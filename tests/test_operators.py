import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import codes as C
from factloom.functions import dates as D
from factloom.functions import spans as S
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.functions.claims import extract_claims
from factloom.operators import joins as J
from factloom.operators import metrics as M
from factloom.operators import ordering as O
from factloom.operators import validate as V
from factloom.operators.graph import bounded_walk
from factloom.operators.resolve import keep_sticky, reconcile
from factloom.session import shared_dir
from factloom.streaming import folds


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def test_nearest_before(spark):
    random.seed(1)
    data = [(i, random.choice([1, 1, 2, None]), random.randrange(500), random.choice("bpx")) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k int, t long, kind string")
    got = {r.probe_id: r.base_id for r in J.nearest_before(df, "k", F.col("t"), F.col("kind") == "b", F.col("kind") == "p", "id", 40, 50).collect()}
    for i, k, t, kind in data:
        if kind == "p" and k is not None:
            before = [(u, j) for j, l, u, q in data if l == k and q == "b" and t - 40 <= u <= t]
            assert got.pop(i) == (max(before)[1] if before else None)
    assert not got


def test_version_diff_and_upserts(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, None, 2), (4, "w", 1)], "id int, s string, n int")
    got = sorted((r.key, r.change, tuple(r.changed_fields)) for r in J.version_diff(a, b, "id", ["s", "n"]).collect())
    assert got == [(2, "changed", ("n", "s")), (3, "removed", ()), (4, "added", ())]
    assert {r.id: r.s for r in J.keep_existing(a, b, "id").collect()} == {1: "x", 2: "y", 3: "z", 4: "w"}
    assert {r.id: r.s for r in J.replace_existing(a, b, "id").collect()} == {1: "x", 2: None, 3: "z", 4: "w"}
    assert J.last_by_key(a.unionByName(b), ["id"], [F.col("n")]).count() == 4


def test_flag_known_doesnt_multiply(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {(r.k, r.f) for r in J.flag_known(a, "k", b, "k", "f").collect()} == {(1, True), (2, False), (None, False)}


def test_metrics(spark):
    df = spark.createDataFrame([("a", True, True, "p"), ("a", True, None, None), ("a", False, True, "q"), ("b", False, False, "q")], "g string, x boolean, y boolean, f string")
    rows = df.groupBy("g").agg(*M.funnel({"n": F.lit(True), "x": F.col("x"), "xy": F.col("y")})).orderBy("g").collect()
    assert [tuple(r) for r in rows] == [("a", 3, 2, 1), ("b", 1, 0, 0)]
    assert {r.g: r.breakdown for r in M.breakdown(df, "g", "f").collect()} == {"a": {"p": 1, "q": 1}, "b": {"q": 1}}
    assert one(spark, M.pct(F.col("a"), F.col("b")), a=1, b=0) is None and one(spark, M.pct(F.col("a"), F.col("b")), a=1, b=32) == 3.12
    assert df.agg(M.only_value(F.col("f"))).first()[0] is None


def test_ordering(spark):
    ids = spark.createDataFrame([(i,) for i in [9, 3, 5, 7, 1, 3, None]], "id int")
    assert sorted((r.turn, r.id) for r in O.rotation(ids, "id", 4, 3, 3).collect()) == [(0, 5), (1, 7), (2, 9)]
    e = spark.createDataFrame([(1, 0), (1, 1), (1, 10), (2, 5)], "k int, t int")
    assert sorted((r.k, r.t) for r in O.settled(e, "k", F.col("t"), "t", 5).collect()) == [(1, 1), (1, 10), (2, 5)]


def test_text_functions(spark):
    assert one(spark, X.folded(F.col("t")), t="  Éxito — Señor’s 2!") == "exito senor s 2"
    assert one(spark, X.season_number(F.col("t")), t="renewed for a Seventh season") == 7
    assert one(spark, X.season_number(F.col("t")), t="Season 12 is here") == 12 and one(spark, X.season_number(F.col("t")), t="seasons") is None
    assert one(spark, X.sentences(F.col("t")), t=" a. b!\n\n c ") == ["a", "b", "c"]
    assert "hunter2" not in one(spark, X.redacted(F.col("t")), t="password=hunter2&x=1")
    assert one(spark, X.from_base64url(X.base64url(F.col("t"))), t="ÿþ?>~~") == "ÿþ?>~~"


def test_url_functions(spark):
    d = F.array(F.lit("a.example"))
    for url, ok in [("https://a.example/x", True), ("https://B.A.EXAMPLE:443/", True), ("http://a.example/", False), ("https://u@a.example/", False), ("https://a.example:8443/", False), ("https://bada.example/", False), ("nonsense", False), (None, False)]:
        assert one(spark, U.on_domains(F.col("u"), d), u=url) is ok
    assert one(spark, U.canonical(F.col("u")), u="HTTPS://A.Example/p/?utm_source=x&b=2&a=1#f") == "https://a.example/p?a=1&b=2"
    assert one(spark, U.public(F.col("u")), u="https://u:p@a.example/p?api_key=1&q=2") == "https://a.example/p?api_key=***&q=2"


def test_date_functions(spark):
    d = F.col("a").cast("date")
    for t, a, want in [("on March 3rd, 2026", "2025-01-01", "2026-03-03"), ("Feb 2", "2026-03-01", "2027-02-02"), ("5 May", "2026-03-01", "2026-05-05"), ("Feb 30, 2026", "2026-01-01", None), ("soon", "2026-01-01", None)]:
        got = one(spark, D.english_date(F.col("t"), d), t=t, a=a)
        assert (None if got is None else str(got)) == want
    assert str(one(spark, D.spanish_date(F.col("t")), t="el 3 de junio de 2026")) == "2026-06-03"
    assert one(spark, D.iso_date(F.col("t")), t="2026-2-3") is None and one(spark, D.instant(F.col("t")), t="2026-01-01T00:00:00") is None
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert one(spark, D.retry_after(F.col("t"), now), t="0") == 1 and one(spark, D.retry_after(F.col("t"), now), t="Thu, 01 Jan 2026 00:01:00 GMT") == 60


def test_spans(spark):
    df = spark.createDataFrame([("season 2 was renewed, and season 10 canceled",), (None,), ("",)], "t string")
    found = df.select("t", S.spans(F.col("t"), "renewed|canceled").alias("a"), S.spans(F.col("t"), r"season \d+").alias("b"))
    rows = found.select(S.pairs(F.col("a"), F.col("b"), 6).alias("p")).collect()
    assert [[(x.claim.text, x.reference.text, x.reference.gap) for x in r.p] for r in rows] == [[("renewed", "season 2", 5), ("canceled", "season 10", 1)], [], []]
    assert found.select(S.pairs(F.col("a"), F.col("b"), 0).alias("p")).first().p == []
    row = found.where("t like 'season%'")
    assert row.select(S.latest_before(F.get("a", F.lit(0)), F.col("b"), 10)["text"]).first()[0] == "season 2"
    assert row.select(S.excerpt(F.col("t"), F.get("a", F.lit(0)), F.get("b", F.lit(0)), 24)).first()[0] == "season 2 was renewed,"


def test_codes(spark):
    import hashlib
    import hmac

    assert one(spark, C.hmac_sha256(F.col("m"), b"k"), m="x") == hmac.new(b"k", b"x", hashlib.sha256).hexdigest()
    assert one(spark, C.normal_percent(F.col("u")), u="/%7Euser/%2f%zz") == "/~user/%2F%zz"
    line = C.encode_line(1, [F.lit("a|b"), F.lit(None).cast("string"), F.lit("")])
    assert tuple(one(spark, C.decode_line(line, 1, ["x", "y", "z"]), q=1)) == ("a|b", None, "")
    for bad in ("2|=YQ|-|-", "1|=YQ", "1|=Y Q|-|-", "", None):
        assert one(spark, C.decode_line(F.col("l"), 1, ["x", "y", "z"]), l=bad) is None


def test_claims(spark):
    df = spark.createDataFrame([(1, "Paper Ferry has been renewed for a third season. It won't be renewed for season 4. Was season 5 canceled?", "2026-01-01"), (2, None, None)], "id int, t string, a string").withColumn("a", F.col("a").cast("date"))
    rows = extract_claims(df, "id", "t", "a", F.array(F.lit("paper ferry"))).collect()
    assert [(r.id, r.kind, r.season) for r in rows] == [(1, "RENEWED", 3)]


def test_reconcile_is_independent_of_order_and_repeats(spark):
    data = [(1, 2, "RENEWED", "a", 1), (1, 2, "CANCELED", "b", 2), (1, 1, "FINAL", "c", 3), (2, None, "X", None, 4), (None, 1, "X", "q", 5)]
    strength = {"CANCELED": 3, "FINAL": 2, "RENEWED": 1}
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "k int, g int, kind string, v string, n int").repartition(3)
        got = sorted((r.k, r.generation, r.kind, r.value, r.conflict) for r in reconcile(df, "k", "g", "kind", "v", strength, ["n"]).collect())
        assert got == [(1, 2, "CANCELED", None, True), (2, None, "X", None, False)]


def test_sticky(spark):
    old = spark.createDataFrame([(1, "CANCELED", 3), (2, "RENEWED", 3), (3, "CANCELED", 1), (4, "X", 1)], "k int, kind string, g int")
    new = spark.createDataFrame([(1, "RENEWED", 3), (2, "FINAL", 3), (3, "RENEWED", 2), (5, "Y", 1)], "k int, kind string, g int")
    got = {r.k: r.kind for r in keep_sticky(old, new, "k", "kind", ["CANCELED"], "g").collect()}
    assert got == {1: "CANCELED", 2: "FINAL", 3: "RENEWED", 4: "X", 5: "Y"}


def test_walk(spark):
    shared_dir(spark)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 1), (None, 9)], "source long, target long")
    got = sorted((r.node, r.depth) for r in bounded_walk(e, spark.createDataFrame([(1,)], "node long"), 3).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert bounded_walk(e, spark.createDataFrame([], "node long"), 3).count() == 0


def test_violations(spark):
    df = spark.createDataFrame([(1, 5, 2, "RENEWED", None, None, "https://x"), (2, None, 0, "OLD", None, None, None)], "row_id int, tmdbId int, nextSeasonNumber int, status string, releaseDate date, releaseYear int, sourceUrl string")
    assert sorted((r.row_id, r.rule) for r in V.violations(df, "row_id", V.RECORD_RULES).collect()) == [(2, "id"), (2, "season"), (2, "status"), (2, "url")]
    assert V.is_appended("a\n", "a\nb\n") and not V.is_appended("a\n", "b\na\n")


def brute_limit(events, limit, window):
    kept, out = {}, {}
    for k, t, i in sorted(events):
        alive = [x for x in kept.get(k, []) if x >= t - window]
        out[i] = len(alive) < limit
        kept[k] = [*alive, t] if out[i] else alive
    return out


def test_rate_limit_batch_and_boundaries(spark):
    random.seed(2)
    events = [(random.choice([1, 1, 2]), float(random.randrange(40)), i) for i in range(200)]
    df = spark.createDataFrame([*events, (None, 1.0, 999)], "k int, t double, event_id int")
    got = {r.event_id: r.admitted for r in folds.fold(df, "k", ["t", "event_id"], folds.rate_limit(3, 5.0), "k int, event_id int, admitted boolean, retry_after long").collect()}
    assert got == brute_limit(events, 3, 5.0)
    step = folds.rate_limit(1, 10.0)
    state, _ = step(None, {"t": 0.0, "event_id": 1})
    assert step(state, {"t": 10.0, "event_id": 2})[1]["admitted"] is False and step(state, {"t": 10.1, "event_id": 3})[1]["admitted"] is True


def test_pending_set():
    step, state, told = folds.pending_set(), None, []
    for t, kind, receipt in [(0, "snapshot", None), (1, "submit", "a"), (2, "submit", "b"), (3, "snapshot", None), (4, "snapshot", None), (5, "complete", "a"), (6, "complete", "b"), (7, "complete", "b"), (8, "submit", "c"), (9, "snapshot", None)]:
        state, out = step(state, {"t": t, "kind": kind, "receipt": receipt})
        told.append(out["outcome"])
    assert told == ["unknown", "pending", "pending", "handed_out", "not_due", "stale", "complete", "already_complete", "pending", "handed_out"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    data = [(k, float(t), t * 10 + k) for t in range(6) for k in (1, 2)]
    schema = "k int, t double, event_id int"
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = "k int, event_id int, accepted boolean"
    stream = folds.stream_fold(spark.readStream.schema(schema).json(str(tmp_path / "in")), "k", ["t", "event_id"], folds.cool_down(2.0), out)
    query = stream.writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("cooled").collect())
    batch = folds.fold(spark.createDataFrame(data, schema), "k", ["t", "event_id"], folds.cool_down(2.0), out)
    assert got == sorted(tuple(r) for r in batch.collect())


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:00:10' as ts, 'a' as e union all select timestamp'2026-01-01 00:59:00', 'a'").write.json(str(tmp_path / "in"))
    stream = folds.tumbling_counts(spark.readStream.schema("ts timestamp, e string").json(str(tmp_path / "in")), "ts", "e", "1 hour", "10 minutes")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.n for r in spark.table("windows").collect()] == [2]


def test_blocks_shorter_than_the_tolerance_are_refused(spark):
    with pytest.raises(ValueError):
        J.nearest_before(spark.range(1), "id", F.col("id"), F.lit(True), F.lit(True), "id", 10, 5)
