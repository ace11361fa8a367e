import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.sources import files, pages, sinks


def test_json_document_and_rejection(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"schemaVersion":1,"generatedAt":"g","series":[{"tmdbId":1,"releaseDate":"2026-02-01"},{"tmdbId":2}]}')
    assert [(r.tmdbId, r.position) for r in files.json_document(spark, f"{tmp_path}/c.json").collect()] == [(1, 0), (2, 1)]
    (tmp_path / "bad.json").write_text('{"schemaVersion":1,"series":[{"tmdbId":"x"}]}')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        files.json_document(spark, f"{tmp_path}/bad.json").collect()


def test_json_lines_two_shapes(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"timestamp":"t","tmdbId":1,"new":{"tmdbId":1}}\n\n{"timestamp":"u","tmdbId":2,"changedFields":["a"]}\n')
    rows = files.json_lines(spark, f"{tmp_path}/l.jsonl").orderBy("tmdbId").collect()
    assert rows[0].new.tmdbId == 1 and rows[1].changedFields == ["a"] and rows[1].old is None
    assert files.or_empty(spark, f"{tmp_path}/none.json", files.FACT).count() == 0


def test_small_files(spark, tmp_path):
    (tmp_path / "p.properties").write_text("# x\na=1\nb = 2=3\n\na=9\nnothing\n")
    assert {r.key: r.value for r in files.properties(spark, f"{tmp_path}/p.properties").collect()} == {"a": "9", "b": "2=3"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/y.txt", "hi")
    (tmp_path / "y.zip").write_text("no archive")
    assert {r.name for r in files.archive_entries(spark, f"{tmp_path}/*.zip").collect()} == {"x/y.txt", None}
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table r(id integer, n text)")
        db.execute("insert into r values (1, 'q')")
    assert [tuple(r) for r in files.sqlite_table(spark, f"{tmp_path}/d.db", "r", "id long, n string").collect()] == [(1, "q")]
    (tmp_path / "m.json").write_text('{"A": {"x": 1}, "B": {"x": 2}}')
    assert {r.name: r.x for r in files.json_map(spark, f"{tmp_path}/m.json", files.T.StructType([files.T.StructField("x", files.T.IntegerType())])).collect()} == {"A": 1, "B": 2}


def test_strict_object(spark):
    texts = ['{"a":1}', '{"a":true}', '{"a":1.0}', '{"a":1,"a":2}', "[1]", None, '{"a":1,"b":2}', "{"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.ok for r in df.select(files.strict_object(F.col("t"), {"a": "int"}).alias("ok")).collect()] == [True] + [False] * 7


def test_pages(spark):
    html = '<title>T</title><script type="application/ld+json">{"@type":"X"}</script><nav>menu</nav><h1>Head</h1><p>Body <a href="/x#f">a link</a><br>more</p><div class="related-items">rel</div>'
    df = spark.createDataFrame([(html,), (None,), ("<p>Verify you are human",)], "h string")
    rows = df.select(pages.parsed_page(F.col("h")).alias("p"), pages.json_ld(F.col("h")).alias("j")).collect()
    assert (rows[0].p.title, rows[0].p.heading, rows[0].p.text) == ("T", "Head", "Head\nBody\na link\nmore")
    assert rows[0].p.links[0].anchor == "a link" and rows[0].j == ['{"@type": "X"}'] and rows[1].p.text == "" and rows[2].p.challenge
    links = spark.createDataFrame([("https://a/b/c", "../d#x"), ("https://a/", "mailto:x"), (None, None)], "b string, h string")
    assert [r.x for r in links.select(pages.resolved(F.col("b"), F.col("h")).alias("x")).collect()] == ["https://a/d", None, None]
    maps = spark.createDataFrame([('<urlset xmlns="http://x"><url><loc> https://a/b </loc></url></urlset>',), ("<bad",), ('<!DOCTYPE x [<!ENTITY e "x">]><a/>',)], "x string")
    assert [r.l for r in maps.select(pages.sitemap_links(F.col("x")).alias("l")).collect()] == [["https://a/b"], [], []]


def test_decoding_is_strict(spark):
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")), "latin-1"), (bytearray(b"\xe9"), None), (bytearray("�".encode()), None), (None, None), (bytearray(b"a"), "nope")], "p binary, c string")
    assert [r.t for r in df.select(pages.decoded_html(F.col("p"), F.col("c")).alias("t")).collect()] == ["é", None, None, None, None]


def test_fetch_refuses_what_is_not_allowed(spark):
    spark.dataSource.register(pages.FetchSource)
    rows = spark.read.format("fetch").option("urls", "http://a.example/x https://b.example/ https://u@a.example/").option("domains", "a.example").load().collect()
    assert [r.outcome for r in rows] == ["REFUSED"] * 3


def test_versions_and_logs(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/v")
    assert table.read() is None
    first = table.publish(spark.range(5))
    table.publish(spark.range(7))
    assert table.read().count() == 7
    table.point(first)
    assert table.read().count() == 5
    with pytest.raises(ValueError):
        table.point("v-none")
    sinks.append_log(spark.range(0), f"{tmp_path}/log")
    sinks.append_log(spark.range(2), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    with pytest.raises(ValueError):
        sinks.checked(spark.sql("select 'password: hunter22' as x"))
    text, markdown = sinks.report({"n": 1, "rows": [{"a": "api_key=12345678x"}]}, "T")
    assert "12345678x" not in text + markdown and "| a |" in markdown
