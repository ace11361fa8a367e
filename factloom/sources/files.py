"""File sources with explicit schemas: JSON documents, JSON lines, properties, archives, SQLite.

Nothing is inferred and nothing is repaired: a document with one bad row is rejected as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType([
    T.StructField("tmdbId", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("nextSeasonNumber", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("releaseDate", T.DateType()), T.StructField("releaseYear", T.IntegerType()),
    T.StructField("sourceName", T.StringType()), T.StructField("sourceUrl", T.StringType()), T.StructField("announcementDate", T.DateType()),
    T.StructField("lastChecked", T.DateType()),
])
CANONICAL = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("generatedAt", T.StringType()), T.StructField("series", T.ArrayType(FACT))])
#: Superset of the two row shapes of the change log.
CHANGE = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("tmdbId", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("old", FACT), T.StructField("new", FACT),
    *(T.StructField(n, T.StringType()) for n in ("rule", "provider", "sourceUrl")),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("supportingSourceUrls", "changedFields", "sourceUrls")),
    *(T.StructField(n, T.StringType()) for n in ("monitoredState", "promotionReason", "source")),
])


def json_document(spark: SparkSession, path: str, schema: T.StructType = CANONICAL, rows: str = "series") -> DataFrame:
    """Rows of the array ``rows`` of one JSON document, the document's other fields beside them."""
    document = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return document.select(*[c for c in document.columns if c != rows], F.posexplode(rows).alias("position", "row")).select(
        *[c for c in document.columns if c != rows], "position", "row.*"
    )


def json_lines(spark: SparkSession, path: str, schema: T.StructType = CHANGE) -> DataFrame:
    """JSON lines; blank lines are skipped, any other line must be an object."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stream_json_lines(spark: SparkSession, path: str, schema: T.StructType = CHANGE) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """Rows (name, value fields) of a JSON object keyed by name."""
    texts = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), value), {"mode": "FAILFAST"})
    return texts.select(F.explode(parsed).alias("name", "row")).select("name", "row.*")


def or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON rows of a path, or an empty table with the same schema if nothing is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path) if there else spark.createDataFrame([], schema)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, value) of key=value lines; comments and lines without "=" don't count, the last of a key wins."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[^#!=\s][^=]*="))
    pairs = lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substr(value, instr(value, '=') + 1)")).alias("value"), F.monotonically_increasing_id().alias("n"))
    return pairs.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, name, size, crc) of the entries of ZIP files; a broken archive gives one row with null name."""

    def read(batches):
        import io
        import zipfile

        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(file, i.filename, i.file_size, i.CRC) for i in z.infolist()]
                except zipfile.BadZipFile:
                    out.append((file, None, None, None))
            yield pd.DataFrame(out, columns=["path", "name", "size", "crc"]).astype({"size": "Int64", "crc": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, name string, size long, crc long")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of files, for a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def sqlite_table(
    spark: SparkSession, path: str, table: str, schema: str, where: str | None = None, order: str | None = None, limit: int | None = None, tasks: int = 1
) -> DataFrame:
    """A table of one SQLite file, of which the columns of ``schema`` are read.

    ``where``, ``order`` and ``limit`` are SQL and go to SQLite, so that its indexes serve them. With ``tasks`` the table is read
    in as many ranges of its row ids (not together with a limit); the file must be where all executors see it.
    """
    if limit is not None and tasks > 1:
        raise ValueError("a limit needs one task")
    columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in T.StructType.fromDDL(schema))
    quoted = '"' + table.replace('"', '""') + '"'

    def read(batches):
        import sqlite3

        for batch in batches:
            for task in batch["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    conditions = [f"({where})"] if where else []
                    if tasks > 1:
                        lo, hi = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), 0) + 1 FROM {quoted}").fetchone()
                        a, b = (lo + (hi - lo) * k // tasks for k in (task, task + 1))
                        conditions.append(f"rowid >= {a} AND rowid < {b}")
                    sql = f"SELECT {columns} FROM {quoted}" + (" WHERE " + " AND ".join(conditions) if conditions else "") + (f" ORDER BY {order}" if order else "") + (f" LIMIT {int(limit)}" if limit is not None else "")
                    yield from pd.read_sql_query(sql, db, chunksize=50_000)

    return spark.range(0, tasks, 1, tasks).mapInPandas(read, schema)


def strict_object(text: Column, keys: dict[str, str]) -> Column:
    """Whether a JSON text is an object with exactly these keys, once each, and values of these JSON types.

    Types are int, float, str, bool, list, dict or null; int doesn't take true or 1.0.
    """

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        import json

        kinds = {"int": int, "float": float, "str": str, "bool": bool, "list": list, "dict": dict, "null": type(None)}

        def good(t: str | None) -> bool:
            try:
                pairs = json.loads(t, object_pairs_hook=list) if t is not None else None
            except ValueError:
                return False
            if not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs) or sorted(p[0] for p in pairs) != sorted(keys):
                return False
            return t.lstrip().startswith("{") and all(type(v) is kinds[keys[k]] for k, v in pairs if keys[k] not in ("list", "dict"))

        return texts.map(good)

    return ok(text)
