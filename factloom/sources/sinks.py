"""Sinks: versioned tables with an atomic pointer, append-only logs, redacted reports, upserts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import hadoop, replace_file

# Texts that must never be written.
CREDENTIAL = r"(?i)(bearer\s+[a-z0-9._-]{16,}|authorization\s*[:=]|api[_-]?key\s*[:=]\s*\S{8,}|password\s*[:=]\s*\S+|-----BEGIN [A-Z ]*PRIVATE KEY-----)"


class VersionedTable:
    """A table of which each version is a folder and a pointer file names the current one.

    A version is written, read back and compared by count before the pointer moves, so readers see the
    old or the new version whole, and a job that dies leaves the old one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        at, fs = hadoop(self.spark, f"{self.path}/CURRENT")
        return self.spark.read.text(at.toString(), wholetext=True).first()[0].strip() if fs.exists(at) else None

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def publish(self, rows: DataFrame) -> str:
        version = f"v-{uuid.uuid4().hex}"
        observed = F.count(F.lit(1)).alias("n")
        from pyspark.sql import Observation

        seen = Observation()
        rows.observe(seen, observed).write.parquet(f"{self.path}/{version}")
        if self.spark.read.parquet(f"{self.path}/{version}").count() != seen.get["n"]:
            raise OSError("the version read back is not the one written")
        self.point(version)
        return version

    def point(self, version: str) -> None:
        """Make a version the current one; a version that isn't there is refused (also the way back)."""
        at, fs = hadoop(self.spark, f"{self.path}/{version}")
        if not fs.exists(at):
            raise ValueError(f"no version {version}")
        replace_file(self.spark, f"{self.path}/CURRENT", version)


class VersionedSet(VersionedTable):
    """Several tables, data and log say, that are published together or not at all: a version is a folder with one table each."""

    def read_all(self) -> dict[str, DataFrame]:
        version = self.current()
        if version is None:
            return {}
        at, fs = hadoop(self.spark, f"{self.path}/{version}")
        return {s.getPath().getName(): self.spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(at) if s.isDirectory()}

    def publish_all(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables, read them back, move the pointer; whatever fails before that leaves the old version in place."""
        from pyspark.sql import Observation

        version = f"v-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{version}/{name}")
            if self.spark.read.parquet(f"{self.path}/{version}/{name}").count() != seen.get["n"]:
                raise OSError(f"{name}, read back, is not what was written")
        self.point(version)
        return version


def write_report(spark: SparkSession, summary: dict, title: str, cases: DataFrame, path: str) -> None:
    """A report as report.json, report.md and cases.jsonl (a folder); credentials in the summary are redacted, in a case they stop it all."""
    as_json, as_text = report(summary, title)
    checked(cases).write.mode("overwrite").json(f"{path}/cases.jsonl")
    replace_file(spark, f"{path}/report.json", as_json)
    replace_file(spark, f"{path}/report.md", as_text)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines appended to a log folder; nothing is written for no rows."""
    if not rows.isEmpty():
        rows.write.mode("append").json(path)


def checked(rows: DataFrame) -> DataFrame:
    """The same rows, provided that no text in them looks like a credential; raises otherwise."""
    texts = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    if not rows.select(texts.alias("t")).where(F.col("t").rlike(CREDENTIAL)).isEmpty():
        raise ValueError("a row holds what looks like a credential")
    return rows


def report(summary: dict, title: str) -> tuple[str, str]:
    """JSON and Markdown of a small summary (scalars, lists, dicts), credentials redacted."""
    def clean(x: str) -> str:
        return re.sub(CREDENTIAL, "***", x)

    lines = [f"# {title}", ""]
    for key, value in summary.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            head = list(value[0])
            lines += [f"## {key}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
            lines += ["| " + " | ".join(str(r.get(h, "")) for h in head) + " |" for r in value] + [""]
        else:
            lines += [f"- {key}: {value}"]
    return clean(json.dumps(summary, ensure_ascii=False, indent=2, default=str)), clean("\n".join(lines) + "\n")
