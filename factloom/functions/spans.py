"""Places in texts: spans of patterns, nearest spans, excerpts around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start: int, stop: int, text: string>>"


def spans(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a pattern with their offsets, in order; empty for null.

    The built-in functions give matches without offsets, hence Python in Arrow batches. Select the result
    as a column before it goes into the functions below: a lambda can't hold a Python function.
    """

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        import regex

        p = regex.compile(pattern, regex.IGNORECASE)
        return texts.map(lambda t: [] if t is None else [{"start": m.start(), "stop": m.end(), "text": m[0]} for m in p.finditer(t)])

    return found(text)


def distance(a: Column, b: Column) -> Column:
    """Characters between two spans, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), a["start"] - b["stop"], b["start"] - a["stop"])


def nearest(span: Column, others: Column, within: int) -> Column:
    """The span of ``others`` nearest to ``span`` and at most ``within`` away, the earlier on ties; null for none."""
    near = F.filter(others, lambda o: distance(span, o) <= within)
    return F.array_min(F.transform(near, lambda o: F.struct(distance(span, o).alias("gap"), o["start"].alias("start"), o["stop"].alias("stop"), o["text"].alias("text"))))


def latest_before(span: Column, others: Column, within: int) -> Column:
    """The last span of ``others`` that ends at or before the start of ``span`` and at most ``within`` before."""
    before = F.filter(others, lambda o: (o["stop"] <= span["start"]) & (span["start"] - o["stop"] <= within))
    return F.array_max(before)


def pairs(claims: Column, references: Column, within: int) -> Column:
    """For each claim the nearest reference within reach: array of (claim, reference), claims without one left out."""
    joined = F.transform(claims, lambda c: F.struct(c.alias("claim"), nearest(c, references, within).alias("reference")))
    return F.filter(joined, lambda x: x["reference"].isNotNull())


def excerpt(text: Column, first: Column, last: Column, most: int = 200) -> Column:
    """The text from the earlier to the later of two spans, widened evenly up to ``most`` characters."""
    start, stop = F.least(first["start"], last["start"]), F.greatest(first["stop"], last["stop"])
    room = F.greatest(F.lit(0), F.floor((F.lit(most) - (stop - start)) / 2)).cast("int")
    begin = F.greatest(F.lit(0), start - room)
    return F.trim(F.substring(text, begin + 1, F.least(F.lit(most), stop + room - begin)))
