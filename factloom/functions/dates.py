"""Dates and instants as Column expressions; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English and Spanish months.
MONTHS = "january february march april may june july august september october november december".split()
MESES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def _month(c: Column, names: list[str], short: bool) -> Column:
    table = {n: i for i, n in enumerate(names, 1)} | ({n[:3]: i for i, n in enumerate(names, 1)} if short else {})
    return F.try_element_at(F.create_map(*[x for n, i in table.items() for x in (F.lit(n), F.lit(i))]), F.lower(c))


def iso_date(c: Column) -> Column:
    """Strictly yyyy-mm-dd at the start of the text, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10).try_cast("date"))


_EN = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS)
_MONTH_FIRST = rf"(?i)\b({_EN})\.? (\d{{1,2}})(?:st|nd|rd|th)?(?:,? (\d{{4}}))?\b"
_DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)? ({_EN})\.?(?:,? (\d{{4}}))?\b"
#: A text without a match has no English date.
ANY_ENGLISH_DATE = rf"(?i)\b(?:{_EN})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?\b|\b\d{{1,2}}(?:st|nd|rd|th)? (?:{_EN})\b"


def english_date(c: Column, announced: Column) -> Column:
    """First "Month D[st], YYYY", else first "D Month YYYY"; without a year the announcement's, or the next if it would precede it.

    Full names and three-letter forms count. Null for impossible days and where no date is found. The text is searched once
    for each of the two orders; what is found is taken apart afterwards.
    """
    found = F.regexp_extract(c, _MONTH_FIRST, 0)
    said = F.when(found != "", found).otherwise(F.regexp_extract(c, _DAY_FIRST, 0))
    month = _month(F.regexp_extract(said, r"([A-Za-z]{3,})\.?(?: |,|$)", 1), MONTHS, True)
    month = F.coalesce(month, _month(F.regexp_extract(said, r"^([A-Za-z]+)", 1), MONTHS, True))
    day = F.regexp_extract(said, r"(?:^|[^\d])(\d{1,2})(?!\d)", 1).try_cast("int")
    year = F.regexp_extract(said, r"(\d{4})$", 1).try_cast("int")

    def made(y: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", y, month, day).try_cast("date")

    guess = made(F.year(announced))
    return F.when(year.isNotNull(), made(year)).when(guess < announced, made(F.year(announced) + 1)).otherwise(guess)


def spanish_date(c: Column) -> Column:
    """First "D de mes de YYYY", else null."""
    p = rf"(?i)\b(\d{{1,2}}) de ({'|'.join(MESES)}) de (\d{{4}})\b"
    month = _month(F.regexp_extract(c, p, 2), MESES, False)
    return F.format_string("%04d-%02d-%02d", F.regexp_extract(c, p, 3).try_cast("int"), month, F.regexp_extract(c, p, 1).try_cast("int")).try_cast("date")


def instant(c: Column) -> Column:
    """Timestamp of an ISO text that names its offset; null without one."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def is_stale(last: Column, now: Column, hours: int) -> Column:
    """Older than ``hours``; never synced counts as stale."""
    return last.isNull() | (last + F.make_dt_interval(hours=F.lit(hours)) < now)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header in seconds or as a date, within one second and six hours."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(F.trim(header).try_cast("long"), F.unix_seconds(date) - F.unix_seconds(now))
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(1)), F.lit(21600)))


def ordinal_day(d: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 719163


def premiere_year(c: Column) -> Column:
    """First year without a day for a premiere ("premieres in 2027"), else null."""
    return F.regexp_extract(F.lower(c), r"\b(?:premieres|returns|debuts|arrives|streams) in (20[0-9]{2})\b", 1).try_cast("int")


def first_full_date(c: Column) -> Column:
    """Struct (found, day) of the first "Month D, YYYY" of a text; a day that doesn't exist is null."""
    p = "\\b(" + "|".join(m.capitalize() for m in MONTHS) + ") ([0-9]{1,2}), ([0-9]{4})\\b"
    whole = F.regexp_extract(c, p, 0)
    parts = F.split(F.replace(whole, F.lit(","), F.lit("")), " ")
    day = F.format_string("%s-%02d-%02d", F.get(parts, F.lit(2)), _month(F.get(parts, F.lit(0)), MONTHS, False), F.get(parts, F.lit(1)).try_cast("int")).try_cast("date")
    return F.struct((whole != "").alias("found"), day.alias("day"))


def spanish_date_near(c: Column, published: Column, within: int = 183) -> Column:
    """Struct (found, day) of the first "D de mes [de YYYY]"; without a year only up to ``within`` days after publication, in its year."""
    p = rf"(?i)\b([0-9]{{1,2}}) de ({'|'.join(MESES)})(?: de ([0-9]{{4}}))?\b"
    parts = F.split(F.lower(F.regexp_extract(c, p, 0)), " de ")
    given = F.get(parts, F.lit(2)).try_cast("int")
    day = F.format_string("%04d-%02d-%02d", F.coalesce(given, F.year(published)), _month(F.get(parts, F.lit(1)), MESES, False), F.get(parts, F.lit(0)).try_cast("int")).try_cast("date")
    return F.struct((F.size(parts) > 1).alias("found"), F.when(given.isNotNull() | F.datediff(day, published).between(0, within), day).alias("day"))


def plausible(day: Column, latest: Column) -> Column:
    """From 1900 on and not after ``latest``."""
    return day.between(F.lit("1900-01-01").cast("date"), latest)
