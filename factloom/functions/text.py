"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
CARDINALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}
NUMBERS = CARDINALS | ORDINALS


def _plain_forms() -> tuple[str, str]:
    """Letters, blanks and width forms whose compatibility decomposition begins with one ASCII sign, and that sign."""
    signs = {c: "'" for c in "‘’“”"}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF01, 0xFF5F), 0x3000):
        kept = [x for x in unicodedata.normalize("NFKD", chr(code)) if x.isascii()]
        if len(kept) == 1:
            signs.setdefault(chr(code), kept[0].lower())
    return "".join(signs), "".join(signs.values())


ACCENTED, PLAIN = _plain_forms()
SPANISH_ENDS = r"[\n.!?;]+"

STOP_WORDS = ("the", "and", "of", "for", "with")


def folded(c: Column) -> Column:
    """Lower case, accents off, other signs beyond ASCII dropped, the rest but letters and digits as single spaces.

    In the JVM, by the table of single signs; :func:`normalized` is exact for ligatures and the like as well.
    """
    plain = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^\x00-\x7f]+", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normalized(c: Column) -> Column:
    """The same by full compatibility decomposition (NFKD)."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        import re

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = t.translate({ord(q): "'" for q in "‘’“”"})
            t = t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
            return re.sub("[^a-z0-9]+", " ", t.casefold()).strip()

        return texts.map(one)

    return plain(c)


def kept_accents(c: Column) -> Column:
    """Compatibility composition (NFKC), entities of HTML decoded, lower case, words joined by single spaces; accents stay."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        import html
        import re

        return texts.map(lambda t: None if t is None else " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", html.unescape(t)).casefold())))

    return plain(c)


def spanish_plain(c: Column) -> Column:
    """Dashes to -, ordinal marks to letters, hard blanks to blanks, trade marks off, lower case; accents stay."""
    marks = F.regexp_replace(F.translate(c, "–—‐‑−ªº\xa0’‘", "-----ao ''"), "[®™]", "")
    return F.trim(F.regexp_replace(F.lower(marks), r"\s+", " "))


def without_ellipsis(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s*(\.{3,}|…)\s*", " "))


def slug(c: Column) -> Column:
    return F.replace(folded(c), F.lit(" "), F.lit("-"))


def words(c: Column) -> Column:
    """Distinct words of more than two letters, without stop words."""
    return F.array_distinct(F.filter(F.split(folded(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def CARDINAL_MAP() -> Column:  # noqa: N802
    return F.create_map(*[x for w, n in CARDINALS.items() for x in (F.lit(w), F.lit(n))])


def ORDINAL_MAP() -> Column:  # noqa: N802
    return F.create_map(*[x for w, n in ORDINALS.items() for x in (F.lit(w), F.lit(n))])


def sentences(c: Column, ends: str = r"[\n.!?]+") -> Column:
    """Trimmed non-empty clauses between line breaks and sentence marks."""
    return F.filter(F.transform(F.split(c, ends), lambda s: F.trim(s)), lambda s: s != "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def number_word(c: Column) -> Column:
    """A number from digits or an English number word, else null."""
    return F.coalesce(F.try_element_at(F.map_concat(CARDINAL_MAP(), ORDINAL_MAP()), F.lower(c)), F.expr("1").cast("int") * c.try_cast("int"))


def season_number(c: Column) -> Column:
    """N of "season N" or of "N season", in digits or words; null if there is none."""
    names = "|".join(NUMBERS)
    after = F.regexp_extract(F.lower(c), rf"\bseason (\d+|{names})\b", 1)
    before = F.regexp_extract(F.lower(c), rf"\b(\d+|{names})(?:st|nd|rd|th)? (?:and final )?season\b", 1)
    return F.coalesce(number_word(F.nullif(after, F.lit(""))), number_word(F.nullif(before, F.lit(""))))


def bounded(c: Column, phrase: Column) -> Column:
    """Whether the phrase occurs between word boundaries, case and accents aside."""
    return F.contains(F.concat(F.lit(" "), folded(c), F.lit(" ")), F.concat(F.lit(" "), folded(phrase), F.lit(" ")))


def redacted(c: Column) -> Column:
    """Values of secret-looking assignments and parameters replaced by ***."""
    return F.regexp_replace(c, r"(?i)\b(token|secret|password|api[_-]?key|authorization)(\s*[=:]\s*)[^\s&\"',;]+", "$1$2***")


def base64url(c: Column) -> Column:
    """Base64 with the URL alphabet and without padding."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_")


def from_base64url(c: Column) -> Column:
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


# Wordings that a signal has.
SIGNALS = (
    ("renewal", r"renew|renueva|verlängert|renouvel|obnov"), ("cancellation", r"cancel|annul|otkaz|setzt .* ab"), ("final", r"final|última|letzte|dernière|posljednja"),
)


def signals(c: Column) -> Column:
    """Flags of what a text may tell: renewal, cancellation, final, date, year."""
    flags = [F.when(F.lower(c).rlike(p), name) for name, p in SIGNALS]
    return F.array_compact(F.array(*flags, F.when(c.rlike(r"[0-9]{1,2}\.? (de )?[A-Za-z]+"), "date"), F.when(c.rlike("20[0-9][0-9]"), "year")))


def named_alone(c: Column, phrase: Column) -> Column:
    """Whether the phrase occurs between word boundaries at least once without a "the" before it."""
    t, a = F.concat(F.lit(" "), folded(c), F.lit(" ")), folded(phrase)

    def times(p: Column) -> Column:
        return F.floor((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p))

    return times(F.concat(F.lit(" "), a, F.lit(" "))) > times(F.concat(F.lit(" the "), a, F.lit(" ")))


def access_class(seen: Column, status: Column) -> Column:
    """OPEN, BLOCKED, MISSING, FAILED or UNKNOWN from a page's lower-case text and its HTTP status."""
    blocked = status.isin(401, 403) | seen.rlike("captcha|verify you are human|access denied|unusual traffic|checking your browser")
    missing = (status == 404) | seen.rlike("not found")
    return F.when(blocked, "BLOCKED").when(missing, "MISSING").when(status >= 500, "FAILED").when(status.isNull(), "UNKNOWN").otherwise("OPEN")
