"""Claims from text: sentences that name a series, a season and what becomes of it.

Only built-in expressions, so that the extraction stays in the JVM. A claim has a kind (renewed, canceled,
final, premiere), a season and a date; a sentence that denies, doubts or asks makes no claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X

# Wordings of a claim, strongest first, and of doubt.
KINDS = (
    ("FINAL", r"(?i)\b(final season|last season|letzte staffel|última temporada|posljednja sezona|dernière saison)\b"),
    ("CANCELED", r"(?i)\b(cancel(?:s|ed|led)|cancela|annulée?|setzt .* ab|otkazana)\b"),
    ("RENEWED", r"(?i)\b(renew(?:s|ed)|renueva|renouvelle|a renouvelé|ha renovado|verlängert|je obnovio)\b"),
    ("PREMIERE", r"(?i)\b(premieres|se estrena|startet am|arrivera le|počinje)\b"),
)
DOUBT = r"(?i)\b(not|never|won't|wouldn't|isn't|may|might|could|rumou?r(?:s|ed)?|reportedly|whether|no|kein(?:e|en)?|aún no|pas|nije)\b|\?"


def claim_kind(sentence: Column) -> Column:
    """The first kind whose wording the sentence has, null for none."""
    return F.coalesce(*[F.when(sentence.rlike(pattern), name) for name, pattern in KINDS])


def extract_claims(documents: DataFrame, key: str, text: str, announced: str, aliases: Column | None = None) -> DataFrame:
    """Rows (key, position, sentence, kind, season, day) of the claims in each text.

    ``aliases`` is an array column; if given, a sentence must name one of them. Null texts give no rows. Season and
    day are null where the sentence has none; a date without year takes it from the column ``announced``.
    """
    any_kind = "(?i)" + "|".join(p.removeprefix("(?i)") for _, p in KINDS)
    cut = documents.where(F.col(text).rlike(any_kind)).select(key, announced, *([aliases.alias("_aliases")] if aliases is not None else []), F.posexplode(X.sentences(F.col(text))).alias("position", "sentence"))
    s = F.col("sentence")
    said = cut.withColumn("kind", claim_kind(s)).where("kind is not null").where(~s.rlike(DOUBT))
    if aliases is not None:
        said = said.where(F.exists("_aliases", lambda a: X.bounded(s, a)))
    day = F.coalesce(D.english_date(s, F.col(announced)), D.spanish_date(s))
    return said.select(key, "position", "sentence", "kind", X.season_number(s).alias("season"), day.alias("day"))
