"""Keyed hashes, line codecs and percent-encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that need no percent-encoding.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256; null for null. The secret goes to the executors with the function."""

    @F.pandas_udf("string")
    def mac(messages: pd.Series) -> pd.Series:
        import hashlib
        import hmac

        return messages.map(lambda m: None if m is None else hmac.new(secret, m.encode(), hashlib.sha256).hexdigest())

    return mac(message)


def daily_pseudonym(identity: Column, at: Column, secret: bytes) -> Column:
    """A pseudonym that changes at midnight UTC."""
    return hmac_sha256(F.concat_ws(":", F.floor(F.unix_seconds(at) / 86400), identity), secret)


def normal_percent(url: Column) -> Column:
    """Percent-encoded unreserved characters decoded, other escapes in capitals, broken ones left alone."""

    @F.pandas_udf("string")
    def normal(urls: pd.Series) -> pd.Series:
        import re

        def one(m) -> str:
            c = chr(int(m[1], 16))
            return c if c in UNRESERVED else m[0].upper()

        return urls.map(lambda u: None if u is None else re.sub(r"%([0-9A-Fa-f]{2})", one, u))

    return normal(url)


def encode_line(version: int, fields: list[Column]) -> Column:
    """Fields as one line: version first, "|" between, each field base64url so that no mark can clash; null is "-"."""
    from factloom.functions.text import base64url

    return F.concat_ws("|", F.lit(str(version)), *[F.coalesce(F.concat(F.lit("="), base64url(f.cast("string"))), F.lit("-")) for f in fields])


def decode_line(line: Column, version: int, names: list[str]) -> Column:
    """The struct of a line's fields; null if the version or the number of fields is another or a field is broken."""
    from factloom.functions.text import from_base64url

    parts = F.split(line, r"\|")
    good = (F.size(parts) == len(names) + 1) & (parts[0] == str(version)) & line.rlike(r"^\d+(\|(-|=[A-Za-z0-9_-]*))*$")
    fields = [F.when(F.get(parts, F.lit(i)) != "-", from_base64url(F.substring(F.get(parts, F.lit(i)), 2, (1 << 31) - 1))).alias(n) for i, n in enumerate(names, 1)]
    return F.when(good, F.struct(*fields))
