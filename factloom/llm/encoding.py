"""Text decoded with the wrong character encoding: found and restored.

Method: smoothed character n-gram models trained on the clean records of the data itself score every
candidate chain "encode with the decoder that was wrongly used, decode with the encoding that was meant";
the likeliest candidate is accepted if it beats the text as it stands by a margin that is validated
on held-out clean records and on corruptions made from them.

Model: character trigrams with back-off to bigrams and single characters (Dirichlet smoothing). Counts of
all clean records are kept in hash tables of fixed size: each task counts the tokens of its own partition, the
partial tables are added up in one small shuffle, and their size is bounded whatever the data.
Clean, for the training, is a record that no chain to UTF-8 fits and that has no other sign of
damage (:data:`DAMAGED`); records that the first model doubts are taken out of the counts again
(:func:`retrain`). Whether a record is affected is decided by the model alone.

Everything works on tokens between plain spaces, since words repeat: what is known of a token (no sign of
damage, no chain that gains anything, or the gains of all chains) is remembered within bounds, and all
candidates of a token are scored in one go over arrays. Chains:

* utf8: UTF-8 read as a one-byte or Chinese, Japanese or Korean encoding, as many times over as it
  was, in each run of non-ASCII signs;
* legacy: every one-byte, Chinese, Japanese, Korean or Vietnamese encoding of :data:`LEGACY` read as any one-byte
  one, UTF-16 read in place of ASCII or the other way round, UTF-7 and ISO-2022 left as they are;
* lossy: UTF-8 read as a one-byte encoding, with control characters dropped or blanks changed afterwards.
  The bytes are gone; the likeliest filling from the characters of the clean records is proposed.

Chains are taken one after the other until none is accepted any more, so that parts of a text that were
garbled in different ways are each restored. A replacement character U+FFFD is damage as such; what it
stood for is not restored, what was garbled beside it is.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import shared_dir

# Names of the encodings that take part.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "cp852", "koi8-r", "iso8859-2", "cp1253", "cp1254", "iso8859-15", "cp866")
ONE_BYTE = (
    *WRONG, "iso8859-5", "mac-cyrillic", "koi8-u", "iso8859-7", "cp737", "mac-greek", "iso8859-9", "cp857", "mac-turkish", "cp1257", "cp1258",
    "mac-latin2", "iso8859-16", "cp861", "mac-iceland",
)
#: Meant encodings whose signs and bytes aren't one to one, Vietnamese with its tones apart included.
SINGLE, MIXED = tuple(w for w in ONE_BYTE if w != "cp1258"), ("cp1258", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Encodings of several bytes a sign that UTF-8 was read as, and those that switch alphabets by an escape sign.
SEVERAL, ESCAPED = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr"), ("iso2022_jp_2", "iso2022_kr")
#: Every legacy encoding of the languages present read as every other one, row by row.
LEGACY = tuple((w, meant) for w in ONE_BYTE for meant in (*SINGLE, *MIXED))
#: Confusions that are met more often than the rest, which pay for their number (nats).
COMMON = (
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "iso8859-5"), ("cp1251", "mac-cyrillic"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1253"), ("cp1251", "cp1253"), ("cp1253", "cp1251"), ("latin-1", "iso8859-5"),
    ("cp1252", "shift_jis"), ("cp437", "shift_jis"), ("mac-roman", "shift_jis"), ("cp1251", "shift_jis"), ("cp1252", "euc_jp"),
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "cp1254"), ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"),
    ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp1252", "cp1257"), ("cp1252", "iso8859-2"),
)
RARE = math.log(len(LEGACY) / len(COMMON))
#: What can be garbled at all: signs beyond ASCII, control characters (UTF-16 read as one-byte text), UTF-7.
REACHED = r"[^\t\n\r\x20-\x7E]|\+[A-Za-z0-9+/]{3,}"
#: Longest token that is remembered, and how many of them.
LONG, REMEMBERED = 256, 1 << 18
#: So many of the most frequent tokens are judged once, for all tasks; each task judges the others itself.
FREQUENT = 1 << 15

BITS3, BITS2, BITS1 = 20, 18, 16
SIZE = (1 << BITS3) + (1 << BITS2) + (1 << BITS1)
#: One clean text in ``HELD_OUT`` (by hash) stays out of the training; all of those validate the margins.
HELD_OUT = 64
#: Least margins in nats. Validation raises one where that spares more clean texts than it loses corrupted ones.
MARGINS = {"utf8": 3.0, "whole": 4.0, "legacy": 20.0, "lossy": 6.0}
#: Places of the validation's histograms of gains, and nats from one to the next.
PLACES, STEP = 2048, 0.25
#: Gains from which on the first model doubts a record of its own training.
DOUBT, DOUBT_TOKEN = {"whole": 1.0, "lossy": 4.0}, 0.5
#: Nats that a character unknown to the clean records costs a candidate.
UNKNOWN = 10.0
#: Strength of the back-off distributions, in counts.
BACK_OFF = 4.0
#: One in so many clean texts may be less like the others than a restored one may be.
ODD = 500
#: A token takes part in a record's evidence from this gain on (nats).
TOKEN_GAIN = 2.0

_M = np.uint32
_K = (2654435761, 2246822519, 3266489917)


@lru_cache(maxsize=64)
def byte_table(encoding: str) -> list[str]:
    """Characters of the bytes 0x80 to 0xff; undefined bytes come through as control characters."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _class(chars: list[str]) -> str:
    """A character class, in ranges: regular expressions of the JVM try its parts one by one."""
    runs: list[list[int]] = []
    for code in sorted({ord(c) for c in chars}):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs) + "]"


def utf8_shape(encoding: str) -> str:
    """Pattern of one UTF-8 sequence of two to four bytes as ``encoding`` shows it."""
    t = byte_table(encoding)
    tail = _class(t[:0x40])
    return f"{_class(t[0x42:0x60])}{tail}|{_class(t[0x60:0x70])}{tail}{{2}}|{_class(t[0x70:0x75])}{tail}{{3}}"


def unnatural_shape(encoding: str) -> str:
    """The same without what well-formed words may hold: small letters that follow a small letter."""
    t = byte_table(encoding)
    parts = []
    for lead, n in ((t[0x42:0x60], 1), (t[0x60:0x70], 2), (t[0x70:0x75], 3)):
        small = sum(c.islower() for c in lead) > len(lead) / 4
        parts.append(f"{_class(lead)}{_class([c for c in t[:0x40] if not (small and c.islower())])}{{{n}}}")
    return "|".join(parts)


#: Signs of damage that keep a record out of the training: replacement and control characters, UTF-8 shapes,
#: long runs of upper Latin-1, capitals inside Cyrillic or Greek words, frames inside words, ASCII in UTF-16,
#: letters followed by a symbol as remains of a sequence, UTF-7. No sign reaches across a plain space.
_PRINTABLE = "".join(f"{chr(h << 8 | 0x20)}-{chr(h << 8 | 0x7E)}" for h in range(0x20, 0x7F) if h != 0x30)
_LETTER = r"[^\W\d_]"
DAMAGED = re.compile("(?=[^\\x00-\\x7f])(?:" + "|".join(
    [
        "[\x80-\x9f�]", "[\xa0-\xff]{4,}", "[а-џ][Ѐ-Я]|[α-ώ][Α-Ϋ]",
        f"(?<={_LETTER})[─-╿√∞-≥]|[─-╿√∩]{_LETTER}", f"[{_PRINTABLE}]{{4,}}",
        f"[\xc2-\xf4][\xa2-\xa9\xac\xaf-\xb4\xb6\xb8\xb9\xbc-\xbf]|(?<!{_LETTER})\xe2(?!{_LETTER})",
    ]
    + [unnatural_shape(w) for w in WRONG]
) + r")|[\x00-\x08\x1b]|\+[A-Za-z0-9+/]{3,}-")
#: Runs of UTF-16 units whose two bytes are printable ASCII.
_PAIRS = re.compile(f"[{_PRINTABLE}{chr(0x3020)}-{chr(0x307E)}]{{2,}}")
_REACHED, _CONTROLS = re.compile(REACHED), re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{3,}-?")


class Sound:
    """Tells whether texts show no sign of damage; remembers tokens without one."""

    def __init__(self) -> None:
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        tokens = text.split(" ")
        if self.known.issuperset(tokens):
            return True
        for token in tokens:
            if token not in self.known:
                if DAMAGED.search(token):
                    return False
                _remember(self.known, token)
        return True


def _remember(known: set[str], token: str) -> None:
    if len(token) <= LONG:
        if len(known) >= REMEMBERED:
            known.clear()
        known.add(token)


class Model:
    """Log-probabilities of strings, from the summed count table."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts.astype(np.float64)
        self.c3 = counts[: 1 << BITS3]
        self.c2 = counts[1 << BITS3 : (1 << BITS3) + (1 << BITS2)]
        self.c1 = counts[(1 << BITS3) + (1 << BITS2) :]
        self.total = float(self.c1.sum())
        self.p1 = (self.c1 + 0.05) / (self.total + 0.05 * (1 << BITS1))

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of c after a and b, over arrays of code points."""
        h1c, h1b = hash1(c), hash1(b)
        p = (self.c2[hash2(b, c)] + BACK_OFF * self.p1[h1c]) / (self.c1[h1b] + BACK_OFF)
        return np.log((self.c3[hash3(a, b, c)] + BACK_OFF * p) / (self.c2[hash2(a, b)] + BACK_OFF))

    def first(self, c: np.ndarray) -> np.ndarray:
        """Of a token's first character, judged after the space alone."""
        return np.log((self.c2[hash2(np.full_like(c, 32), c)] + 0.5) / (self.c1[32] + 0.5 * (1 << BITS1)))

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Of tokens between spaces, all of them in one go."""
        codes = _codes("".join([f" {t} " for t in tokens]))
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 2
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(len(codes))
        out[2:] = self.logs(codes[:-2], codes[1:-1], codes[2:])
        out[starts] = 0.0
        out[starts + 1] = self.first(codes[starts + 1])
        return np.add.reduceat(out, starts)

    def score(self, token: str) -> float:
        return float(self.scores([token])[0])

    def known(self, c: np.ndarray) -> np.ndarray:
        return self.c1[hash1(c)] > 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=_M)


def hash1(c):
    """Place of a character: itself, or for those beyond 16 bits one of the 2,048 that stand for none."""
    if isinstance(c, int):
        return c if c < 0x10000 else 0xD800 + ((c * _K[2] & 0xFFFFFFFF) >> 21)
    return np.where(c < 0x10000, c, _M(0xD800) + ((c * _M(_K[2])) >> _M(21)))


def hash2(b, c):
    if isinstance(c, int):
        return (((b * _K[0] + c) & 0xFFFFFFFF) * _K[1] & 0xFFFFFFFF) >> (32 - BITS2)
    return ((b * _M(_K[0]) + c) * _M(_K[1])) >> _M(32 - BITS2)


def hash3(a, b, c):
    if isinstance(c, int):
        return ((((a * _K[0] + b) & 0xFFFFFFFF) * _K[1] + c & 0xFFFFFFFF) * _K[2] & 0xFFFFFFFF) >> (32 - BITS3)
    return (((a * _M(_K[0]) + b) * _M(_K[1]) + c) * _M(_K[2])) >> _M(32 - BITS3)


def count_into(table: np.ndarray, texts: list[str], weights: list[int] | None = None) -> None:
    """Add the n-grams of ``texts`` to the table, all texts at once, each as often as its weight says."""
    if not texts:
        return
    codes = _codes("".join([f"  {t} " for t in texts]))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 3
    inside = np.ones(len(codes), dtype=bool)
    for k in (0, 1):
        inside[np.cumsum(sizes) - sizes + k] = False
    inside = inside[2:]
    a, b, c = codes[:-2][inside], codes[1:-1][inside], codes[2:][inside]
    n = None if weights is None else np.repeat(np.asarray(weights, dtype=np.float64), sizes - 2)
    for at, bits, places in ((0, BITS3, hash3(a, b, c)), (1 << BITS3, BITS2, hash2(b, c)), ((1 << BITS3) + (1 << BITS2), BITS1, hash1(c))):
        table[at : at + (1 << bits)] += np.bincount(places, n, minlength=1 << bits).astype(table.dtype)


#: Makes, in a task, the test whether a text is counted.
Accepts = Callable[[], Callable[[str], bool]]


def _counted(texts: DataFrame, accepts: Accepts) -> tuple[np.ndarray, list[str]]:
    """Count table of the accepted ones of a DataFrame with one text column, and the most frequent tokens beyond ASCII.

    At most ``SIZE`` sums and ``FREQUENT`` tokens reach the driver, and so much of each task the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted, table, seen, often = accepts(), np.zeros(SIZE, dtype=np.int64), Counter(), Counter()

        def flush() -> None:
            seen.pop("", None)
            count_into(table, list(seen), list(seen.values()))
            often.update({t: n for t, n in seen.items() if n > 1 and len(t) <= LONG and _REACHED.search(t)})
            kept = often.most_common(FREQUENT)
            often.clear()
            often.update(dict(kept))
            seen.clear()

        for batch in batches:
            seen.update(chain.from_iterable([t.split(" ") for t in batch.column(0).to_pylist() if accepted(t)]))
            if len(seen) > REMEMBERED or batch.nbytes > 1 << 24:
                flush()
        flush()
        at = np.flatnonzero(table)
        tokens = list(often)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*at.tolist(), *[-1] * len(tokens)], pa.int32()), pa.array([*[""] * len(at), *tokens], pa.string()),
                pa.array([*table[at].tolist(), *often.values()], pa.int64()),
            ], names=["at", "token", "n"],
        )

    shared_dir(texts.sparkSession)
    sums = texts.mapInArrow(count, "at int, token string, n long").groupBy("at", "token").agg(F.sum("n").alias("n")).checkpoint()
    grams = sums.where("at >= 0").select("at", "n").toPandas()
    table = np.zeros(SIZE, dtype=np.int64)
    table[grams["at"].to_numpy(dtype=np.int64)] = grams["n"].to_numpy(dtype=np.int64)
    often = sums.where("at < 0").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()
    return table.astype(np.float32), often["token"].tolist()


def train(texts: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Count table of the texts without signs of damage, and their most frequent tokens beyond ASCII."""
    return _counted(texts, Sound)


class Readings:
    """What tokens can have been before they were decoded; no model is asked."""

    def __init__(self) -> None:
        self.back = {w: {i: i for i in range(0x80)} | {ord(c): 0x80 + i for i, c in reversed(list(enumerate(byte_table(w))))} for w in ONE_BYTE}
        self.shapes = {w: re.compile(utf8_shape(w)) for w in WRONG}
        self.sequences: dict[str, dict[str, str]] = {w: {} for w in WRONG}
        self.of_signs = lru_cache(maxsize=1 << 13)(self._of_signs)

    def encode(self, text: str, w: str) -> bytes | None:
        """The bytes that ``w`` shows as this text; null if it can't."""
        try:
            return codecs.charmap_encode(text, "strict", self.back[w])[0]
        except UnicodeEncodeError:
            return None

    def as_utf8(self, token: str, w: str) -> str:
        """The token with each sequence that is UTF-8 under ``w`` decoded."""
        back, known = self.back[w], self.sequences[w]

        def mend(match: re.Match) -> str:
            shown = match[0]
            if shown not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                try:
                    known[shown] = codecs.charmap_encode(shown, "strict", back)[0].decode()
                except UnicodeDecodeError:
                    known[shown] = shown
            return known[shown]

        return self.shapes[w].sub(mend, token)

    def utf8_all(self, token: str, depth: int = 1, seen: set[str] | None = None) -> Iterator[tuple[str, str]]:
        """(chain, candidate), for UTF-8 read wrongly any number of times; each time makes a token longer, so this ends.

        Beyond three times a candidate that was met before isn't followed again under another name.
        """
        seen = set() if seen is None else seen
        for w in WRONG:
            if self.shapes[w].search(token):
                mended = self.as_utf8(token, w)
                if mended != token and (depth <= 3 or mended not in seen):
                    seen.add(mended)
                    yield f"utf8<{w}", mended
                    for name, again in self.utf8_all(mended, depth + 1, seen):
                        yield f"{name}<{w}", again
        if depth == 1 and any("\u1100" <= c < "\uff00" for c in token):
            for w in SEVERAL:
                mended = _recoded(token, w)
                if mended is not None and mended != token:
                    yield f"utf8<{w}", mended

    def wide_all(self, token: str) -> Iterator[tuple[str, str]]:
        """(chain, candidate), for UTF-16 in place of ASCII or the other way round, UTF-7 and escape sequences."""
        if "\0" in token:
            yield "ascii<utf-16<latin-1", token.replace("\0", "")
        if "\x1b" in token and token.isascii():
            for meant in ESCAPED:
                mended = _decoded(token.encode(), meant)
                if mended is not None and mended != token:
                    yield f"{meant}<ascii", mended
        if "+" in token:
            mended = _UTF7.sub(_of_utf7, token)
            if mended != token:
                yield "utf-7<ascii", mended
        for order in ("utf-16-le", "utf-16-be"):
            mended = _PAIRS.sub(lambda m: _ascii_of(m[0], order), token)
            if mended != token:
                yield f"ascii<{order}", mended

    def _of_signs(self, signs: str) -> tuple[list[str], np.ndarray]:
        """Candidates of non-ASCII signs by every pair of one-byte encodings, and the candidate of each pair; 0 is none."""
        found, place, raws = {signs: 0}, np.zeros((len(ONE_BYTE), len(SINGLE) + len(MIXED)), dtype=np.int32), {}
        for i, w in enumerate(ONE_BYTE):
            raw = self.encode(signs, w)
            if raw is None:
                continue
            if raw not in raws:
                raws[raw] = i
                for j, meant in enumerate(SINGLE):
                    mended = _decoded(raw, meant)
                    if mended is not None and mended != signs:
                        place[i, j] = found.setdefault(mended, len(found))
            else:
                place[i] = place[raws[raw]]
        return list(found), place.ravel()

    def mixed(self, token: str) -> tuple[list[str], list[tuple[int, int]]]:
        """Candidates of a token by the encodings whose signs and bytes aren't one to one: (pair, candidate)."""
        found: dict[str, int] = {}
        pairs, raws = [], {}
        for i, w in enumerate(ONE_BYTE):
            raw = self.encode(token, w)
            if raw is None:
                continue
            if raw not in raws:
                told = raws[raw] = []
                for j, meant in enumerate(MIXED, len(SINGLE)):
                    mended = _decoded(raw, meant)
                    if mended is not None and mended != token:
                        told.append((j, found.setdefault(mended, len(found))))
            pairs += [(i * (len(SINGLE) + len(MIXED)) + j, at) for j, at in raws[raw]]
        return list(found), pairs


@lru_cache(maxsize=1)
def readings() -> Readings:
    """One for each worker process, whatever models it sees."""
    return Readings()


class Chains:
    """Candidates of tokens, and what the model says of them."""

    def __init__(self, counts: np.ndarray, token_gain: float = TOKEN_GAIN) -> None:
        self.model, self.token_gain, self.read = Model(counts), token_gain, readings()
        self.lossy = {w: self._lossy(w) for w in ("latin-1", "cp1252", "cp1250")}
        self.knows = lru_cache(maxsize=1 << 16)(lambda c: bool(self.model.known(ord(c))))
        self.gains = lru_cache(maxsize=1 << 16)(self._gains)
        self.legacy = lru_cache(maxsize=1 << 14)(self._legacy)
        #: Tokens that no chain makes likelier by as much as counts.
        self.dull: set[str] = set()
        self.seeded = False
        self.cost = np.array([0.0 if pair in COMMON else RARE for pair in LEGACY], dtype=np.float32)

    def _lossy(self, encoding: str) -> tuple[re.Pattern, dict[str, list[str]]]:
        """What is left of each known character when its bytes are shown and some of them lost."""
        shown = byte_table(encoding)
        left: dict[str, list[str]] = {}
        for code in np.flatnonzero(self.model.c1 >= 2).tolist():
            if code < 0xA0 or 0xD800 <= code < 0xE000:
                continue
            whole = "".join(shown[b - 0x80] for b in chr(code).encode())
            for key in {re.sub(r"[\x80-\x9f]", "", whole), re.sub(r"[\x80-\xa0]", "", whole), whole.replace("\xa0", " "), re.sub(r"[\x80-\x9f]", "", whole).replace("\xad", "")}:
                if key and key != whole and key[0] == whole[0]:
                    left.setdefault(key, []).append(chr(code))
        keys = sorted(left, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, keys)) or r"(?!)"), left

    def _lossy_all(self, token: str) -> Iterator[tuple[str, str]]:
        for w, (pattern, left) in self.lossy.items():
            if not pattern.search(token):
                continue
            out, at = "", 0
            base = self.read.as_utf8(token, w) if self.read.shapes[w].search(token) else token
            for m in pattern.finditer(base):
                out += base[at : m.start()]
                at, after = m.end(), base[m.end() : m.end() + 2]
                choices = [*left[m[0]], m[0]]
                told = self.model.scores([out[-3:] + c + after for c in choices])
                told[-1] += 1.0
                out += choices[int(np.argmax(told))]
            out += base[at:]
            if out != base:
                yield f"utf8<{w}<lossy", out

    def _against(self, token: str, candidates: list[str]) -> np.ndarray:
        """Gains of candidates over the token, characters unknown to the clean records deducted."""
        scores = self.model.scores([token, *candidates])
        own = set(token)
        strange = [len(set(x) - own) - sum(map(self.knows, set(x) - own)) for x in candidates]
        return scores[1:] - scores[0] - UNKNOWN * np.array(strange)

    def _gains(self, token: str) -> dict[str, tuple[str, float]]:
        """Chain -> (candidate, gain in nats) of a token's candidates, worse ones too."""
        if not _REACHED.search(token):
            return {}
        found: dict[str, str] = {}
        for name, candidate in (*self.read.utf8_all(token), *self.read.wide_all(token), *self._lossy_all(token)):
            found.setdefault(name, candidate)
        if not found:
            return {}
        distinct = list(set(found.values()))
        told = dict(zip(distinct, self._against(token, distinct).tolist(), strict=True))
        return {name: (candidate, told[candidate]) for name, candidate in found.items()}

    def _legacy(self, token: str) -> np.ndarray:
        """Gain of each pair of :data:`LEGACY` for a token, 0 where it can't be read so."""
        if token.isascii():
            return _NO_GAINS
        at = [i for i, c in enumerate(token) if c > "\x7f"]
        signs = "".join([token[i] for i in at])
        found, place = (self.read.of_signs if len(signs) <= LONG else self.read._of_signs)(signs)
        out = self._replaced(token, at, found)[place] if len(found) > 1 else _NO_GAINS.copy()
        candidates, pairs = self.read.mixed(token)
        if candidates:
            told = self._against(token, candidates).astype(np.float32)
            for pair, n in pairs:
                out[pair] = told[n]
        return out

    def _replaced(self, token: str, at: list[int], found: list[str]) -> np.ndarray:
        """Gains of the token with its signs replaced by each of ``found``, of which the first one is what it has."""
        codes, model = _codes(f" {token} "), self.model
        # The n-grams that change: those around the signs, the first place being the token's first sign alone.
        places = np.array(sorted({j for i in at for j in (i, i + 1, i + 2) if 1 <= j <= len(token)}), dtype=np.int64)
        columns = np.unique(np.concatenate([places - 1, places, places + 1]))
        where = np.searchsorted(columns, np.array(at) + 1)
        gains = np.zeros(len(found), dtype=np.float32)
        block, own = max(1, (1 << 21) // len(columns)), 0.0
        for begin in range(0, len(found), block):
            some = found[begin : begin + block]
            signs = _codes("".join(some)).reshape(len(some), len(at))
            grid = np.repeat(codes[columns][None, :], len(some), axis=0)
            grid[:, where] = signs
            a, b, c = (grid[:, np.searchsorted(columns, places + k)] for k in (-1, 0, 1))
            terms = model.logs(a, b, c).sum(axis=1)
            if at[0] == 0:
                terms += model.first(signs[:, 0])
            if begin == 0:
                own = terms[0]
            unknown = np.where(model.known(signs) | np.isin(signs, codes), _M(0), signs)
            unknown.sort(axis=1)
            strange = (unknown[:, 0] != 0) + ((unknown[:, 1:] != unknown[:, :-1]) & (unknown[:, 1:] != 0)).sum(axis=1)
            gains[begin : begin + block] = terms - own - UNKNOWN * strange
        gains[0] = 0.0
        return gains

    def mended(self, token: str, pair: int) -> str:
        """The token by a pair of :data:`LEGACY`; itself if it can't be read so."""
        w, meant = LEGACY[pair]
        raw = None if token.isascii() else self.read.encode(token, w)
        mended = None if raw is None else _decoded(raw, meant)
        return token if mended is None else mended

    def is_dull(self, token: str) -> bool:
        if token in self.dull:
            return True
        if "\ufffd" in token or _REACHED.search(token) and (
            _CONTROLS.search(token) or (self.legacy(token) >= self.token_gain).any() or any(gain >= self.token_gain for _, gain in self.gains(token).values())
        ):
            return False
        _remember(self.dull, token)
        return True

    def best(self, text: str) -> dict[str, tuple[str, float, str]]:
        """The best chain of each kind for a text: chain, gain, restored text.

        ``whole`` and ``utf8``, ``lossy``: see :data:`KINDS`.
        """
        tokens = text.split(" ")
        if self.dull.issuperset(tokens) or all(map(self.is_dull, tokens)):
            return {}
        wide = self._wide(text) if _CONTROLS.search(text) else None
        told = [self.gains(t) for t in tokens]
        parts: dict[str, float] = {}
        wholes: dict[str, float] = {}
        for gains in told:
            for name, (_, gain) in gains.items():
                if gain >= self.token_gain:
                    parts[name] = parts.get(name, 0.0) + gain
                wholes[name] = wholes.get(name, 0.0) + gain
        out: dict[str, tuple[str, float]] = {}
        for name, gain in parts.items():
            kind = kind_of(name)
            for kind, gain in ((kind, gain), ("whole", wholes[name])) if kind == "legacy" else ((kind, gain),):
                if gain > out.get(kind, ("", 0.0))[1]:
                    out[kind] = (name, gain)
        best = {
            kind: (name, gain, " ".join([g[name][0] if name in g and (kind == "whole" or g[name][1] >= self.token_gain) else t for t, g in zip(tokens, told, strict=True)]))
            for kind, (name, gain) in out.items()
        }
        rows = [self.legacy(t) for t in tokens if not t.isascii()]
        if rows:
            rows = np.stack(rows)
            gained = np.where(rows >= self.token_gain, rows, 0).sum(axis=0)
            for kind, sums in (("legacy", gained), ("whole", np.where(gained > 0, rows.sum(axis=0), 0))):
                pair = int(np.argmax(sums - self.cost))
                gain = float(sums[pair] - self.cost[pair])
                if gain > 0 and gain > best.get(kind, ("", 0.0))[1]:
                    fixed = [self.mended(t, pair) if not t.isascii() and (kind == "whole" or self.legacy(t)[pair] >= self.token_gain) else t for t in tokens]
                    best[kind] = ("<".join(LEGACY[pair][::-1]), gain, " ".join(fixed))
        if wide is not None and wide[1] > best.get("whole", ("", 0.0))[1]:
            best["whole"] = wide
        return best

    def _wide(self, text: str) -> tuple[str, float, str] | None:
        """A whole text in UTF-16 that was read as one-byte text."""
        found: dict[str, str] = {}
        for w in ONE_BYTE:
            raw = self.read.encode(text, w)
            for order in ("utf-16-le", "utf-16-be") if raw is not None else ():
                mended = _decoded(raw[: len(raw) // 2 * 2], order)
                if mended:
                    found.setdefault(mended, f"{order}<{w}")
        if not found:
            return None
        own, at = float(self.model.scores(text.split(" ")).sum()), set(text)
        told = [
            (float(self.model.scores(m.split(" ")).sum()) - own - UNKNOWN * sum(not self.knows(c) for c in set(m) - at), name, m)
            for m, name in found.items()
        ]
        gain, name, mended = max(told)
        return (name, gain, mended) if gain > 0 else None

    def level(self, text: str) -> float:
        """Mean log-probability of a character in the words beyond ASCII; 0 if there are none."""
        words = [t for t in text.split(" ") if not t.isascii()]
        return float(self.model.scores(words).sum()) / (sum(map(len, words)) + len(words)) if words else 0.0


_NO_GAINS = np.zeros(len(LEGACY), dtype=np.float32)


def _of_utf7(match: re.Match) -> str:
    mended = _decoded(match[0].encode(), "utf-7")
    return mended if mended and mended.isprintable() else match[0]


def _decoded(raw: bytes, meant: str) -> str | None:
    try:
        text = raw.decode(meant)
    except UnicodeError:
        return None
    return unicodedata.normalize("NFC", text) if meant == "cp1258" else text


def _recoded(token: str, w: str) -> str | None:
    try:
        return token.encode(w).decode()
    except UnicodeError:
        return None


_MADE: dict[str, Chains] = {}


class Fitted:
    """A model on the executors: the broadcast count table under a name by which worker processes share it.

    ``often`` are tokens that many tasks will meet. They are judged once, spread over the cluster, and those that no
    chain makes likelier are broadcast (at most ``FREQUENT`` tokens of at most ``LONG`` characters).
    """

    def __init__(self, spark: SparkSession, counts: np.ndarray, often: list[str] | None = None, token_gain: float = TOKEN_GAIN) -> None:
        self.shared, self.name, self.token_gain = spark.sparkContext.broadcast(counts), uuid.uuid4().hex, token_gain
        self.dull = None
        if often:
            maker = self.chains

            def dull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                chains = maker()
                for batch in batches:
                    yield batch.filter(pa.array([chains.is_dull(t) for t in batch.column(0).to_pylist()], pa.bool_()))

            tokens = spark.createDataFrame(pa.table({"token": pa.array(often, pa.string())})).repartition(spark.sparkContext.defaultParallelism)
            self.dull = spark.sparkContext.broadcast(tokens.mapInArrow(dull, "token string").toPandas()["token"].tolist())

    def chains(self) -> Chains:
        """One for each worker process and model, so that its tasks share what is known of tokens."""
        if self.name not in _MADE:
            _MADE.clear()
            _MADE[self.name] = Chains(self.shared.value, self.token_gain)
        made = _MADE[self.name]
        if self.dull is not None and not made.seeded:
            made.dull.update(self.dull.value)
            made.seeded = True
        return made


def _ascii_of(run: str, order: str) -> str:
    raw = run.encode(order, "surrogatepass")
    return raw.decode("ascii") if all(0x20 <= b < 0x7F for b in raw) else run


#: Kinds of evidence. "whole": a legacy chain over all tokens, those that it makes worse count against it;
#: "legacy": such a chain over the tokens that it makes better, for texts of which a part is affected.
KINDS = ("utf8", "whole", "legacy", "lossy")


def kind_of(name: str) -> str:
    return "lossy" if name.endswith("<lossy") else "utf8" if name.startswith("utf8") else "legacy"


def corruptions(text: str) -> Iterator[tuple[str, str]]:
    """For each kind of evidence a corruption of a clean text, with encodings that its hash picks."""
    pick = zlib.crc32(text.encode("utf-8", "replace"))

    def shown(part: str, meant: str, w: str) -> str:
        table = byte_table(w)
        return "".join([chr(b) if b < 0x80 else table[b - 0x80] for b in part.encode(meant)])

    try:
        yield "utf8", shown(text, "utf-8", WRONG[pick % len(WRONG)])
        yield "lossy", re.sub(r"[\x80-\x9f]", "", shown(text, "utf-8", ("latin-1", "cp1252", "cp1250")[pick % 3]))
    except UnicodeEncodeError:
        return
    for n in range(len(LEGACY)):
        w, meant = LEGACY[(pick + n) % len(LEGACY)]
        try:
            garbled = shown(text, meant, w)
        except UnicodeEncodeError:
            continue
        if garbled != text:
            yield "whole", garbled
            tokens = text.split(" ")
            yield "legacy", " ".join(tokens[: len(tokens) // 2] + [shown(t, meant, w) for t in tokens[len(tokens) // 2 :]])
            return


def one_corruption(text: str) -> tuple[str, str] | None:
    """One of a text's corruptions, picked by another hash of it; null if that one leaves the text as it is."""
    made_of = list(corruptions(text))[zlib.crc32(text.encode("utf-8", "replace")[::-1]) % 4 :][:1]
    return made_of[0] if made_of and made_of[0][1] != text else None


def tally(fitted: Fitted, clean: DataFrame) -> np.ndarray:
    """Histograms of the gains of ``clean`` texts and of one corruption of each: (which, kind, place) -> texts.

    Place 0 is no gain, place i a gain of at least (i - 1) * ``STEP``. A last kind has the clean texts' levels, negative.
    Scored where the texts are; only the histograms, of fixed size, reach the driver.
    """
    shape = (2, len(KINDS) + 1, PLACES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, seen = fitted.chains(), np.zeros(shape, dtype=np.int64)

        def add(which: int, kind: int, gain: float) -> None:
            seen[which, kind, min(int(gain / STEP) + 1, PLACES - 1) if gain > 0 else 0] += 1

        for batch in batches:
            for text in batch.column(0).to_pylist():
                told = chains.best(text)
                for n, kind in enumerate(KINDS):
                    add(0, n, told[kind][1] if kind in told else 0.0)
                add(0, len(KINDS), -chains.level(text))
                garbled = one_corruption(text)
                if garbled is not None:
                    kind, text = garbled
                    add(1, KINDS.index(kind), chains.best(text).get(kind, ("", 0.0, ""))[1])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen.ravel()[at])], names=["at", "n"])

    found = np.zeros(shape, dtype=np.int64)
    for row in clean.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found.ravel()[row["at"]] = row["n"]
    return found


def margins(spark: SparkSession, counts: np.ndarray, clean: DataFrame) -> dict[str, float]:
    """The margin of each kind, from held-out clean texts (one column) and corruptions made from them."""
    return _margins(Fitted(spark, counts), clean)


def _margins(fitted: Fitted, clean: DataFrame) -> dict[str, float]:
    """Of all margins from the least one on, the one that loses the least: the share of clean texts that pass
    plus the share of corrupted ones that don't. Both are shares, so the size of the data doesn't
    matter, and damaged texts among the clean ones, which gain what the corrupted ones gain, can't
    raise it: that would lose more corrupted texts than it would spare.

    ``level`` is a level that all but one in ``ODD`` of the clean texts reach, less some slack.
    """
    told, out = tally(fitted, clean), {}
    for n, kind in enumerate(KINDS):
        clean_seen, corrupt_seen = told[0, n], told[1, n]
        least = int(MARGINS[kind] / STEP) + 1
        passing = clean_seen[::-1].cumsum()[::-1][least:] / max(clean_seen.sum(), 1)
        missed = (corrupt_seen.cumsum() - corrupt_seen)[least:] / max(corrupt_seen.sum(), 1)
        out[kind] = MARGINS[kind] + STEP * int(np.argmin(passing + missed))
    levels = told[0, len(KINDS)]
    if levels.sum():
        out["level"] = -STEP * (int(np.searchsorted(levels.cumsum(), levels.sum() * (1 - 1 / ODD))) + 1) - 1.0
    return out


def _strongest(chains: Chains, limits: dict[str, float], text: str, kinds: tuple[str, ...] = KINDS) -> tuple[float, str, str] | None:
    accepted = [(gain, name, fixed) for kind, (name, gain, fixed) in chains.best(text).items() if gain >= limits[kind] and kind in kinds]
    return max(accepted) if accepted else None


def verdict(chains: Chains, limits: dict[str, float], text: str) -> tuple[str, str | None] | None:
    """(chains, restored text) of an affected text, None for one that is decoded rightly.

    After the likeliest chain those to UTF-8 are taken until none is accepted; each makes the text likelier, so this ends. The text is null
    if nothing of it can be restored: bytes are lost behind U+FFFD, or what the likeliest chain makes of it is no
    text by the clean records' standard. Beside U+FFFD the rest is restored.
    """
    told = _strongest(chains, limits, text)
    if told is None:
        return ("lost", None) if "�" in text else None
    names = []
    while told is not None:
        _, name, fixed = told
        names.append(name)
        told = _strongest(chains, limits, fixed, ("utf8", "lossy"))
    if "�" in text:
        names = ["lost", *names]
    return "; ".join(names), fixed if chains.level(fixed) >= limits.get("level", -math.inf) else None


def retrain(spark: SparkSession, texts: DataFrame, counts: np.ndarray, often: list[str]) -> np.ndarray:
    """The count table without the records that the first model doubts.

    Nothing but the model can tell one legacy encoding from another, and records that were read with the
    wrong one made their way into its training: the more data, the more often the wrong spelling is seen. So
    the n-grams of the records that a whole-text chain makes likelier by ``DOUBT`` are taken out again.
    """
    fitted = Fitted(spark, counts, often, DOUBT_TOKEN)

    def doubts() -> Callable[[str], bool]:
        chains, sound = fitted.chains(), Sound()

        def doubtful(text: str) -> bool:
            if chains.dull.issuperset(text.split(" ")) or not sound(text):
                return False
            return any(gain >= DOUBT[k] for k, (_, gain, _) in chains.best(text).items() if k in DOUBT)

        return doubtful

    column = texts.columns[0]
    return np.maximum(counts - _counted(texts.where(F.col(column).rlike(REACHED)), doubts)[0], 0).astype(np.float32)


def sound_only(texts: DataFrame) -> DataFrame:
    """The texts (one column) without signs of damage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound = Sound()
        for batch in batches:
            yield batch.filter(pa.array([sound(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def held_out(texts: DataFrame) -> DataFrame:
    """The distinct clean texts that stay out of the training."""
    column = texts.columns[0]
    apart = texts.where((_part(column) == 0) & F.col(column).rlike(REACHED)).distinct()
    return sound_only(apart).repartition(texts.sparkSession.sparkContext.defaultParallelism)


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(HELD_OUT))


def fit(spark: SparkSession, texts: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """Count table of the clean records and validated margins; ``texts`` has one column."""
    counts, _ = trained(spark, texts)
    return counts, margins(spark, counts, held_out(texts))


def trained(spark: SparkSession, texts: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Count table of the clean records without the doubtful ones, and the most frequent tokens."""
    column = texts.columns[0]
    training = texts.where(F.col(column).isNotNull() & (_part(column) != 0))
    counts, often = train(training)
    return retrain(spark, training, counts, often), often


def find_garbled(spark: SparkSession, records: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The records whose ``text`` was wholly or partly decoded with the wrong encoding.

    Returns ``keys``, original, chain and restored (null where nothing can be restored, see :func:`verdict`). Null,
    empty and plain ASCII texts are right as they are and never reach Python. Repeated records count each. The
    model is fitted on the clean ones among ``records``; with none at all nothing but U+FFFD can be told.
    The only data on the driver are the count table and the validation's histograms, both of fixed size.
    """
    texts = records.select(text)
    fitted = Fitted(spark, *trained(spark, texts))
    limits = _margins(fitted, held_out(texts))
    slim = records.select(*keys, F.col(text).alias("original")).where(F.col("original").rlike(REACHED))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema), "chain string", "restored string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = fitted.chains()
        judge = lru_cache(maxsize=1 << 12)(lambda t: verdict(chains, limits, t))
        for batch in batches:
            told = [None if chains.dull.issuperset(t.split(" ")) else judge(t) for t in batch.column(len(keys)).to_pylist()]
            at = [i for i, v in enumerate(told) if v is not None]
            if at:
                kept = batch.take(pa.array(at))
                extra = [pa.array([told[i][j] for i in at], pa.string()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *extra], names=[*kept.schema.names, "chain", "restored"])

    return slim.mapInArrow(run, schema)


def restoration(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """How well restoring works: rows (kind, texts, found, exact) over corruptions of the held-out clean texts.

    ``texts`` has one column. Each held-out text, unknown to the model, is garbled in one way and judged; exact
    counts the texts that come back sign by sign. Texts garbled with loss of bytes have kind lossy.
    """
    fitted = Fitted(spark, *trained(spark, texts))
    apart = held_out(texts)
    limits = _margins(fitted, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = fitted.chains()
        for batch in batches:
            told = []
            for text in batch.column(0).to_pylist():
                garbled = one_corruption(text)
                if garbled is not None:
                    got = verdict(chains, limits, garbled[1])
                    told.append((garbled[0], got is not None, got is not None and got[1] == text))
            columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "found", "exact"])

    judged = apart.mapInArrow(run, "kind string, found boolean, exact boolean")
    return judged.groupBy("kind").agg(F.count("*").alias("texts"), F.count_if("found").alias("found"), F.count_if("exact").alias("exact"))
