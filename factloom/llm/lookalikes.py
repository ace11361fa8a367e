"""One form for text that looks the same.

``Spelling`` takes a text through these steps:

1. Invisible characters go (format characters and other default-ignorable ones), every blank becomes
   a plain space, width and presentation forms become the plain letters (only compatibility mappings that
   keep the look: wide, narrow, font, noBreak, compat; not superscripts, circles or fractions).
2. The text is decomposed, so that letters and accents are apart.
3. Each sign belongs to a class of look-alikes: signs with the same skeleton in the Unicode confusables
   and the same general category, so that I, l and 1 stay apart. For each class it is known
   in which scripts it can be written, and by which sign.

``key`` intersects, across each token (a run of letters, marks and digits), the sets of scripts in which its signs
can be written, and writes the whole token in the first script of the intersection; if nothing is left, each sign in
the first script of its own class. A letter without case belongs to the class of the cased letter that it looks like
here. All of this depends on the classes only: two texts look alike exactly if their keys are equal.

``difference`` tells a text that looks like a name from the name, by the resolved script sets of the tokens that
differ: mixed (the token's signs have no script in common), whole (they have, but none of the name's token), single
(look-alikes of one script), or form (signs of no script, width, blanks, invisible signs, composition).

``of`` writes text that can be read and stays what it was where nothing is wrong:

4. The sets of scripts in which the signs can be written are intersected across each token. Scripts in which
   a language would have to be rare to use the letters drop out. What is left may be one script, or several (a whole-script confusable): then the nearest token decides that has one, then
   what most of the token's own signs are, then the order Latin, Cyrillic, Greek, others. If nothing is left
   (writing systems that mix scripts, say), signs that could be Katakana or ideographs follow their neighbours.
5. A sign that belongs to the chosen script stays, another one is replaced by that script's sign of its class. The
   result is composed again (NFC).

``confusion`` tells what was wrong: mixed (a token has signs of several scripts, by their resolved script sets,
and one script can write all of it), whole (a token of one script, in a text of another one), form (anything else
that changed), or null.

Confusables, script extensions and the letters of the world's languages come from the ICU library that
Spark itself ships; they are read once on the driver and sent to the workers. The tables are bounded by
Unicode, whatever the data.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of compatibility mapping that keep the look; "" is the canonical one.
KEEPS_LOOK = {"", "<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Default-ignorable code points that are not format characters.
_IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180d\u180f\u3164\ufe00-\ufe0f\uffa0\U000e0100-\U000e01ef"
_INVISIBLE = re.compile(f"[{_IGNORABLE}]")
_LOOKS_PLAIN = re.compile(r"[\x20-\x7e]*")
SALTS = 8
#: Most names, and most characters in them, that are broadcast; more of them are joined by a shuffle.
FEW_NAMES, FEW_CHARACTERS = 500_000, 32_000_000
#: Scripts in order of preference for a token that can be spelled in several; the others follow by name.
PREFERRED = ("Latn", "Cyrl", "Grek", "Hira", "Kana", "Hani")
#: A script drops out if the rarest letter of a token is by so many times rarer in it than in another one.
RARER = 4
#: Writing systems that use several scripts side by side (Unicode Technical Standard 39).
SYSTEMS = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}
#: Longer tokens are worked out each time, so that kept ones stay small.
LONG_TOKEN = 64
#: Kinds of difference from a name, the smallest first.
DIFFERENCES = ("form", "single", "whole", "mixed")
_PATTERN = re.compile(r"\{(?:\\.|[^}])*\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\(.)|(.)", re.DOTALL)


def _rank(script: str) -> tuple[int, str]:
    return (PREFERRED.index(script) if script in PREFERRED else len(PREFERRED), script)


def unfold(char: str) -> str:
    """The plain letters of a width or presentation form, decomposed; other signs unchanged."""
    kind, _, rest = unicodedata.decomposition(char).rpartition("> ")
    if kind and kind + ">" not in KEEPS_LOOK or not rest:
        return char
    return "".join(unfold(chr(int(x, 16))) for x in rest.split())


def _of_pattern(pattern: str) -> list[tuple[int, int]]:
    """The ranges of a plain Unicode set pattern, strings in braces left out."""
    out: list[list[int]] = []
    open_range = False
    for m in _PATTERN.finditer(pattern[1:-1]):
        if m[5] == "-":
            open_range = True
            continue
        code = next((int(x, 16) for x in m.groups()[:3] if x), None)
        if code is None and (m[4] or m[5]):
            code = ord(m[4] or m[5])
        if code is None or m[5] == " ":
            continue
        if open_range:
            out[-1][1], open_range = code, False
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


def _scripts(spark: SparkSession) -> tuple[list[int], list[int], list[tuple[str, ...]]]:
    """Starts, ends and script extensions of all ranges of code points, in order; Common and Inherited have none."""
    jvm = spark.sparkContext._jvm
    names, extensions, held = jvm.com.ibm.icu.lang.UScript, 0x7000, defaultdict(set)
    for code in range(names.CODE_LIMIT):
        name = names.getShortName(code)
        if name not in ("Zyyy", "Zinh", "Zzzz"):
            ranges = jvm.com.ibm.icu.text.UnicodeSet().applyIntPropertyValue(extensions, code)
            if not ranges.isEmpty():
                for a, b in _of_pattern(ranges.toPattern(True)):
                    held[a, b].add(name)
    edges = sorted({x for a, b in held for x in (a, b + 1)})
    cover: dict[int, set[str]] = defaultdict(set)
    for (a, b), scripts in held.items():
        for x in edges[bisect_right(edges, a) - 1 : bisect_right(edges, b)]:
            cover[x] |= scripts
    starts = [x for x in edges if cover[x]]
    following = dict(zip(edges, edges[1:], strict=False))
    return starts, [following[x] - 1 for x in starts], [tuple(sorted(cover[x])) for x in starts]


def _shares(spark: SparkSession) -> dict[str, dict[str, float]]:
    """Script -> letter -> share of the script's languages that use it, of scripts of letters."""
    jvm = spark.sparkContext._jvm
    locales, data = jvm.com.ibm.icu.util.ULocale, jvm.com.ibm.icu.util.LocaleData
    uses: dict[str, Counter] = defaultdict(Counter)
    languages: Counter = Counter()
    for locale in locales.getAvailableLocales():
        if locale.getCountry() or locale.getVariant():
            continue
        script = locale.getScript() or locales.addLikelySubtags(locale).getScript()
        if script in ("Hans", "Hant", "Jpan", "Kore"):
            continue
        letters = {c for a, b in _of_pattern(data.getInstance(locale).getExemplarSet(0, 0).toPattern(True)) for c in map(chr, range(a, b + 1))}
        letters = {unicodedata.normalize("NFD", x)[0] for c in letters for x in (c, *c.upper()[:1])}
        languages[script] += 1
        uses[script].update(letters)
    return {script: {c: n / languages[script] for c, n in counted.items()} for script, counted in uses.items()}


class Table:
    """What is known of signs: script extensions, classes of look-alikes, shares of languages."""

    def __init__(self, ranges: tuple[list[int], list[int], list[tuple[str, ...]]], shares: dict[str, dict[str, float]]) -> None:
        self.starts, self.ends, self.extensions = ranges
        self.shares = shares
        #: Sign -> script -> the sign that writes its class in it; "" stands for signs of no script.
        self.classes: dict[str, dict[str, str]] = {}
        #: The same for keys: letters without case are in the classes of the cased letters that they look like.
        self.looks: dict[str, dict[str, str]] = {}

    def scripts(self, char: str) -> tuple[str, ...]:
        """Script extensions of a letter or mark; none for signs of no script."""
        at = bisect_right(self.starts, ord(char)) - 1
        return self.extensions[at] if at >= 0 and ord(char) <= self.ends[at] else ()

    def share(self, script: str, char: str) -> float:
        known = self.shares.get(script)
        return 1.0 if known is None else known.get(char, 0.0)


@lru_cache(maxsize=1)
def confusables(spark: SparkSession) -> Table:
    """The table, from ICU on the driver.

    Only characters recommended for general use write a class (no phonetic small capitals, say), unless it has no
    other; of several in a script the one that most languages use, then the first code point. All assigned signs are
    read; those that look like no other are left out, they are written as they are.
    """
    checks = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
    usual = {c for a, b in _of_pattern(checks.RECOMMENDED.toPattern(True)) for c in range(a, b + 1)}
    signs = [
        c for c in map(chr, range(0x21, sys.maxunicode + 1))
        if unicodedata.category(c)[0] in "LPSN" and unfold(c) == c
    ]
    skeletons = checks.Builder().build().getSkeleton("\n".join(signs)).split("\n")
    classes, looks = defaultdict(list), defaultdict(list)
    for sign, skeleton in zip(signs, skeletons, strict=True):
        kind = unicodedata.category(sign)
        cased = kind == "Lo" and len(skeleton) == 1 and unicodedata.category(skeleton) in ("Lu", "Ll")
        classes[skeleton, kind].append(sign)
        looks[skeleton, unicodedata.category(skeleton) if cased else kind].append(sign)
    table = Table(_scripts(spark), _shares(spark))
    for known, groups in ((table.classes, classes), (table.looks, looks)):
        for members in groups.values():
            if len(members) == 1:
                continue
            scripts: dict[str, str] = {}
            writers = [c for c in members if ord(c) in usual] or members[:1]
            for script in {x for c in writers for x in table.scripts(c) or ("",)}:
                own = [c for c in writers if script in (table.scripts(c) or ("",))]
                scripts[script] = min(own, key=lambda c: (-table.share(script, c) if script else 0.0, ord(c)))
            for sign in members:
                known[sign] = scripts
    return table


@lru_cache(maxsize=1)
def _sent(spark: SparkSession) -> Broadcast:
    """The table at the workers; all columns share it, so that a worker reads it once."""
    return spark.sparkContext.broadcast(confusables(spark))


class Spelling:
    """Keys and forms of texts under a table of look-alikes (see :func:`confusables`)."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self.plain = lru_cache(maxsize=1 << 16)(self._plain)
        self.whole = lru_cache(maxsize=1 << 16)(lambda c: self._one(table.classes.get(c), c))
        self.own = lru_cache(maxsize=1 << 16)(table.scripts)
        self.choice = lru_cache(maxsize=1 << 15)(self._choice)
        self.alike = self._kept(self._alike)
        self.resolved = self._kept(self._resolved)

    @staticmethod
    def _kept(of):
        """A function of tokens whose results are kept, but for those of long tokens."""
        kept = lru_cache(maxsize=1 << 15)(of)
        return lambda token: kept(token) if len(token) <= LONG_TOKEN else of(token)

    @staticmethod
    def _plain(char: str) -> str:
        kind = unicodedata.category(char)
        if kind == "Cf" or _INVISIBLE.match(char):
            return ""
        return " " if kind == "Zs" else unfold(char)

    @staticmethod
    def _one(scripts: dict[str, str] | None, char: str) -> str:
        return scripts[min(scripts, key=lambda s: (s != "", *_rank(s)))] if scripts else char

    def _apart(self, text: str) -> str:
        return unicodedata.normalize("NFD", "".join(map(self.plain, text)))

    def key(self, text: str | None) -> str | None:
        """What a text looks like; null for null, empty for empty, plain ASCII is its own key."""
        if text is None or _LOOKS_PLAIN.fullmatch(text):
            return text
        return unicodedata.normalize("NFC", "".join(map(self.alike, self._tokens(self._apart(text)))))

    def _alike(self, token: str) -> str:
        """A token in the first script in which all of it can be written; if there is none, each sign in its own first one."""
        looks = {c: self.table.looks.get(c) for c in token}
        sets = [held for c, k in looks.items() if (held := set(k or self.own(c))) and "" not in held]
        script = min(set.intersection(*sets), key=_rank, default="") if sets else ""
        written = {c: k[script] if k and "" not in k and script in k else self._one(k, c) for c, k in looks.items()}
        return "".join([written[c] for c in token])

    def _resolved(self, token: str) -> frozenset[str] | None:
        """The scripts and writing systems that all signs of a token have in common; null if no sign has a script."""
        sets = [self._systems(c) for c in set(token) if self.own(c)]
        return frozenset(set.intersection(*sets)) if sets else None

    def difference(self, text: str, name: str) -> str | None:
        """What a text differs by from a name that it looks like; null if it is the name or looks otherwise."""
        ours, theirs = self._tokens(self._apart(text)), self._tokens(self._apart(name))
        if text == name or len(ours) != len(theirs):
            return None
        most = 0
        for a, b in zip(ours, theirs, strict=True):
            if a == b:
                continue
            if self.alike(a) != self.alike(b):
                return None
            x, y = self.resolved(a), self.resolved(b)
            if x is not None and y is not None:
                most = max(most, DIFFERENCES.index("mixed" if not x else "single" if x & y else "whole"))
        return DIFFERENCES[most]

    def _can(self, char: str) -> set[str] | None:
        """Scripts in which a sign's look can be written; null for any."""
        scripts = self.table.classes.get(char)
        if scripts is not None:
            return None if "" in scripts else set(scripts)
        return set(self.own(char)) or None

    def _choice(self, token: str) -> tuple[str, ...]:
        """Scripts in which the whole token can be written and languages would write it; empty if there is none."""
        sets = [s for s in map(self._can, token) if s is not None]
        common = set.intersection(*sets) if sets else set()
        if len(common) < 2:
            return tuple(common)
        told = {s: min((self.table.share(s, self.table.classes[c].get(s, c)) for c in token if "" not in self.table.classes.get(c, {"": ""})), default=1.0) for s in common}
        most = max(told.values())
        return tuple(sorted((s for s, n in told.items() if n * RARER >= most), key=_rank))

    def _written(self, char: str, script: str) -> str:
        scripts = self.table.classes.get(char)
        if scripts is None or "" in scripts:
            return self.whole(char) if scripts else char
        return char if script in self.own(char) and (ord(char) < 0x2E80 or scripts.get(script) == char) or script not in scripts else scripts[script]

    def _side_by_side(self, token: str) -> str:
        """A token that no script can write alone: Katakana beside Katakana, ideographs elsewhere, other signs as they are."""
        out = []
        for i, c in enumerate(token):
            scripts = self.table.classes.get(c)
            if scripts and "" in scripts:
                out.append(self.whole(c))
            elif scripts and {"Kana", "Hani"} <= set(scripts):
                beside = any(self._can(x) == {"Kana"} or x == "\u30fc" for x in (token[i - 1 : i], token[i + 1 : i + 2]) if x)
                out.append(scripts["Kana" if beside else "Hani"])
            else:
                out.append(c)
        return "".join(out)

    def _tokens(self, text: str) -> list[str]:
        """Runs of letters, marks and digits, and single other signs between them."""
        out: list[str] = []
        start, inside = 0, False
        for i, c in enumerate(text):
            word = unicodedata.category(c)[0] in "LMN"
            if i and not (word and inside):
                out.append(text[start:i])
                start = i
            inside = word
        return [*out, text[start:]] if text else out

    def of(self, text: str | None) -> str | None:
        """The form of a text; null for null, empty for empty."""
        return self.told(text)[0]

    def told(self, text: str | None) -> tuple[str | None, str | None]:
        """The form of a text and what was wrong with it."""
        if text is None or _LOOKS_PLAIN.fullmatch(text):
            return text, None
        return self._spelled(text)

    def _token(self, token: str) -> str:
        return self._spelled(token)[0]

    def _spelled(self, text: str) -> tuple[str, str | None]:
        tokens = self._tokens(self._apart(text))
        choices = [self.choice(t) for t in tokens]
        definite = [(i, c[0], len(tokens[i])) for i, c in enumerate(choices) if len(c) == 1]
        weight: Counter = Counter()
        for _, script, n in definite:
            weight[script] += n
        out, wrong = [], None
        for i, (token, choice) in enumerate(zip(tokens, choices, strict=True)):
            if not choice:
                out.append(self._side_by_side(token))
                continue
            own = Counter(s for c in token for s in self.own(c))
            near = [d for d in definite if d[1] in choice] if len(choice) > 1 else []
            if len(choice) == 1:
                script = choice[0]
            elif near:
                script = min(near, key=lambda d: (abs(d[0] - i), -weight[d[1]], _rank(d[1])))[1]
            else:
                script = min(choice, key=lambda s: (-own[s], _rank(s)))
            written = "".join([self._written(c, script) for c in token])
            if written != token:
                scripts = self.resolved(token)
                wrong = "mixed" if scripts is not None and not scripts else wrong or ("whole" if scripts and script not in scripts else None)
            out.append(written)
        form = unicodedata.normalize("NFC", "".join(out))
        return form, wrong or ("form" if form != text else None)

    def _systems(self, char: str) -> set[str]:
        """A sign's resolved script set: its scripts and the writing systems that use them."""
        return {x for s in self.own(char) for x in (s, *SYSTEMS.get(s, ()))}


def names_that_look(spark: SparkSession, occurrences: DataFrame, names: DataFrame, salts: int = SALTS) -> DataFrame:
    """Occurrences that are no name of their key sign by sign but look like one.

    ``occurrences`` has key and text besides other columns, ``names`` key and name. Returns the occurrences'
    columns, ``form``, what the text looks like, and ``confusion``, what it differs by from the name that it looks like
    (the smallest difference, if it looks like several). Rows with a null key or text, and keys without names, don't
    count. Candidates are those whose key is a name's key; each is compared with these names token by token.
    Each occurrence comes out once, repeats included. Names are grouped by key first (a series has a few). If there
    are at most ``FEW_NAMES`` of at most ``FEW_CHARACTERS`` together they are broadcast, so that occurrences stay
    where they are; otherwise they are repeated ``salts`` times, so that a key with a third of all occurrences is
    spread. Keys are made for the names and for the occurrences that aren't names anyway, which are few.
    """
    known = names.where("key is not null and name is not null").select("key", "name").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("characters")).first()
    per_key = (
        known.withColumn("_form", look_key(spark, F.col("name")))
        .groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("name", "_form")).alias("_known"))
        .select("_key", F.col("_known.name").alias("_names"), F.col("_known._form").alias("_forms"))
    )
    told = occurrences.where("key is not null and text is not null")
    if size["n"] <= FEW_NAMES and size["characters"] <= FEW_CHARACTERS:
        met = told.join(F.broadcast(per_key), F.col("key") == F.col("_key"))
    else:
        salt = F.pmod(F.xxhash64(*occurrences.columns), F.lit(salts)).cast("int")
        spread = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = told.withColumn("_part", salt).join(spread, (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_salt")))
    odd = met.where(~F.array_contains("_names", F.col("text")))
    looked = odd.withColumn("form", look_key(spark, F.col("text"), in_place=True))
    like = F.filter("_names", lambda name, i: F.get("_forms", i) == F.col("form"))
    alike = looked.where(F.array_contains("_forms", F.col("form"))).withColumn("confusion", _difference(spark, F.col("text"), like))
    return alike.where("confusion is not null").drop("_key", "_part", "_salt", "_names", "_forms")


def look_key(spark: SparkSession, text: Column, in_place: bool = False) -> Column:
    """Column with what ``text`` looks like: equal for texts that look alike.

    With ``in_place`` Spark may neither move it ahead of a join nor work it out again for each use.
    """
    table = _sent(spark)

    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        spelling = _spelling(table)
        return pd.Series([spelling.key(t) for t in texts], dtype=object)

    return key.asNondeterministic()(text) if in_place else key(text)


def _difference(spark: SparkSession, text: Column, names: Column) -> Column:
    """Column with what ``text`` differs by from that of ``names`` to which it is nearest (see :class:`Spelling`)."""
    table = _sent(spark)

    @F.pandas_udf(T.StringType())
    def difference(texts: pd.Series, names: pd.Series) -> pd.Series:
        spelling = _spelling(table)
        told = [[d for n in known if (d := spelling.difference(t, n))] for t, known in zip(texts, names, strict=True)]
        return pd.Series([min(t, key=DIFFERENCES.index, default=None) for t in told], dtype=object)

    return difference(text, names)


def composed(text: Column) -> Column:
    """Column with the canonical composition (NFC) of ``text``."""

    @F.pandas_udf(T.StringType())
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc(text)


def look_form(spark: SparkSession, text: Column) -> Column:
    """Struct column: the form of ``text`` in one script a token, its key, and what was wrong (see :class:`Spelling`)."""
    table = _sent(spark)

    @F.pandas_udf("struct<form: string, key: string, confusion: string>")
    def form(texts: pd.Series) -> pd.DataFrame:
        spelling = _spelling(table)
        told = [(*spelling.told(t), spelling.key(t)) for t in texts]
        return pd.DataFrame({"form": [t[0] for t in told], "key": [t[2] for t in told], "confusion": [t[1] for t in told]}, dtype=object)

    return form(text)


_MADE: dict[int, Spelling] = {}


def _spelling(table) -> Spelling:
    """One ``Spelling`` for each worker process."""
    made = _MADE.get(table.id if hasattr(table, "id") else id(table))
    if made is None:
        made = _MADE[table.id if hasattr(table, "id") else id(table)] = Spelling(table.value)
    return made
