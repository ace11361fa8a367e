"""Corpus encoding with a public byte-level BPE tokenizer as a bounded-lookahead transducer.

A text is read in pieces of ``CHUNK`` characters. Two levels hold back what the next piece could still
change:

* Words. The pre-tokenizer's pattern never lets a match span the place before a single space that
  has non-spaces on both sides, so everything before the last such place is settled and goes to the
  tokenizer; the rest waits. If there is no such place the stable matches are cut off one by one
  (all but those that touch the last ``WORD_LOOKAHEAD`` characters).
* Tokens. A single word that outgrows a chunk is fed through :class:`PieceTransducer`, which emits a
  token once ``lookahead`` more bytes are known. The lookahead is computed from the merge list.

Memory is thus bounded by the chunk size, however long a text or a word is.

Decoding is incremental too: :class:`TextDecoder` keeps the one to three bytes of an unfinished
UTF-8 sequence between tokens.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies; the same path must exist on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Every text goes through the transducer in pieces of so many characters.
CHUNK = 1 << 11
#: A match that ends this many characters before the end of what is known can't change any more: a
#: contraction has three characters and white space looks one ahead.
WORD_LOOKAHEAD = 3

#: The pattern's white space, which is the Unicode property and not Python's notion of it.
_WS = r"\p{White_Space}"
_SAFE = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
_WORDS = regex.compile(PATTERN.replace(r"[^\s", rf"[^{_WS}").replace(r"\S", rf"[^{_WS}]").replace(r"\s", _WS))
_LETTERS = regex.compile(r"\p{L}+")
_NUMBERS = regex.compile(r"\p{N}+")
_SPACES = regex.compile(rf"{_WS}+")
_OTHERS = regex.compile(rf"[^{_WS}\p{{L}}\p{{N}}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: what is left when all earlier merges are done."""
    if len(token) == 1:
        return None
    parts = bpe(token, ranks, ranks[token])
    return (parts[0], parts[1]) if len(parts) == 2 else None


def bpe(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain pair merging of one piece by the merges of rank under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] >= (below if below is not None else 1 << 60):
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token that decide whether it stays as it is.

    Let token t be merged from (x, y) at rank r. Given where t begins, how far beyond its end must one
    look to know that it is formed? y must be formed, and no earlier merge (y, z) may take y first, which
    in turn needs z, and so on; each step has a smaller rank, so in order of rank
    reach(t) = max(reach(y), max over (y, z) of rank < r of len(z) + reach(yz)).
    A formed token t stays if no merge (t, z) of any rank takes it, hence the lookahead is the greatest
    len(z) + reach(tz) over all merges.
    """
    reach: dict[bytes, int] = {}
    onward: dict[bytes, int] = {}
    for token in sorted(ranks, key=ranks.__getitem__):
        pair = split_pair(token, ranks)
        if pair is None:
            reach[token] = 0
            continue
        x, y = pair
        reach[token] = max(reach.get(y, 0), onward.get(y, 0))
        onward[x] = max(onward.get(x, 0), len(y) + reach[token])
    return max(onward.values(), default=0)


class Vocabulary:
    """Ranks, the compiled encoder and the lookahead of one tokenizer file."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        self.ranks = read_ranks(path)
        self.by_id = {i: t for t, i in self.ranks.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.longest = max(map(len, self.ranks))

    @property
    def lookahead(self) -> int:
        if not hasattr(self, "_lookahead"):
            self._lookahead = sufficient_lookahead(self.ranks)
        return self._lookahead

    def piece(self, data: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(data) if data else []


@lru_cache(maxsize=4)
def vocabulary(path: str = TOKENIZER) -> Vocabulary:
    return Vocabulary(path)


class PieceTransducer:
    """Ids of one pre-token that arrives in parts.

    A token is emitted once ``lookahead`` bytes after it are known. The rest is encoded anew with what
    comes later, which is exact: no merge crosses a token's end, so both sides are encoded independently.
    """

    def __init__(self, vocab: Vocabulary, window: int = 1 << 13) -> None:
        self.vocab, self.buffer = vocab, b""
        self.window = max(window, 2 * (vocab.lookahead + vocab.longest))

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.buffer += data[at : at + self.window]
            if len(self.buffer) > self.window:
                settled, end = len(self.buffer) - self.vocab.lookahead, 0
                for i in self.vocab.piece(self.buffer):
                    if end + len(self.vocab.by_id[i]) > settled:
                        break
                    end += len(self.vocab.by_id[i])
                    yield i
                self.buffer = self.buffer[end:]

    def close(self) -> Iterator[int]:
        if self.buffer:
            yield from self.vocab.piece(self.buffer)
        self.buffer = b""


def encode_stream(pieces: Iterable[str], vocab: Vocabulary) -> Iterator[int]:
    """Ids of a text that arrives in parts of any size."""
    held = ""
    giant: PieceTransducer | None = None  # of a word longer than a chunk; ``shape`` tells its kind
    shape = None
    encode = vocab.encoding.encode_ordinary
    for piece in pieces:
        for at in range(0, len(piece), CHUNK):
            held += piece[at : at + CHUNK]
            while True:
                if giant is not None:
                    run = shape.match(held)
                    end = run.end() if run else 0
                    keep = _tail(shape)
                    if end == len(held):
                        if end > keep:
                            yield from giant.feed(held[: end - keep].encode("utf-8", "surrogatepass"))
                            held = held[end - keep :]
                        break
                    if shape is _SPACES:  # the last white space before a word is a piece of its own
                        end -= end > 1 or giant.buffer != b""
                    yield from giant.feed(held[:end].encode("utf-8", "surrogatepass"))
                    yield from giant.close()
                    giant, held = None, held[end:]
                if len(held) < CHUNK:
                    break
                cut = _last_safe(held)
                if cut:
                    yield from encode(held[:cut])
                    held = held[cut:]
                    break
                cut = 0
                for m in _WORDS.finditer(held):
                    if m.end() > len(held) - WORD_LOOKAHEAD:
                        break
                    if not _SPACES.match(m[0][-1]):  # white space at the end of a text is matched otherwise
                        cut = m.end()
                if cut:
                    yield from encode(held[:cut])
                    held = held[cut:]
                    continue
                first = held[1:2] if held[0] == " " and not _SPACES.match(held[1:2]) else held[:1]
                shape = next(s for s in (_LETTERS, _NUMBERS, _SPACES, _OTHERS) if s.match(first))
                giant = PieceTransducer(vocab)
                if first != held[:1]:
                    yield from giant.feed(b" ")
                    held = held[1:]
    if giant is not None:
        run = shape.match(held)
        end = run.end() if run else 0
        if shape is _SPACES and end < len(held):
            end -= end > 1 or giant.buffer != b""
        yield from giant.feed(held[:end].encode("utf-8", "surrogatepass"))
        yield from giant.close()
        held = held[end:]
    if held:
        yield from encode(held)


def _tail(shape) -> int:
    """Characters of a run held back at the end of what is known."""
    return 1 if shape is _SPACES else 0


def _last_safe(text: str) -> int:
    """The last place where a single space lies between two non-spaces; 0 if there is none."""
    at = len(text) - 1
    while (at := text.rfind(" ", 1, at)) > 0:
        if _SAFE.match(text, at):
            return at
    return 0


def encode(text: str | None, vocab: Vocabulary) -> list[int]:
    """Ids of a text; none for an empty or null one."""
    if not text:
        return []
    return list(encode_stream((text[i : i + CHUNK] for i in range(0, len(text), CHUNK)), vocab))


class TextDecoder:
    """Text of ids that arrive one by one; bytes of an unfinished character wait for the next id."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        return self.state.decode(self.vocab.by_id[i])

    def close(self) -> str:
        return self.state.decode(b"", True)


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    decoder = TextDecoder(vocab)
    return "".join([*map(decoder.feed, ids), decoder.close()])


def token_ids(text: Column, path: str = TOKENIZER) -> Column:
    """Ids of a text column (array<int>), an empty list for empty and null texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([encode(t, vocab) for t in texts])

    return ids(text)


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of ids of a text column, 0 for empty and null texts; the ids stay in the Python worker."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([len(encode(t, vocab)) for t in texts], dtype="int64")

    return count(text)


def decoded(ids: Column, path: str = TOKENIZER) -> Column:
    """Text of an array of ids; null for null."""

    @F.pandas_udf(T.StringType())
    def texts(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([None if x is None else decode(x, vocab) for x in lists], dtype=object)

    return texts(ids)


def encode_corpus(documents: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """Columns key and ids of every row; no shuffle, rows stay where they are read."""
    return documents.select(key, token_ids(F.col(text), path).alias("ids"))
