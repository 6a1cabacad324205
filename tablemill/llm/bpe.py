"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word is a string of symbols: its bytes, the last one marked as the end of a
word. An Aho-Corasick automaton finds the longest token that begins at each
place. The encoder takes longest matches from the left; a token may follow
another only if the pair is compatible, that is, if merging in rank order
would not have joined something across their border first. If no token fits,
it takes a shorter one, or steps back; a place that once failed is never
entered again, so the time is linear in the word. The result is exactly the
one of merging in rank order. Decoding copies token texts out of one buffer by
their offsets.

The vocabulary file is read on the driver; its tables (fixed by the file, a few
megabytes) are sent to executors. Encoded words and compatible pairs are kept
in bounded tables per worker.

Rows: null counts as the empty text, which has no tokens.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, with_text_results
from .text import Piece

WORDS_KEPT = 200_000
PAIRS_KEPT = 400_000
END = "</w>"
DIGITS = [str(i) for i in range(1 << 16)]
# Fixed by the tokenizer's format: contractions, runs of letters, single digits, the rest.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Vocabulary:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            """Bytes as characters below 256; the last one of a word 256 higher."""
            ends = token.endswith(END)
            body = [byte_of[c] for c in (token[: -len(END)] if ends else token)]
            if ends:
                body[-1] += 256
            return "".join(map(chr, body))

        self.text = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.text[i] = token
        self.symbols = [symbols(token) for token in self.text]
        self.ids = {s: i for i, s in enumerate(self.symbols)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.text))]
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[left], vocab[right])
            whole = vocab[left + right]
            self.pairs[pair] = whole
            self.rank[pair] = rank
            self.halves[whole] = pair
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.text += [""] * (i + 1 - len(self.text))
            self.text[i] = content
        # Tokens that merging in rank order really makes from their own symbols.
        self.reachable = [
            i for i, s in enumerate(self.symbols) if len(s) == 1 or self.merged(s) == [i]
        ]

    def merged(self, word: str) -> list[int]:
        """Encode by merging the lowest rank first; for building tables and for tests."""
        tokens = [self.ids[c] for c in word]
        while len(tokens) > 1:
            ranked = [
                (self.rank.get(pair, 1 << 60), at)
                for at, pair in enumerate(zip(tokens, tokens[1:], strict=False))
            ]
            rank, at = min(ranked)
            if rank == 1 << 60:
                break
            tokens[at : at + 2] = [self.pairs[tokens[at], tokens[at + 1]]]
        return tokens


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Words(dict):
    """Encoded words by their text, as (ids in four bytes each, ids as text); filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        ids = self.encode(word)
        found = (array("i", ids).tobytes(), " ".join([DIGITS[i] for i in ids]))
        self[word] = found
        return found


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.length = [len(s) for s in vocabulary.symbols]
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.reachable:
            self.automaton.add_word(vocabulary.symbols[i], i)
        self.automaton.make_automaton()
        known = {vocabulary.symbols[i]: i for i in vocabulary.reachable}
        # The longest shorter token that begins a token.
        self.shorter = [-1] * len(self.length)
        for s, i in known.items():
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in known:
                    self.shorter[i] = known[s[:n]]
                    break
        self.compatible: dict[int, bool] = {}
        self.words = _Words(self.encode_word)
        self.split = (
            regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")")
            if vocabulary.special
            else None
        )
        texts = [t.encode() for t in vocabulary.text]
        self.blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves these two tokens side by side.

        The merges that made the two are undone from the latest to the
        earliest; at each point, a merge across the border that ranks before
        the one just undone would have come first.
        """
        if len(self.compatible) >= PAIRS_KEPT:
            self.compatible.clear()
        found = self.compatible[left << 20 | right] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        rank, halves, infinite = self.v.rank, self.v.halves, 1 << 60
        undone = infinite
        while True:
            across = rank.get((left, right), infinite)
            # Of equal merges the left one comes first, so what was undone on the
            # left side needs a strictly lower rank to be overtaken.
            if across < undone:
                return False
            whole_left = halves[left] == (left, left)
            whole_right = halves[right] == (right, right)
            if whole_left and whole_right:
                return True
            rank_left = -1 if whole_left else rank[halves[left]]
            rank_right = -1 if whole_right else rank[halves[right]]
            if rank_left > rank_right:
                undone, left = rank_left, halves[left][1]
            else:
                undone, right = rank_right + 1, halves[right][0]

    def encode_word(self, word: str) -> list[int]:
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        raw = word.encode("utf-8").decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + 256)
        n = len(symbols)
        best = [0] * n
        length = self.length
        for end, token in self.automaton.iter(symbols):
            best[end - length[token] + 1] = token
        open_at = [True] * (n + 1)
        tokens: list[int] = []
        compatible = self.compatible
        at, token = 0, best[0]
        while True:
            end = at + length[token]
            fits = open_at[end]
            if fits and tokens:
                fits = compatible.get(tokens[-1] << 20 | token)
                if fits is None:
                    fits = self.fits(tokens[-1], token)
            if fits:
                tokens.append(token)
                if end == n:
                    return tokens
                at, token = end, best[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = False
                token = tokens.pop()
                at -= length[token]

    def pieces(self, text: str) -> Iterable[str]:
        # Lower case by character, as the tokenizer does: a final sigma is not special.
        normal = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return PIECES.findall(normal)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, as 32-bit numbers and as decimal numbers with spaces between."""
        words = self.words
        if self.split is None or "<|" not in text:
            parts = [words[p] for p in self.pieces(text)]
        else:
            parts = []
            for segment in self.split.split(text):
                special = self.v.special.get(segment)
                if special is not None:
                    parts.append((array("i", [special]).tobytes(), str(special)))
                elif segment:
                    parts += [words[p] for p in self.pieces(segment)]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts with a space between, as UTF-8."""
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[place].tobytes()[:-1]


def _coder(shared) -> Coder:
    """One coder per worker and vocabulary, kept for the next task."""
    return held(("coder", shared.value["key"]), lambda: Coder(shared.value["vocabulary"]))


def _share(docs: DataFrame, path: str):
    shared = docs.sparkSession.sparkContext.broadcast({"key": path, "vocabulary": load(path)})
    # The driver encodes nothing, so it keeps no copy.
    load.cache_clear()
    return shared


def _texts(piece: Piece) -> list[str]:
    raw = piece.data.tobytes()
    return [
        raw[a:b].decode("utf-8")
        for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True)
    ]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) to the rows; the text stays."""
    shared = _share(docs, path)

    def make_kernel():
        coder = _coder(shared)
        return lambda piece: [[np.frombuffer(coder.encode(t)[0], np.int32) for t in _texts(piece)]]

    field = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    return with_text_results(docs, text, [field], make_kernel, drop_text=False)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (text) to rows with an array of ids; null for null."""
    shared = _share(rows, path)

    @F.pandas_udf(T.StringType())
    def decoded(column: pd.Series) -> pd.Series:
        coder = _coder(shared)
        return column.map(
            lambda a: None if a is None else coder.decode(np.asarray(a, np.int64)).decode("utf-8")
        )

    return rows.withColumn("decoded", decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: n_tokens, ids_sha256, decoded_sha256 in the text's place."""
    shared = _share(docs, path)
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make_kernel():
        coder = _coder(shared)

        def kernel(piece: Piece):
            n, first, second = [], [], []
            for body in _texts(piece):
                ids, digits = coder.encode(body)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(digits.encode()).hexdigest())
                back = coder.decode(np.frombuffer(ids, np.int32))
                second.append(hashlib.sha256(back).hexdigest())
            return [n, first, second]

        return kernel

    return with_text_results(docs, text, fields, make_kernel)
