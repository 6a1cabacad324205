"""Cross-tokenizer alignment: tokens of two tokenizers that end at the same byte.

Both tokenizers encode a text; where a token of A and one of B end at the same
byte they are linked, and all tokens since the link before form a group. The two
rows of ends are merged in lockstep: one vector of pointers into A and one into B
holds the state of all documents of a piece, and each step compares all pairs of
ends at once, emits the links and cuts of that step, advances the pointers that
are behind, and takes finished documents out of the vectors. A document of more
than ``LANE`` tokens gets a lane for each ``LANE`` of them; a lane starts at the
first token of B that ends after the lane before, so lanes need not wait for each
other and a very long text costs no more steps than others.

How often a pair of ids is linked is counted over the whole corpus. Documents look
the counts up where they are: the pairs with at least ``SENT_SHARE`` of all links
(so at most ``1 / SENT_SHARE``, about a million, 17 bytes each) are sent to the
executors, all others are joined; none of these has so many links that it could
overload a task.

Each distinct word of a piece is encoded once, if the tokenizers allow that, see
``Encoder``; otherwise whole texts are. A worker holds an Arrow batch, the ids of one
piece of about four megabytes, and the arrays of ``TOKENS`` tokens (or of one longer
text), some 200 bytes each; results leave part by part, and nothing is kept.

Rows: a text has no tokens if it is null or empty, or if the joined bytes of the
tokens of A or B are not those of a space and the text (a normaliser changed it,
or a token has no bytes): its counts are zero, its groups empty, and it counts for
nothing. Special tokens written out in a text are plain text. Repeated rows count
each; null and repeated ids do no harm. Pairs with equal counts are all the best
of their B id. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written
from .text import Piece, pieces, runs_of, span_hashes

LANE = 256
#: Bytes of text that are encoded at a time, words in a line, tokens of A that are aligned at a time.
PIECE = 1 << 22
LINE = 256
TOKENS = 1 << 18
SENT_SHARE = 2.0**-20

_ALIGNED = [
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType(), False)),
    T.StructField("times", T.ArrayType(T.IntegerType(), False)),
]


@dataclass(frozen=True)
class Runs:
    """Runs of numbers laid end to end: run i is ``body[first[i]:first[i] + size[i]]``."""

    body: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, body: np.ndarray, size) -> Runs:
        size = np.array(size, np.int64)
        return cls(body, np.cumsum(size) - size, size)

    @classmethod
    def of_strings(cls, strings: list[bytes]) -> Runs:
        return cls.of(np.frombuffer(b"".join(strings), np.uint8), [len(s) for s in strings])

    def joined(self, runs: np.ndarray) -> np.ndarray:
        size = self.size[runs]
        shift = self.first[runs] - (np.cumsum(size) - size)
        return self.body[np.repeat(shift, size) + np.arange(size.sum())]


@dataclass(frozen=True)
class Encoder:
    """``encode`` gives the ids of a space and each text; ``tokens`` the bytes of each id.

    With ``by_words`` no token reaches over a space that follows a graphic ASCII
    character, and texts cut before such spaces have the same tokens.
    """

    encode: Callable[[list[str]], list[list[int]]]
    tokens: Runs
    by_words: bool


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """A byte-level vocabulary file; it gets a space before each text."""
    # Tasks are the unit of parallel work, not threads within them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    letters = _byte_letters()

    def token(number: int) -> bytes:
        entry = library.id_to_token(number)
        if entry is None or any(c not in letters for c in entry):
            return b""
        return bytes(letters[c] for c in entry)

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + text for text in texts]
        return [e.ids for e in library.encode_batch_fast(spaced, add_special_tokens=False)]

    size = 1 + max(library.get_vocab(with_added_tokens=True).values())
    # The pattern that cuts texts before merging starts a cut at each such space.
    setup = json.loads(library.to_str())
    cuts = setup["pre_tokenizer"] or {}
    by_words = not setup["normalizer"] and cuts.get("type") == "ByteLevel" and cuts["use_regex"]
    return Encoder(encode, Runs.of_strings([token(i) for i in range(size)]), bool(by_words))


@lru_cache(maxsize=2)
def pieced(path: str) -> Encoder:
    """A model of pieces with byte fallback; it adds the space by itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(number: int) -> bytes:
        piece = library.id_to_piece(number)
        if library.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    numbers = range(library.get_piece_size())
    # Merging never makes what no piece has: a space after something else.
    by_words = not any("▁" in library.id_to_piece(i).lstrip("▁") for i in numbers)
    by_words &= library.normalize(" a  b ") == "▁▁a▁▁b▁"
    return Encoder(
        lambda texts: library.encode(texts, num_threads=1),
        Runs.of_strings([token(i) for i in numbers]),
        by_words,
    )


def id_count(path_b: str) -> int:
    """How many ids a model of pieces has; pairs are numbered with it."""
    return len(pieced(path_b).tokens.size)


@dataclass(frozen=True)
class Encoded:
    """The ids of all rows, where each row's begin, and which rows they spell."""

    ids: np.ndarray
    first: np.ndarray
    good: np.ndarray

    def rows(self, start: int, stop: int) -> Encoded:
        first = self.first[start : stop + 1]
        return Encoded(self.ids[first[0] : first[-1]], first - first[0], self.good[start:stop])


def encoded(piece: Piece, encoder: Encoder) -> Encoded:
    """Rows by their words, each distinct word (with what precedes it) encoded once."""
    data, bounds = piece.data, piece.bounds
    filled = np.flatnonzero(np.diff(bounds) > 0)
    starts, ends = bounds[filled], bounds[filled + 1]
    if encoder.by_words and len(data) > 2:
        # The cut space is the one that the encoder adds.
        graphic = (data > 0x20) & (data < 0x7F)
        cut = np.flatnonzero((data[1:-1] == 0x20) & graphic[:-2]) + 1
        row = np.searchsorted(bounds, cut, "right") - 1
        cut = cut[(cut > bounds[row]) & (cut + 1 < bounds[row + 1])]
        starts, ends = np.sort(np.append(starts, cut + 1)), np.sort(np.append(ends, cut))
    _, some, which = np.unique(
        span_hashes(data, starts, ends), return_index=True, return_inverse=True
    )
    starts_of, ends_of = starts[some], ends[some]
    body = data.tobytes()
    texts = [body[x:y] for x, y in zip(starts_of.tolist(), ends_of.tolist(), strict=True)]
    words = _encoded_words(texts, encoder)
    spells = _spells(encoder.tokens, words, Runs.of_strings([b" " + text for text in texts]))
    owner = np.searchsorted(bounds, starts, "right") - 1
    n = np.bincount(owner, words.size[which], piece.rows).astype(np.int64)
    good = np.bincount(owner, ~spells[which], piece.rows) == 0
    first = np.concatenate([[0], np.cumsum(n)])
    return Encoded(words.joined(which), first, good)


def _encoded_words(texts: list[bytes], encoder: Encoder) -> Runs:
    """The ids of each text. Words that may stand before a space are encoded in lines."""

    def one_by_one(some: list[bytes]) -> Runs:
        lists = encoder.encode([text.decode(errors="replace") for text in some])
        size = [len(ids) for ids in lists]
        return Runs.of(np.fromiter(chain.from_iterable(lists), np.int64, sum(size)), size)

    if not encoder.by_words:
        return one_by_one(texts)
    inner = np.array([0x20 < text[-1] < 0x7F for text in texts], bool)
    line = [text for text, yes in zip(texts, inner.tolist(), strict=True) if yes]
    lines = [b" ".join(line[i : i + LINE]) for i in range(0, len(line), LINE)]
    ids = one_by_one(lines).body
    ends = np.cumsum([len(text) + 1 for text in line])
    spelled = np.cumsum(encoder.tokens.size[ids])
    at = np.searchsorted(spelled, ends)
    if not len(line) or len(spelled) != at[-1] + 1 or (spelled[at] != ends).any():
        # Something changed some of them, so their ends are not known.
        return one_by_one(texts)
    rest = one_by_one([text for text, yes in zip(texts, inner.tolist(), strict=True) if not yes])
    size = np.empty(len(texts), np.int64)
    size[inner], size[~inner] = np.diff(np.concatenate([[0], at + 1])), rest.size
    first = np.empty(len(texts), np.int64)
    first[inner] = np.cumsum(size[inner]) - size[inner]
    first[~inner] = len(ids) + rest.first
    return Runs(np.concatenate([ids, rest.body]), first, size)


def _spells(tokens: Runs, words: Runs, texts: Runs) -> np.ndarray:
    """Which words' tokens, joined, are their texts; a token without bytes spells nothing."""
    every = np.arange(len(words.size))
    number, sizes = np.repeat(every, words.size), tokens.size[words.joined(every)]
    good = np.bincount(number, sizes, len(every)) == texts.size
    good[number[sizes == 0]] = False
    some = np.flatnonzero(good)
    differ = tokens.joined(words.joined(some)) != texts.joined(some)
    good[np.repeat(some, texts.size[some])[differ]] = False
    return good


def merge(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> tuple:
    """Places in both arrays of ends that are equal, found for all rows in lockstep.

    Ends ascend over all rows together; every row's last ends are equal.
    """
    size = np.diff(first_a)
    lanes = -(-size // LANE)
    row = np.repeat(np.arange(len(size)), lanes)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = first_a[row] + number * LANE
    stop = np.minimum(a + LANE, first_a[row + 1])
    before = np.where(a > 0, ends_a[a - 1], 0) if len(a) else a
    b = np.searchsorted(ends_b, before, "right")
    links_a, links_b = [a[:0]], [b[:0]]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        equal = end_a == end_b
        links_a.append(a[equal])
        links_b.append(b[equal])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


@lru_cache(maxsize=1)
def _decimals(size: int) -> Runs:
    return Runs.of_strings([b"%d," % i for i in range(size)])


def _spelled_groups(a, b, links_a, links_b, first_a, first_b) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each row."""
    # Each token's place when groups come one by one, A before B in each.
    group_a = np.searchsorted(links_a, np.arange(len(a)), "left")
    group_b = np.searchsorted(links_b, np.arange(len(b)), "left")
    before_b = np.concatenate([[0], links_b + 1])
    items = np.empty(len(a) + len(b), np.int64)
    items[np.arange(len(a)) + before_b[group_a]] = a
    items[np.arange(len(b)) + links_a[group_b] + 1] = b
    text = _decimals(1 << int(items.max(initial=1)).bit_length())
    size = text.size[items]
    ends = np.cumsum(size)
    body = text.joined(items)
    body[ends[links_a + before_b[:-1]] - 1] = ord("|")
    body[ends[links_a + links_b + 1] - 1] = ord(";")
    # A row's last separator goes; empty rows have none.
    rows = first_a + first_b
    last = rows[1:][np.diff(rows) > 0] - 1
    stay = np.ones(len(body), bool)
    stay[ends[last] - 1] = False
    bounds = np.concatenate([[0], ends])[rows] - np.concatenate([[0], np.cumsum(np.diff(rows) > 0)])
    data = pa.py_buffer(np.ascontiguousarray(body[stay]))
    kind = pa.string() if bounds[-1] < 1 << 31 else pa.large_string()
    width = np.int32 if bounds[-1] < 1 << 31 else np.int64
    return pa.Array.from_buffers(kind, len(rows) - 1, [None, pa.py_buffer(bounds.astype(width)), data])


def _aligned(piece: Piece, one: Encoder, other: Encoder) -> Iterator[tuple[int, list[pa.Array]]]:
    """Number of rows and the columns ``_ALIGNED`` of some rows of a piece, then of the next ones."""
    a, b = encoded(piece, one), encoded(piece, other)
    good = a.good & b.good
    row = 0
    while row < piece.rows:
        stop = int(np.searchsorted(a.first, a.first[row] + TOKENS, "right")) - 1
        stop = min(max(stop, row + 1), piece.rows)
        yield stop - row, _columns(a.rows(row, stop), b.rows(row, stop), good[row:stop], one, other)
        row = stop


def _columns(a: Encoded, b: Encoded, good, one: Encoder, other: Encoder) -> list[pa.Array]:
    n_a, n_b = (np.where(good, np.diff(e.first), 0) for e in (a, b))
    a, b = (e.ids[np.repeat(good, np.diff(e.first))] for e in (a, b))
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    links_a, links_b = merge(
        np.cumsum(one.tokens.size[a]), np.cumsum(other.tokens.size[b]), first_a
    )
    cuts = np.searchsorted(links_a, first_a)
    n_links = np.diff(cuts)
    pair = a[links_a] * len(other.tokens.size) + b[links_b]
    row = np.repeat(np.arange(len(good)), n_links)
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    heads = runs_of(row, pair)
    lists = np.searchsorted(row[heads[:-1]], np.arange(len(good) + 1)).astype(np.int32)
    groups = _spelled_groups(a, b, links_a, links_b, first_a, first_b)
    return [
        *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_links, n_links)),
        groups,
        pa.ListArray.from_arrays(lists, pair[heads[:-1]]),
        pa.ListArray.from_arrays(lists, np.diff(heads).astype(np.int32)),
    ]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, then n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the decimal ids in order. ``pairs`` has each
    linked pair of ids of the document once, as ``a * (ids of B) + b``, and
    ``times`` how often. The paths are those of the vocabulary files on the workers.
    """
    names = docs.columns
    at = names.index(text)
    kept = [i for i in range(len(names)) if i != at]
    boxed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    new = [T.StructField(f"new{k}", f.dataType) for k, f in enumerate(_ALIGNED)]
    schema = T.StructType([boxed.schema[i] for i in kept] + new)
    arrow = to_arrow_schema(schema)

    def run(batches):
        one, other = byte_level(path_a), pieced(path_b)
        for batch in batches:
            for piece in pieces(batch.column(at), PIECE):
                start = piece.first
                for rows, new in _aligned(piece, one, other):
                    columns = [batch.column(i).slice(start, rows) for i in kept] + new
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                    )
                    start += rows

    out = boxed.mapInArrow(run, schema)
    return out.toDF(*(names[i] for i in kept), *(f.name for f in _ALIGNED))


def pair_counts(aligned: DataFrame, ids_of_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair, and whether no pair of its B id has more."""
    linked = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = linked.groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum(F.col("p.times").cast("long")).alias("n")
    )
    counts = written(counts, "pair-counts")
    b = (F.col("pair") % ids_of_b).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    marked = counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return written(marked, "pair-ranks")


def score_links(aligned: DataFrame, ids_of_b: int) -> DataFrame:
    """``aligned`` without pairs and times, then n_best and count_sum.

    ``n_best``: links whose pair is as frequent as any of its B id; ``count_sum``:
    the counts of the pairs, added up over links. Counts are those of all rows of
    ``aligned``, which should be a written table, as it is read three times.
    """
    names = aligned.columns
    boxed = aligned.toDF(*(f"c{i}" for i in range(len(names))))
    pairs, times = (f"c{names.index(c)}" for c in ("pairs", "times"))
    kept = [f"c{i}" for i, c in enumerate(names) if f"c{i}" not in (pairs, times)]
    counts = pair_counts(boxed.select(F.col(pairs).alias("pairs"), F.col(times).alias("times")), ids_of_b)
    links = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, int(links * SENT_SHARE))
    sent = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    known = tuple(sent[c].to_numpy() for c in ("pair", "n", "best"))
    known = aligned.sparkSession.sparkContext.broadcast(known)
    fields = {f"c{i}": boxed.schema[f"c{i}"] for i in range(len(names))}
    schema = T.StructType(
        [fields[c] for c in kept]
        + [T.StructField(c, T.LongType()) for c in ("row", "n_best", "count_sum")]
        + [T.StructField("pairs", fields[pairs].dataType), T.StructField("times", fields[times].dataType)]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        pair, n, best = known.value
        for batch in batches:
            lists, often = batch.column("pairs"), batch.column("times")
            first = lists.offsets.to_numpy().astype(np.int64)
            value = lists.values.to_numpy()[first[0] : first[-1]]
            many = often.flatten().to_numpy().astype(np.int64)
            first = first - first[0]
            at = np.minimum(np.searchsorted(pair, value), max(len(pair) - 1, 0))
            found = pair[at] == value if len(pair) else np.zeros(len(value), bool)
            counts_here = np.where(found, n[at], 0) if len(pair) else many * 0
            best_here = found & best[at] if len(pair) else found
            sums = [
                np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                for x in (many * best_here, many * counts_here)
            ]
            rest = np.concatenate([[0], np.cumsum(~found)])[first].astype(np.int32)
            new = [
                batch.column("row"),
                *(pa.array(s, pa.int64()) for s in sums),
                pa.ListArray.from_arrays(rest, value[~found]),
                pa.ListArray.from_arrays(rest, many[~found].astype(np.int32)),
            ]
            columns = [batch.column(c) for c in kept] + new
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    numbered = boxed.select(
        *kept, F.monotonically_increasing_id().alias("row"), F.col(pairs).alias("pairs"), F.col(times).alias("times")
    )
    # Written, so that a row keeps its number.
    part = written(numbered.mapInArrow(run, schema), "known-pairs")
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times")
    )
    few = counts.where(F.col("n") < least)
    more = (
        rare.join(few, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    out = part.join(more, "row", "left").select(
        *kept,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("best_links"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("sum_links"),
    )
    left = [c for c in names if c not in ("pairs", "times")]
    return out.toDF(*left, "n_best", "count_sum")
