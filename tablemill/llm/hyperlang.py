"""Language identification by hyperdimensional letter profiles.

Every letter (and the gap between words) has a random vector of ``DIM`` signs,
derived from its code point, so all workers agree on it without a table. The
vector of a trigram binds those of its letters, permuted by place: it is the
product of the signs of the first letter rotated by two, the second rotated by
one, and the third. A text is the bundle, that is the sum, of the vectors of the
trigrams centred on each of its letters; a language is the bundle of all texts
learned for it. A text is given to the language with the largest cosine.

Letters are the code points of the Unicode categories L, in lower case, with the
marks (M) that belong to them; all else is a gap, and a run of it one gap.

Learning: each task adds up one vector of whole numbers per language and sends
those; Spark sums them by language and run of dimensions, so the sums are exact,
do not depend on the order of tasks, and a language that holds most rows costs no
more than another. Languages are compared in blocks of ``BLOCK``, the only thing
that passes through the driver (``BLOCK * DIM * 8`` bytes); more languages than
that take more passes over the texts, whatever their number.

A worker holds a batch, one piece of about a megabyte (or one longer text) with
its code points, and a few matrices of ``ROWS`` by ``TRIGRAMS`` or ``DIM``.

Rows: null texts, empty ones and those without a letter are 'und' with score 0,
as is every text if nothing was learned; they teach nothing, and rows with a null
language neither. Repeated rows count as often as they occur. Equal cosines: the
smallest language. Columns of other names, clashing or not, are kept as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import with_text_results, written
from .text import Piece, mix, pieces

DIM = 2048
#: Dimensions that travel in one row of the sums.
RUN = 64
BLOCK = 1024
#: Rows and distinct trigrams that are multiplied at a time.
ROWS = 256
TRIGRAMS = 4096
UNKNOWN = "und"

_U = np.uint64
_SEED = 0x5DEECE66D
_CODES = 0x110000


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """For each code point its sign: the lower-case letter or mark, or 0 for a gap."""
    table = np.zeros(_CODES, np.int32)
    for code in range(_CODES):
        if unicodedata.category(chr(code))[0] in "LM":
            small = chr(code).lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    codes = np.flatnonzero(_signs())
    table = np.zeros(_CODES, bool)
    table[[c for c in codes.tolist() if unicodedata.category(chr(c))[0] == "L"]] = True
    return table


def letter_bits(signs: np.ndarray) -> np.ndarray:
    """One row of ``DIM`` random bits per sign; 1 stands for -1."""
    place = np.arange(DIM // 64, dtype=np.uint64)
    seed = mix(signs.astype(np.uint64) + _U(_SEED))
    words = mix(seed[:, None] + (place + _U(1)) * _U(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)


def _code_points(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a piece and the bounds of its rows in them."""
    data = piece.data.tobytes()
    try:
        text = data.decode()
        starts = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        bounds = starts[piece.bounds]
    except UnicodeDecodeError:
        ends = piece.bounds.tolist()
        rows = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        text = "".join(rows)
        bounds = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), bounds


def trigrams(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, left, centre, right) of each letter or mark of rows that have a letter.

    The last three are numbers of signs in the array returned last.
    """
    codes, bounds = _code_points(piece)
    lettered = np.concatenate([[0], np.cumsum(_is_letter()[codes])])[bounds]
    has_letter = np.diff(lettered) > 0
    # A gap goes before each row and after the last, then runs of gaps are closed up.
    row = np.repeat(np.arange(piece.rows), np.diff(bounds))
    sign = np.insert(_signs()[codes], bounds, 0)
    row = np.insert(row, bounds[:-1], np.arange(piece.rows))
    row = np.append(row, piece.rows - 1)
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != 0) | (sign[:-1] != 0)
    sign, row = sign[keep], row[keep]
    known = np.flatnonzero(np.bincount(sign, minlength=1))
    number = np.zeros(known[-1] + 1, np.int64)
    number[known] = np.arange(len(known))
    centre = np.flatnonzero((sign != 0) & has_letter[row])
    sign = number[sign]
    return row[centre], np.stack([sign[centre - 1], sign[centre], sign[centre + 1]]), known


def bundles(piece: Piece) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, vectors, letters) of up to ``ROWS`` rows at a time; whole numbers as doubles."""
    rows, grams, known = trigrams(piece)
    bits = letter_bits(known)
    first, second, third = np.roll(bits, 2, axis=1), np.roll(bits, 1, axis=1), bits
    n = len(known)
    for start in range(0, piece.rows, ROWS):
        count = min(ROWS, piece.rows - start)
        a, b = np.searchsorted(rows, (start, start + count))
        row = rows[a:b] - start
        letters = np.bincount(row, minlength=count)
        left, centre, right = grams[:, a:b]
        gram, which = np.unique((left * n + centre) * n + right, return_inverse=True)
        order = np.argsort(which, kind="stable")
        row, which = row[order], which[order]
        # n - 2 * (number of ones): the product of signs is the exclusive or of bits.
        ones = np.zeros((count, DIM))
        for low in range(0, len(gram), TRIGRAMS):
            some = gram[low : low + TRIGRAMS]
            bound = first[some // (n * n)] ^ second[some // n % n] ^ third[some % n]
            c, d = np.searchsorted(which, (low, low + len(some)))
            cell = row[c:d] * len(some) + which[c:d] - low
            times = np.bincount(cell, minlength=count * len(some)).reshape(count, len(some))
            ones += _product(times, bound)
        yield start, letters[:, None] - 2 * ones, letters


def _product(times: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Exact: single precision holds whole numbers up to 2**24."""
    kind = np.float32 if times.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    return times.astype(kind) @ bound.astype(kind)


def _sums_schema() -> T.StructType:
    longs = [T.StructField(f"s{k}", T.LongType()) for k in range(RUN)]
    return T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("run", T.IntegerType()), *longs]
    )


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, run, s0, s1, ...): the bundle of each language, ``RUN`` dimensions a row."""
    schema = _sums_schema()
    arrow = to_arrow_schema(schema)

    def emit(held):
        for name, total in held.items():
            table = total.reshape(-1, RUN)
            columns = [pa.repeat(pa.scalar(name, pa.string()), len(table))]
            columns.append(pa.array(np.arange(len(table), dtype=np.int32)))
            columns += [pa.array(column) for column in table.T]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for piece in pieces(batch.column(0)):
                for start, vectors, letters in bundles(piece):
                    own = names[piece.first + start :][: len(letters)]
                    for name in set(own[letters > 0].tolist()):
                        total = vectors[(own == name) & (letters > 0)].sum(axis=0)
                        held[name] = held.get(name, 0) + total.astype(np.int64)
                    if len(held) > BLOCK:
                        yield from emit(held)
                        held = {}
        yield from emit(held)

    rows = docs.select(F.col(text), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    sums = rows.mapInArrow(run, schema).groupBy("lang", "run")
    return written(sums.agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(RUN))), "language-sums")


def _blocks(sums: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """The languages in order, with their vectors at length one, ``BLOCK`` at a time."""
    last = None
    while True:
        names = sums.select("lang").distinct()
        names = names.where(F.col("lang") > last) if last is not None else names
        some = [r.lang for r in names.orderBy("lang").limit(BLOCK).collect()]
        if not some:
            return
        chosen = sums.where((F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])).toArrow()
        vectors = np.zeros((len(some), DIM // RUN, RUN))
        at = np.searchsorted(np.array(some, object), np.array(chosen["lang"].to_pylist(), object))
        vectors[at, chosen["run"].to_numpy()] = np.stack(
            [chosen[f"s{k}"].to_numpy() for k in range(RUN)], axis=1
        )
        vectors = vectors.reshape(len(some), DIM)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        yield some, (vectors / np.where(length > 0, length, 1)).astype(np.float32)
        last = some[-1]


def predict(docs: DataFrame, sums: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score (the cosine, 0 if negative) last."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def kernel_for(names, profiles):
        def kernel(piece: Piece):
            best = np.full(piece.rows, UNKNOWN, object)
            score = np.full(piece.rows, -1.0)
            for start, vectors, letters in bundles(piece):
                length = np.linalg.norm(vectors, axis=1)
                cosine = vectors.astype(np.float32) @ profiles.T
                cosine = cosine / np.where(length > 0, length, 1)[:, None]
                top = cosine.argmax(axis=1)
                some = np.flatnonzero(letters > 0)
                best[start + some] = np.array(names, object)[top[some]]
                score[start + some] = np.clip(cosine[some, top[some]], 0, 1)
            return [pa.array(best.tolist(), pa.string()), score]

        return kernel

    width = len(docs.columns)
    place = docs.columns.index(text)
    out = docs.toDF(*(f"c{i}" for i in range(width)))
    found = []
    for k, (names, profiles) in enumerate(_blocks(sums)):
        own = [T.StructField(f"p{k}", T.StringType()), T.StructField(f"v{k}", T.DoubleType())]
        out = with_text_results(
            out,
            f"c{place}",
            own,
            lambda names=names, profiles=profiles: kernel_for(names, profiles),
            drop_text=False,
        )
        # with_text_results leaves the text where it was.
        found.append(F.struct(F.col(f"v{k}").alias("v"), F.col(f"p{k}").alias("p")))
    best = F.struct(F.lit(-1.0).alias("v"), F.lit(UNKNOWN).alias("p"))
    for one in found:
        best = F.when(one["v"] > best["v"], one).otherwise(best)
    kept = [i for i in range(width) if i != place]
    result = out.select(
        *(f"c{i}" for i in kept), best["p"].alias("p"), F.greatest(best["v"], F.lit(0.0)).alias("v")
    )
    return result.toDF(*(docs.columns[i] for i in kept), *(f.name for f in fields))
