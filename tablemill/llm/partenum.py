"""Exact n-gram Jaccard join by PartEnum signatures, and the components of its links.

A text is the set of hashes of its word n-grams. Sets are put into bands of
similar size; a set near the top of its band joins the next one as well, so
two sets that can be similar share a band. In a band whose sets differ in at
most k elements when similar, the features are dealt by hash into more than k
parts: similar sets agree on a whole part. The signature of a part is the hash
of the features in it. There are some parts to spare, so that sets with few
empty parts agree on one with features; only sets with more empty parts than
that sign those too.

Sets that are equal are one node, however many documents have them. The nodes
of a signature are not paired with each other: each is compared, in full, with
the most central node of the signature, that which meets the most other nodes in
all its signatures: of edited copies, one that is close to the original. Before
that, small sketches of the sets split each star: bits that hold the parity of the
features dealt to them differ in no more places than the sets do, so nodes whose
sketches differ in more than a link allows, most that share no more than a passage,
part without their texts being moved; stars of more than ``STAR_NODES`` nodes stay
whole. What
this leaves open between two nodes x, y with the same centre c is settled by how
they differ from it: with x and y at distances h(x), h(y) from c, they are
certainly linked if h(x) + h(y) is within their limit, and otherwise only if the
two differences share t features or more, with 2t = h(x) + h(y) - limit. Of these, no more
can be features of c that both lack than either lacks. The rest must be features
that c has not, and edits made apart from each other hardly share one; so
a join on the rarest of those finds the pairs (prefix filter, by place in the
order). Only pairs that lacked features alone could link are joined on these.
Work grows with the links and near-links; no link is lost.

The (signature, node) rows are dealt out by range and sorted, so a signature
that very many nodes have is spread over tasks; the pieces at the edges of
ranges find their common centre by a small aggregation.

Rows: null and empty texts have no set and are linked with nothing; texts of
fewer than n words have one n-gram, the whole; repeated rows and null ids are
allowed (a component's id is its smallest non-null one). Hashes are of 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import collected, counted, maybe_among, with_text_results, written
from .components import components
from .text import (
    LOWER,
    Piece,
    distinct_in_rows,
    mix,
    ngram_hashes,
    pieces,
    runs_of,
    span_hashes,
    words,
)

_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Linked: den * |intersection| >= num * |union| of sets of ``n`` word n-grams."""

    n: int = 5
    num: int = 80
    den: int = 100

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last set size of each band, up to more than any text has."""
        low, high = [1], []
        ratio = (self.den / self.num) ** 1.5
        while low[-1] < 1 << 40:
            high.append(max(low[-1], int(low[-1] * ratio)))
            low.append(high[-1] + 1)
        return np.array(low[:-1], np.int64), np.array(high, np.int64)

    def most_apart(self, both_sizes):
        """The largest symmetric difference of linked sets with this sum of sizes."""
        return (self.den - self.num) * both_sizes // (self.den + self.num)

    def spare_parts(self) -> np.ndarray:
        """Parts to add in each band so that hardly any of its sets has more empty ones.

        A set of the smallest size that signs in a band, dealt into p parts, leaves
        p * exp(-size / p) of them empty on average. Any number is right; a better
        one means fewer signatures of empty parts.
        """
        low, high = self.bands()
        smallest = np.maximum(low * self.num // self.den, 1)
        apart = self.most_apart(2 * high)
        spare = np.zeros(len(high), np.int64)
        for _ in range(4):
            parts = apart + 1 + spare
            empty = parts * np.exp(-smallest / parts)
            spare = np.minimum(np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64), 2 + apart)
        return spare

    def partners(self, size):
        """The largest set that can be linked to one of this size."""
        return size * self.den // self.num


def features(piece: Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row of a piece, and their rows."""
    data = LOWER[piece.data]
    found = words(piece)
    grams, rows = ngram_hashes(span_hashes(data, found.starts, found.ends), found.first, n)
    return distinct_in_rows(grams, rows)


def node_of(values: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and identity of each row's set."""
    size = np.bincount(rows, minlength=count)
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + _U(0x51)), out=total[1:])
    raw = total[first[1:]] - total[first[:-1]]
    return size, mix(raw + size.astype(np.uint64) * _U(0xA0761D6478BD642F)).view(np.int64)


def signatures(
    values: np.ndarray, rows: np.ndarray, size: np.ndarray, like: Similarity
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all rows; ``values`` are their sets, rows ascending."""
    _, high = like.bands()
    spares = like.spare_parts()
    band = np.searchsorted(high, size, "left")
    out, owner = [], []
    for step in (0, 1):
        used = size > 0
        if step:
            used &= like.partners(size) > high[band]
        tag = band + step
        apart = like.most_apart(2 * high[np.minimum(tag, len(high) - 1)])
        # Sets that may not differ at all are equal: they are one node already.
        used &= apart > 0
        spare = spares[np.minimum(tag, len(high) - 1)]
        parts = apart + 1 + spare
        mine = used[rows]
        v, r = values[mine], rows[mine]
        if not len(v):
            continue
        salt = mix(tag.astype(np.uint64) + _U(0x1234))
        part = (mix(v ^ salt[r]) % parts.astype(np.uint64)[r]).astype(np.int64)
        order = np.lexsort((part, r))
        v, r, part = v[order], r[order], part[order]
        heads = runs_of(r, part)
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(mix(v + _U(0x77)), out=total[1:])
        body = total[heads[1:]] - total[heads[:-1]]
        r, part = r[heads[:-1]], part[heads[:-1]]
        out.append(mix(body + mix(salt[r] + part.astype(np.uint64) * _U(0x9E3779B97F4A7C15))))
        owner.append(r)
        # Rows with more empty parts than are to spare sign these, too.
        full = np.bincount(r, minlength=len(size))
        for row in np.flatnonzero(used & (parts - full > spare)):
            empty = np.setdiff1d(np.arange(parts[row]), part[r == row]).astype(np.uint64)
            own = mix(salt[row : row + 1] + _U(0xE))
            out.append(mix(own + empty * _U(0xD6E8FEB86659FD93)))
            owner.append(np.full(len(empty), row))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


MOST_SKETCH_BITS = 1 << 16


def sketches(values: np.ndarray, rows: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bits of each row's set: a power of two of 64 bits or more, about as many as features.

    A feature sets one bit, by the low bits of its hash, so that the halves of a
    sketch, one over the other, are the sketch with half as many bits.
    """
    bits = np.full(len(size), 64, np.int64)
    while (more := (bits < size) & (bits < MOST_SKETCH_BITS)).any():
        bits[more] *= 2
    first = np.concatenate([[0], np.cumsum(bits)])
    low = (mix(values + _U(0xB17)) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[:-1][rows] + low, minlength=first[-1]) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist(), strict=True)]


_SIGNED = T.StructType(
    [T.StructField("sig", T.LongType()), T.StructField("node", T.LongType())]
)


HELD_NODES = 1 << 18


def _signed(docs: DataFrame, like: Similarity) -> DataFrame:
    """(sig, node) of all texts; a task leaves out most repeats of a node it has signed."""
    schema = to_arrow_schema(_SIGNED)

    def run(batches):
        signed: set[int] = set()
        for batch in batches:
            for piece in pieces(batch.column(0)):
                values, rows = features(piece, like.n)
                size, node = node_of(values, rows, piece.rows)
                for row, one in enumerate(node.tolist()):
                    if one in signed:
                        size[row] = 0
                    signed.add(one)
                if len(signed) > HELD_NODES:
                    signed.clear()
                sig, owner = signatures(values, rows, size, like)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(node[owner])], schema=schema
                )

    return docs.select("text").mapInArrow(run, _SIGNED)


_SHARED = T.StructType([*_SIGNED.fields, T.StructField("size", T.LongType())])


def _shared(batches):
    """Of sorted (sig, node) rows: distinct ones whose signature may have several nodes.

    ``size`` is the number of its nodes in the batch. The first and last signature
    of a batch may go on in another one, so they stay.
    """
    schema = to_arrow_schema(_SHARED)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = runs_of(sig, node)[:-1]
        sig, node = sig[new], node[new]
        heads = runs_of(sig)
        size = np.diff(heads)
        stay = size > 1
        stay[0] = stay[-1] = True
        stay = np.repeat(stay, size)
        columns = (sig[stay], node[stay], np.repeat(size, size)[stay])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


_STARS = T.StructType(
    [
        T.StructField("sig", T.LongType()),
        T.StructField("c", T.LongType()),
        T.StructField("x", T.LongType()),
        T.StructField("edge", T.BooleanType()),
    ]
)


def _stars(batches):
    """Of sorted (sig, rank, node) rows: each node with the first of its signature.

    The first and last signature of a batch may go on in another one; their
    nodes come out as edges, with their rank in place of a centre.
    """
    schema = to_arrow_schema(_STARS)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, rank, node = (batch.column(i).to_numpy() for i in range(3))
        new = runs_of(sig, node)[:-1]
        sig, rank, node = sig[new], rank[new], node[new]
        heads = runs_of(sig)
        centre = np.repeat(node[heads[:-1]], np.diff(heads))
        edge = (sig == sig[0]) | (sig == sig[-1])
        stay = edge | (centre != node)
        columns = (sig, np.where(edge, rank, centre), node, edge)
        yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in columns], schema=schema)


def candidate_stars(docs: DataFrame, like: Similarity) -> DataFrame:
    """Distinct (c, x): nodes and the most central node they share a signature with."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = _signed(docs, like).repartitionByRange(ranges, "sig", "node")
    shared = written(
        signed.sortWithinPartitions("sig", "node").mapInArrow(_shared, _SHARED), "signatures"
    )
    central = shared.groupBy("node").agg((-F.sum("size")).alias("rank"))
    found = written(
        shared.join(central, "node")
        .select("sig", "rank", "node")
        .repartitionByRange(ranges, "sig", "rank", "node")
        .sortWithinPartitions("sig", "rank", "node")
        .mapInArrow(_stars, _STARS),
        "star-edges",
    )
    edge = found.where("edge").select("sig", "x", F.struct("c", "x").alias("place"))
    centres = edge.groupBy("sig").agg(F.min("place")["x"].alias("c"))
    pairs = found.where("not edge").select("c", "x").unionByName(
        edge.join(centres, "sig").where("c <> x").select("c", "x")
    )
    return pairs.distinct()


# Outer nodes of a star, at most, that are held against each other by their sketches.
STAR_NODES = 2048
_PAIRS = T.StructType([T.StructField("c", T.LongType()), T.StructField("x", T.LongType())])


def may_link(size: np.ndarray, sketch: list[np.ndarray], like: Similarity) -> np.ndarray:
    """Which of these sets may be linked to each other: a matrix, false on its diagonal."""
    n, length = len(size), np.array([len(s) for s in sketch])
    found = np.zeros((n, n), bool)
    for words_ in np.unique(length):
        longer = np.flatnonzero(length >= words_)
        folded = np.stack(
            [np.bitwise_xor.reduce(sketch[i].reshape(-1, words_), axis=0) for i in longer]
        )
        own = np.flatnonzero(length[longer] == words_)
        step = max(1, (1 << 20) // folded.size)
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            apart = np.bitwise_count(folded[mine, None] ^ folded[None]).sum(axis=2, dtype=np.int64)
            a, b = size[longer[mine]][:, None], size[longer][None]
            fits = apart <= like.most_apart(a + b)
            fits &= (like.den * a >= like.num * b) & (like.den * b >= like.num * a)
            found[np.ix_(longer[mine], longer)] = fits
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def parted(node: np.ndarray, near: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (centre, other) of the connected parts of a star; the centre has most neighbours."""
    centres, others = [], []
    degree = near.sum(axis=1)
    open_ = degree > 0
    for start in range(len(node)):
        if not open_[start]:
            continue
        mine = np.zeros(len(node), bool)
        edge = np.array([start])
        mine[start] = True
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & ~mine)
            mine[edge] = True
        open_ &= ~mine
        part = np.flatnonzero(mine)
        centre = part[np.lexsort((node[part], -degree[part]))[0]]
        part = part[part != centre]
        centres += [int(node[centre])] * len(part)
        others += node[part].tolist()
    return centres, others


def split_stars(stars: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Distinct (c, x) of the parts of stars within which sets may be linked.

    ``sets`` has node, size and sketch. Nodes that can be linked to no other of
    their star go; no two that are linked part.
    """
    schema = to_arrow_schema(_PAIRS)
    large = F.broadcast(stars.groupBy("c").count().where(F.col("count") > STAR_NODES).select("c"))
    small = stars.join(large, "c", "left_anti")
    members = small.unionByName(small.select("c", F.col("c").alias("x")).distinct())
    members = members.join(sets, members["x"] == sets["node"]).select("c", "x", "size", "sketch")

    def split(held):
        c, node, size = (np.concatenate(part) for part in list(zip(*held, strict=True))[:3])
        sketch = [np.frombuffer(s, np.uint64) for part in held for s in part[3]]
        heads = runs_of(c).tolist()
        centres, others = [], []
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            more = parted(node[a:b], may_link(size[a:b], sketch[a:b], like))
            centres += more[0]
            others += more[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(centres, pa.int64()), pa.array(others, pa.int64())], schema=schema
        )

    def run(batches):
        held = []  # the last star may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            c, node, size = (batch.column(i).to_numpy() for i in range(3))
            sketch = batch.column(3).to_pylist()
            if held and c[0] != held[-1][0][-1]:
                yield split(held)
                held = []
            last = int(runs_of(c)[-2])
            if last:
                held.append((c[:last], node[:last], size[:last], sketch[:last]))
                yield split(held)
                held = []
            held.append((c[last:], node[last:], size[last:], sketch[last:]))
        if held:
            yield split(held)

    parts = members.repartition("c").sortWithinPartitions("c").mapInArrow(run, _PAIRS)
    return parts.unionByName(stars.join(large, "c").select("c", "x")).distinct()


_COMPARED = T.StructType(
    [
        T.StructField("c", T.LongType()),
        T.StructField("x", T.LongType()),
        T.StructField("n_c", T.LongType()),
        T.StructField("n_x", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("linked", T.BooleanType()),
        T.StructField("more", T.ArrayType(T.LongType(), False)),
        T.StructField("less", T.ArrayType(T.LongType(), False)),
    ]
)


RARITY_BITS = 20


def _slot(values: np.ndarray) -> np.ndarray:
    return (mix(values + _U(0x99)) >> _U(64 - RARITY_BITS)).astype(np.int64)


def rarity(texts: DataFrame, like: Similarity) -> np.ndarray:
    """How often features occur in these texts, by hashed slot: a table of fixed size."""

    def make_kernel():
        def kernel(batch):
            out = []
            for piece in pieces(batch.column(0)):
                slot, n = np.unique(_slot(features(piece, like.n)[0]), return_counts=True)
                out.append((0, slot, n))
            return out

        return kernel

    rows = collected(counted(texts.select("text"), T.IntegerType(), make_kernel))
    table = np.zeros(1 << RARITY_BITS, np.uint32)
    table[rows["key"].to_numpy()] = np.minimum(rows["n"].to_numpy(), (1 << 32) - 1)
    return table


def compare(pairs: DataFrame, texts: DataFrame, like: Similarity, rare) -> DataFrame:
    """Full comparison of pairs (c, x) by the texts (node, text) of their nodes.

    Returns sizes, h (size of the symmetric difference), linked, and the first
    features that x has more and less than c, as many as the prefix filter can
    need: the rarest by the broadcast table ``rare``, then by hash.
    """
    schema = to_arrow_schema(_COMPARED)
    left = texts.select(F.col("node").alias("c"), F.col("text").alias("text_c"))
    right = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    joined = pairs.join(right, "x").join(left, "c").select("c", "x", "text_c", "text_x")

    def sets(column):
        out = []
        for piece in pieces(column):
            values, rows = features(piece, like.n)
            bounds = np.searchsorted(rows, np.arange(piece.rows + 1))
            out += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = [[] for _ in range(6)]
                first, second = sets(batch.column(2)), sets(batch.column(3))
                for a, b in zip(first, second, strict=True):
                    lost = np.isin(b, a, assume_unique=True)
                    more = b[~lost]
                    less = a[~np.isin(a, b, assume_unique=True)]
                    h = len(more) + len(less)
                    both = (len(a) + len(b) - h) // 2
                    linked = like.den * both >= like.num * (both + h)
                    limit = like.most_apart(len(b) + like.partners(len(b)))
                    rarest = [
                        part[np.lexsort((part, rare.value[_slot(part)]))[: limit + 2]].view(np.int64)
                        for part in (more, less)
                    ]
                    for column, value in zip(
                        rows, (len(a), len(b), h, linked, *rarest), strict=True
                    ):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        *(pa.array(col, schema.field(i + 2).type) for i, col in enumerate(rows)),
                    ],
                    schema=schema,
                )

    return joined.mapInArrow(run, _COMPARED)


def _leftover(compared: DataFrame, labels: DataFrame, like: Similarity) -> tuple:
    """What stars leave open: certain links, and pairs that need a comparison.

    Only stars whose outer nodes lie in two components or more matter.
    """
    d, s = like.den - like.num, like.den + like.num
    # n_c = n_x - more + less and h = more + less give the sizes of both parts.
    found = compared.join(labels, compared["x"] == labels["node"], "left").select(
        "c",
        "x",
        "n_x",
        "h",
        F.expr("(h + n_x - n_c) div 2").alias("m"),
        F.expr("(h - n_x + n_c) div 2").alias("l"),
        F.coalesce("component", "x").alias("comp"),
        (F.col("h") * s - F.col("n_x") * d).alias("f"),
    )
    groups = (
        found.groupBy("c")
        .agg(
            F.min("comp").alias("a"),
            F.max("comp").alias("b"),
            F.min("h").alias("h_min"),
            F.max(F.col("l") - F.col("m")).alias("shorter"),
            F.min_by("x", F.struct("f", "x")).alias("best"),
            F.min("f").alias("f_min"),
        )
        .where("a <> b")
    )
    open_ = written(found.join(groups.drop("a", "b"), "c"), "open-stars")
    certain = open_.where("f + f_min <= 0 and x <> best").select(
        F.col("x").alias("u"), F.col("best").alias("v")
    )
    # Lacked features are enough only if t <= min(l, l2), for which both must hold.
    limit = f"{d} * (n_x + n_x * {like.den} div {like.num}) div {s}"
    lacking = F.expr(f"h <= shorter + {limit} and h_min <= l - m + {limit}").alias("lacking")
    none = F.array().cast("array<bigint>")
    differ = compared.select("c", "x", "more", "less").join(
        open_.where("h > 0").select("c", "x", "comp", lacking), ["c", "x"]
    )
    differ = differ.withColumn("less", F.when(F.col("lacking"), F.col("less")).otherwise(none))
    rows = differ.select(
        "c", "x", "comp", F.lit(True).alias("is_more"), F.posexplode("more").alias("i", "e")
    ).unionByName(
        differ.select(
            "c", "x", "comp", F.lit(False).alias("is_more"), F.posexplode("less").alias("i", "e")
        )
    )
    # Only features that two components of a star share matter, which few do.
    rows = rows.withColumn("k", F.xxhash64("c", "e"))
    mixed = rows.groupBy("k").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    mixed = written(mixed.where("a <> b").select("k"), "mixed-features")
    rows = maybe_among(rows, mixed, "k").join(mixed, "k").drop("k")
    sizes = open_.select("c", "x", "n_x", "h", "m", "l")
    rows = written(rows.join(sizes, ["c", "x"]), "open-features")
    own = ["x", "n_x", "h", "m", "l", "comp", "is_more", "i"]
    other = rows.select("c", "e", *(F.col(k).alias(f"{k}2") for k in own))
    apart = f"({d} * (n_x + n_x2) div {s})"
    # The least number of shared features: of all, of those c lacks, of those it has.
    t = f"((h + h2 - {apart} + 1) div 2)"
    tm, tl = f"({t} - least(l, l2))", f"({t} - least(m, m2))"
    in_prefix = f"""
        CASE WHEN {tm} > 0 THEN is_more AND i <= m - {tm} AND i2 <= m2 - {tm}
             WHEN {tl} > 0 THEN NOT is_more AND i <= l - {tl} AND i2 <= l2 - {tl}
             WHEN is_more THEN i <= h - {t} AND i2 <= h2 - {t}
             ELSE m + i <= h - {t} AND m2 + i2 <= h2 - {t} END"""
    pairs = (
        rows.join(other, ["c", "e"])
        .where("x < x2 and comp <> comp2")
        .where(f"abs(h - h2) <= {apart} and h + h2 > {apart}")
        .where(
            f"{like.den} * n_x >= {like.num} * n_x2 and {like.den} * n_x2 >= {like.num} * n_x"
        )
        .where(in_prefix)
        .select(F.col("x").alias("c"), F.col("x2").alias("x"))
        .distinct()
    )
    return certain, pairs


def link(docs: DataFrame, like: Similarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, is_first) of every document.

    ``mark`` is a hash of id and text; component_id the smallest id of the
    documents reachable by links; is_first is true for the rows of the one
    (id, text) that stands for its component.
    """
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("mark"),
    )
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
    ]

    def make_kernel():
        def kernel(piece: Piece):
            values, rows = features(piece, like.n)
            size, node = node_of(values, rows, piece.rows)
            return [size, pa.array(node, mask=size == 0), sketches(values, rows, size)]

        return kernel

    profile = written(with_text_results(own, "text", fields, make_kernel), "set-profile")
    whole = written(candidate_stars(own, like), "whole-stars")
    ends = whole.select(F.col("c").alias("node")).unionByName(whole.select(F.col("x").alias("node")))
    signed = profile.where("node is not null")
    sets = signed.join(ends.distinct(), "node").groupBy("node").agg(
        F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")
    )
    stars = written(split_stars(whole, sets, like), "stars", texts=True)
    needed = stars.select(F.col("c").alias("node")).unionByName(
        stars.select(F.col("x").alias("node"))
    ).distinct()
    one = signed.groupBy("node").agg(F.min("mark").alias("mark"))
    marks = written(one.join(needed, "node"), "star-marks")
    # Texts of other nodes, most of them, stay where they are.
    texts = written(
        maybe_among(own.select("mark", "text"), marks, "mark")
        .join(marks.hint("shuffle_hash"), "mark")
        .groupBy("node")
        .agg(F.first("text").alias("text")),
        "star-texts",
    )
    rare = docs.sparkSession.sparkContext.broadcast(rarity(texts, like))
    compared = written(compare(stars, texts, like, rare), "compared")
    links = compared.where("linked").select(F.col("c").alias("u"), F.col("x").alias("v"))
    labels = components(links)
    certain, pairs = _leftover(compared, labels, like)
    pairs = written(pairs, "open-pairs")
    more = compare(pairs, texts, like, rare).where("linked")
    extra = written(
        certain.unionByName(more.select(F.col("c").alias("u"), F.col("x").alias("v"))).distinct(),
        "more-links",
    )
    if not extra.isEmpty():
        labels = components(
            labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(extra)
        )
    nodes = (
        profile.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("head"))
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    nodes = written(nodes, "node-components")
    ends = nodes.groupBy("component").agg(
        F.min("least").alias("component_id"),
        F.min_by("head", F.struct(F.col("least").isNull(), "head")).alias("head"),
    )
    named = nodes.select("node", "component").join(ends, "component").drop("component")
    return (
        profile.join(named, "node", "left")
        .select(
            "doc_id",
            "mark",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
            (F.col("node").isNull() | (F.col("mark") == F.col("head.mark"))).alias("is_first"),
        )
    )
