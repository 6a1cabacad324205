"""Boilerplate lines by the number of distinct sites they occur on.

Every line with a word (blanks at both ends removed) is hashed; HyperLogLog
sketches of its sites are built per task and merged by an aggregation on the
hash, so a line on every page costs one small sketch per task. The threshold is
``min_sites``, or ``short_sites`` for lines of fewer than ``min_words`` words,
which people write alike by chance. Lines whose estimate is clearly on one side
of their threshold are decided by it; lines near it get an exact count of
distinct sites. A line on that many sites or more is removed from all documents
but the first that has it (smallest id, then first place), so the corpus keeps
one copy.

Rows: null text stays null, an empty text stays empty, a null site counts as a
site of its own, repeated rows are cleaned alike. Lines without a word are never
removed, so a very long text keeps its layout. Empty tables give empty ones.
Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

MIN_SITES = 5
# Lines of fewer words than this must be on SHORT_SITES sites.
MIN_WORDS = 3
SHORT_SITES = 10
SKETCH_BITS = 12
# Standard errors of the sketch within which a line counts as near the threshold.
NEAR_ERRORS = 5.0
BLANKS = "\t\x0b\x0c\r "


def _site(site: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), site.cast("string")), F.lit("n"))


def site_lines(docs: DataFrame, doc_id: str, text: str, site: str, need: Column) -> DataFrame:
    """(id, mark, site, pos, line, need): a row per line with a word.

    mark tells rows of one id apart; need is the line's threshold, of its text ``line``.
    """
    exploded = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"),
        F.xxhash64(text).alias("mark"),
        _site(F.col(site)).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    return exploded.where(F.col("line").rlike(WORD)).select(
        *("id", "mark", "site", "pos"),
        F.xxhash64(F.btrim("line", F.lit(BLANKS))).alias("line"),
        need.alias("need"),
    )


def sites_needed(line: str, min_sites: int, min_words: int, short_sites: int) -> Column:
    """The threshold of a line by its number of words."""
    gap = r"[\x09\x0B-\x0D\x20]+"
    long_enough = F.col(line).rlike(gap.join([WORD] * min_words))
    return F.when(long_enough, min_sites).otherwise(short_sites)


def widespread(lines: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(line, first_id, first_mark, first_pos) of the lines on as many sites as they need."""
    band = F.greatest(F.lit(1.0), F.lit(NEAR_ERRORS * 1.04 / 2 ** (bits / 2)) * F.col("need"))
    first = F.min(F.struct("id", "mark", "pos"))
    sketches = (
        lines.groupBy("line")
        .agg(
            F.hll_sketch_agg("site", F.lit(bits)).alias("sketch"),
            first.alias("first"),
            F.max("need").alias("need"),
        )
        .withColumn("n", F.hll_sketch_estimate("sketch"))
        .where(F.col("n") >= F.col("need") - band)
        .select("line", "first", "n", "need")
    )
    found = written(sketches, "line-spread")
    near = found.where(F.col("n") < F.col("need") + band)
    exact = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("*").alias("sites"))
    )
    sure = found.where(F.col("n") >= F.col("need") + band).select("line", "first")
    counted = near.join(exact, "line").where("sites >= need")
    decided = sure.unionByName(counted.select("line", "first"))
    return decided.select("line", *(f"first.{c}" for c in ("id", "mark", "pos"))).toDF(
        "line", "first_id", "first_mark", "first_pos"
    )


def clean(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    short_sites: int = SHORT_SITES,
) -> DataFrame:
    """``docs`` with widespread lines cut from the text, and columns n_lines, n_removed at the end."""
    names = docs.columns
    at = names.index(text)
    boxed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, body, origin = (f"c{names.index(name)}" for name in (doc_id, text, site))
    need = sites_needed("line", min_sites, max(min_words, 1), max(short_sites, min_sites))
    lines = site_lines(boxed, own, body, origin, need)
    boilerplate = written(widespread(lines), "boilerplate")
    first = (
        F.col("id").eqNullSafe(F.col("first_id"))
        & (F.col("mark") == F.col("first_mark"))
        & (F.col("pos") == F.col("first_pos"))
    )
    removed = (
        lines.join(boilerplate, "line")
        .where(~first)
        .groupBy("id", "mark")
        .agg(F.collect_set("pos").alias("removed"))
    )
    split = F.split(body, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "removed")
    cut = F.array_join(F.transform(left, lambda i: F.get("all", i)), "\n")
    joined = (
        boxed.withColumn("mark", F.xxhash64(body))
        .join(
            removed.withColumnRenamed("mark", "mark2"),
            F.col(own).eqNullSafe(F.col("id")) & (F.col("mark") == F.col("mark2")),
            "left",
        )
        .withColumn("all", F.when(F.col("removed").isNotNull(), split))
    )
    columns = [
        F.when(F.col("removed").isNull(), F.col(body)).otherwise(cut) if i == at else F.col(f"c{i}")
        for i in range(len(names))
    ]
    n_lines = F.when(F.col(body).isNull(), 0).otherwise(F.size(split))
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    return joined.select(
        *[c.alias(f"c{i}") for i, c in enumerate(columns)],
        n_lines.cast("long").alias("n0"),
        n_removed.cast("long").alias("n1"),
    ).toDF(*names, "n_lines", "n_removed")
