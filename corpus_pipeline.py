"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import bpe, linespread, mixing, partenum, toxicity
from tablemill.llm.common import like_before, split_by, table, without, written
from tablemill.llm.queries import DOMAIN_SHARES, source_domain, word_tokenizer

NEAR = partenum.Similarity(n=5, num=80, den=100)
# The mix takes nine tenths of the tokens it is given, no document twice.
MIX_SHARE = 0.9
MIX_SEED = 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    body = f"c{names.index('text')}"
    boxed = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("mark", F.xxhash64(body))
    # Equal texts have equal scores, so the marks of toxic ones are enough.
    scored = toxicity.score(boxed.select("mark", F.col(body).alias("text")), model)
    toxic = written(scored.where("score >= 0.5").select("mark").distinct(), "toxic-marks")
    return without(boxed, toxic, "mark").drop("mark").toDF(*names)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go from all documents but the first; so do documents left without text."""
    cleaned = linespread.clean(docs)
    body = f"c{docs.columns.index('text')}"
    left = like_before(cleaned, docs, f"new1 = 0 or {body} rlike '[^ \\\\t-\\\\r]'")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id."""
    odd = written(
        partenum.link(docs, NEAR)
        .groupBy(F.col("doc_id").alias("odd_id"), "mark")
        .agg(F.count("*").alias("n"), F.max("is_first").alias("stays"))
        .where("n > 1 or not stays"),
        "copy-marks",
    )
    names = docs.columns
    boxed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, body = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    # Rows that stay and are there once, most of them, are not shuffled.
    clear, maybe = split_by(boxed.withColumn("mark", F.xxhash64(own, body)), odd, "mark")
    gone = odd.where("not stays").select("odd_id", F.col("mark").alias("odd_mark"))
    kept = maybe.join(
        gone,
        (F.col("mark") == F.col("odd_mark")) & F.col(own).eqNullSafe(F.col("odd_id")),
        "left_anti",
    )
    # Rows that repeat both id and text stay once.
    kept = kept.dropDuplicates(["mark", own])
    return clear.unionByName(kept).drop("mark").toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix of domains, languages and sources."""
    mixed = mixing.mix(
        docs,
        source_domain(),
        F.col("lang"),
        F.col("source"),
        DOMAIN_SHARES,
        share=MIX_SHARE,
        max_epochs=1,
        seed=MIX_SEED,
    )
    return like_before(mixed, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.round_trip(docs.select("doc_id", "text"), word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

# Toxicity scores and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
