"""The thin queries over the operators of this package, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    brown,
    exactdedup,
    hyperlang,
    linespread,
    lockstep,
    mixing,
    partenum,
    perplexity,
    private,
    secretscan,
    slotmine,
    toxicity,
)
from .common import UPPER, WORD, fold, table, written

# The corpus has no column for the domain of a source; its number stands in for one.
DOMAIN_SHARES = {("d0",): 3, ("d1",): 2, ("d0", "en"): 2}
MIX_SHARE = 0.6
MIX_EPOCHS = 2
MIX_SEED = 20


def source_domain(source: Column | str = "source") -> Column:
    number = F.regexp_extract(F.col(source) if isinstance(source, str) else source, "([0-9])$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (number.cast("int") % 4)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, own = perplexity.fit(docs)
    return perplexity.verdicts(docs, model, own)


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(
        docs,
        source_domain(),
        F.col("lang"),
        F.col("source"),
        DOMAIN_SHARES,
        share=MIX_SHARE,
        max_epochs=MIX_EPOCHS,
        seed=MIX_SEED,
    ).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = partenum.Similarity(n=3, num=90, den=100)
    linked = partenum.link(table(spark, sf_dir, "documents"), like)
    return linked.select("doc_id", "n_shingles", "component_id")


def op6_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    model, counts = brown.fit(docs.where(~held_out))
    return brown.score(docs, model, counts).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op7_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def _vocabulary(file: str) -> str:
    """Where a vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(file)


def word_tokenizer() -> str:
    return _vocabulary("word_bpe_49k.json")


def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, word_tokenizer())


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find(table(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linespread.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op11_slot_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = table(spark, sf_dir, "embeddings").where(finite)
    rows = own.select(F.col("vec_id").alias("id"), shifted.alias("label"), whole.alias("vector"))
    return slotmine.mine(rows, F.col("id") % 50 == 0)


def op12_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = _vocabulary("piece_bpe_32k.model")
    aligned = lockstep.align(docs, _vocabulary("byte_bpe_50k.json"), pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    aligned = written(aligned.select("doc_id", *counts, digest, "pairs", "times"), "aligned")
    return lockstep.score_links(aligned, lockstep.id_count(pieces)).select(
        "doc_id", *counts, "n_best", "count_sum", "groups_sha256"
    )


def op13_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    sums = hyperlang.learn(docs.where(~held_out))
    return hyperlang.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), sums)


def queries() -> dict:
    return {
        query.__name__: query
        for query in (
            op1_toxicity,
            op2_perplexity,
            op3_content_sort,
            op4_mixing,
            op5_partenum_join,
            op6_brown_classes,
            op7_trigram_index,
            op8_backtracking_bpe,
            op9_weak_supervision,
            op10_line_spread,
            op11_slot_mining,
            op12_lockstep,
            op13_hyperdimensional,
        )
    }


_DUPLICATES = f"""
  WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm
    FROM documents)
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
  FROM t WINDOW w AS (PARTITION BY norm)"""

_BLANKS = "chr(9) || chr(11) || chr(12) || chr(13) || ' '"


def _line_spread(documents: str = "documents") -> str:
    words = r"[\x09\x0B-\x0D\x20]+".join([WORD] * linespread.MIN_WORDS)
    return f"""
  WITH split AS (
    SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM {documents}),
  placed AS (
    SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM split),
  lines AS (
    SELECT *, trim(line, {_BLANKS}) AS key,
           CASE WHEN regexp_matches(line, '{words}') THEN {linespread.MIN_SITES}
                ELSE {linespread.SHORT_SITES} END AS need
    FROM placed WHERE regexp_matches(line, '{WORD}')),
  spread AS (
    SELECT key, min((doc_id, pos)) AS first FROM lines
    GROUP BY key HAVING count(DISTINCT source) >= max(need)),
  gone AS (
    SELECT doc_id, list(pos) AS removed FROM lines JOIN spread USING (key)
    WHERE (doc_id, pos) <> first GROUP BY doc_id)
  SELECT d.doc_id, len(parts) AS n_lines, coalesce(len(removed), 0) AS n_removed,
         array_to_string(list_filter(parts, lambda p, i:
           NOT coalesce(list_contains(removed, i), false)), chr(10)) AS text
  FROM split AS d LEFT JOIN gone USING (doc_id)"""


def _level(parent: str, above: str, keys: str, name: str, weight: str) -> str:
    """The children of one level with their budgets; ``keys`` are the parent's columns."""
    by = f"PARTITION BY {keys}" if keys else ""
    path = f"{keys}, {name}" if keys else name
    join = f"JOIN {above} USING ({keys})" if keys else f"CROSS JOIN {above}"
    # By the exact ratio: whole part, then 18 places of the fraction.
    ratio = f"room // weight, (room % weight)::HUGEINT * 1000000000000000000 // weight, {name}"
    return f"""
  {parent}_w AS (
    SELECT * FROM (
      SELECT {path}, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS room,
             CAST(sum(tokens) AS BIGINT) AS tokens, CAST({weight} AS BIGINT) AS weight
      FROM sums GROUP BY {path}) {join}),
  {parent}_o AS (
    SELECT *, room * (sum(weight) OVER a) + coalesce(sum(room) OVER b, 0) * weight
              <= budget::HUGEINT * weight AS is_full
    FROM {parent}_w
    WINDOW a AS ({by} ORDER BY {ratio}
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           b AS ({by} ORDER BY {ratio}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  {parent} AS (
    SELECT {path}, CAST(CASE WHEN is_full THEN room ELSE
             (budget - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER w) * weight
             // greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER w, 1)
           END AS BIGINT) AS budget
    FROM {parent}_o WINDOW w AS ({by}))"""


_MIX = f"""
  WITH t AS (
    SELECT doc_id, lang AS language, source,
           CASE WHEN regexp_extract(source, '([0-9])$', 1) = '' THEN 'other' ELSE 'd' ||
             (CAST(regexp_extract(source, '([0-9])$', 1) AS INT) % 4) END AS domain,
           len(regexp_extract_all(text, '{WORD}')) AS n
    FROM documents),
  sums AS (SELECT domain, language, source, sum(n) AS tokens FROM t GROUP BY ALL),
  top AS (SELECT CAST(floor(sum(tokens)::DECIMAL(28, 0) * {MIX_SHARE}) AS BIGINT) AS budget FROM sums),
  {_level('l1', 'top', '', 'domain', "CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END")},
  {_level('l2', 'l1', 'domain', 'language', "CASE WHEN domain = 'd0' AND language = 'en' THEN 2 ELSE 1 END")},
  {_level('l3', 'l2', 'domain, language', 'source', '1')},
  plan AS (
    SELECT *, budget // greatest(tokens, 1) AS epochs, budget % greatest(tokens, 1) AS rest
    FROM l3 JOIN sums USING (domain, language, source)),
  placed AS (
    SELECT t.*, epochs, rest,
           sum(n) OVER (PARTITION BY domain, language, source
             ORDER BY md5('{MIX_SEED}:' || CAST(epochs AS BIGINT) || ':' || doc_id), doc_id
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM t JOIN plan USING (domain, language, source))
  SELECT doc_id, domain, language AS lang, source, CAST(n AS BIGINT) AS n_tokens, epoch
  FROM (SELECT *, unnest(range(CAST(least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, {MIX_EPOCHS}) AS BIGINT)))
               AS epoch FROM placed)"""


_HARD_NEGATIVES = """
  WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
           CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
    FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
  p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
                                 ORDER BY score DESC, vec_id) AS INT) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
  QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_content_sort": _DUPLICATES,
        "op4_mixing": _MIX,
        "op10_line_spread": _line_spread(),
        "op11_slot_mining": _HARD_NEGATIVES,
    }
