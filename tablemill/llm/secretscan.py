"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
stretches of the expression that stand for a few literal strings give an OR of
ANDs of trigrams, and all stretches must hold. The index lists, for each
trigram that a query uses, the documents that have it (lower-cased); postings
are intersected by counting, per document and alternative, how many of its
trigrams were found. Only documents that satisfy a rule's query are searched
with its expression. Rules without a mandatory trigram scan every document.

Offsets are code points, ends exclusive. Null counts as the empty text; rows
are told apart by id and a hash of the text, so null and repeated ids are fine.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three kinds that every scan has. For access and hex, a match
# that is too short cannot hide a longer one, so the length is in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}"),
)
RULES = BASE + MORE

# A stretch of a pattern may stand for this many strings; beyond, it is cut.
MOST_STRINGS = 64
LONGEST = 24


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _literals(tree) -> list[set[str] | None]:
    """A pattern as a row of string sets, with None where anything may stand."""
    out: list[set[str] | None] = []
    for op, value in tree:
        if op is rc.LITERAL:
            out.append({chr(value).lower()})
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in value):
            out.append({chr(v).lower() for _, v in value})
        elif op is rc.SUBPATTERN:
            out += _literals(value[3])
        elif op is rc.BRANCH:
            choices: set[str] | None = set()
            for branch in value[1]:
                whole = _joined(_literals(branch))
                choices = None if whole is None or choices is None else choices | whole
            out.append(choices)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, body = value
            one = _joined(_literals(body))
            if one is not None and high <= 2:
                times = [{""}]
                for _ in range(int(high)):
                    times.append(_joined([times[-1], one]) or set())
                out.append(set().union(*times[low:]))
            elif low:
                out += _literals(body)
                out.append(None)
            else:
                out.append(None)
        elif op is rc.AT:
            continue
        else:
            out.append(None)
    return out


def _joined(row: list[set[str] | None]) -> set[str] | None:
    strings = {""}
    for part in row:
        if part is None or len(strings) * len(part) > MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in part}
    return strings


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets that every match's (lower-cased) text satisfies."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        sets = {trigrams(s) for s in strings}
        if all(sets):
            # A set that holds another one says nothing more.
            clauses.append(
                sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)
            )

    strings = {""}
    for part in _literals(rp.parse(pattern)):
        longer = (
            {a + b for a in strings for b in part}
            if part is not None and len(strings) * len(part) <= MOST_STRINGS
            else None
        )
        if longer is None or max(map(len, longer)) > LONGEST:
            close(strings)
            small = part is not None and len(part) <= MOST_STRINGS
            strings = part if small and longer is not None else {""}
        else:
            strings = longer
    close(strings)
    return clauses


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("mark"),
    )


def build_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, mark) of ``wanted`` trigrams over (doc_id, text, mark) rows."""
    found = F.filter(
        F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("small"), t)
    )
    return docs.withColumn("small", F.lower("text")).select(
        F.explode(found).alias("trigram"), "doc_id", "mark"
    )


def query_terms(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(rule, clauses, clause, alternative, needed, trigram): all queries, a row per trigram."""
    rows = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(query):
            for a, needed in enumerate(clause):
                rows += [(r, len(query), c, a, len(needed), t) for t in sorted(needed)]
    schema = "rule int, clauses int, clause int, alternative int, needed int, trigram string"
    return spark.createDataFrame(rows, schema) if rows else None


def candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, mark, rules): the rules whose query a document satisfies."""
    hits = (
        # As many rows as the rules have trigrams.
        index.join(F.broadcast(terms), "trigram")
        # Rows that repeat id and text count more than once, hence "or more" below.
        .groupBy("doc_id", "mark", "rule", "clauses", "clause", "alternative", "needed")
        .agg(F.count("*").alias("n"))
    )
    return (
        hits.where("n >= needed")
        .select("doc_id", "mark", "rule", "clauses", "clause")
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("rule", "clauses", "clause")).alias("met"))
        .select(
            "doc_id",
            "mark",
            F.expr(
                "filter(array_distinct(met.rule), r -> "
                "size(filter(met, m -> m.rule = r)) = filter(met, m -> m.rule = r)[0].clauses)"
            ).alias("rules"),
        )
    )


BLOCK = 256


def running(numbers: Column) -> Column:
    """Running sums of an array, in blocks so that long arrays take near-linear time."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def push(acc, x):
        return F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), zero) + x))

    n = F.size(numbers)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(BLOCK))).otherwise(
        F.array().cast("array<int>")
    )
    inner = F.transform(
        starts, lambda s: F.aggregate(F.slice(numbers, s, F.lit(BLOCK)), none, push)
    )
    carry = F.aggregate(
        inner,
        F.array(zero),
        lambda acc, block: F.concat(
            acc, F.array(F.get(acc, F.size(acc) - 1) + F.get(block, F.size(block) - 1))
        ),
    )
    return F.flatten(
        F.transform(
            F.arrays_zip(inner.alias("block"), F.slice(carry, F.lit(1), F.size(inner)).alias("before")),
            lambda z: F.transform(z["block"], lambda x: x + z["before"]),
        )
    )


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches in order.

    The text between the matches and the matches themselves, laid out in turn,
    give the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.slice(between, F.lit(1), F.size(whole)),
        whole,
        lambda gap, match: (F.length(gap) + F.length(match)).cast("bigint"),
    )
    value = whole if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(
        running(lengths).alias("end"), whole.alias("match"), value.alias("value")
    )
    kept = rows
    if rule.least > 1:
        kept = F.filter(rows, lambda z: F.length(z["value"]) >= rule.least)
    return F.transform(
        kept,
        lambda z: F.struct(
            (z["end"] - F.length(z["match"])).alias("start"),
            F.lit(rank).alias("rank"),
            z["end"].alias("end"),
            F.lit(rule.kind).alias("kind"),
        ),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = MORE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rules = BASE + tuple(rules)
    own = _identified(docs, doc_id, text)
    terms = query_terms(docs.sparkSession, rules)
    wanted = sorted({t for rule in rules for c in trigram_query(rule.pattern) for a in c for t in a})
    index = written(build_index(own, wanted), "trigram-index")
    found = (
        candidates(index, terms)
        .where(F.size("rules") > 0)
        .toDF("f_id", "f_mark", "rules")
    )
    joined = own.join(
        found.hint("shuffle_hash"),
        (F.col("mark") == F.col("f_mark")) & F.col("doc_id").eqNullSafe(F.col("f_id")),
        "left",
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    columns = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            look = F.coalesce(F.array_contains("rules", rank), F.lit(False))
        else:
            look = F.col("text").rlike(rule.pattern)
        columns.append(
            F.when(look, matches(F.col("text"), rule, rank)).otherwise(none).alias(f"s{rank}")
        )
    spans = joined.select("doc_id", *columns)
    base = [F.col(f"s{k}") for k in range(len(BASE))]
    every = [F.col(f"s{k}") for k in range(len(rules))]
    return spans.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{r.kind}") for c, r in zip(base, BASE, strict=True)),
        F.sha2(_listed(reduce(F.concat, base)), 256).alias("base_sha256"),
        _listed(reduce(F.concat, every)).alias("spans"),
    )
