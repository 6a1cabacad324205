"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Four kinds are found by rule (email, ip, card, phone) and always stay. Wider
patterns propose further candidates: addresses with odd signs, digit groups,
IPv6 addresses, account numbers, names after a title. Eight labelers (patterns and checksums,
gazetteers, contexts) vote for or against every candidate or abstain. The votes
of the whole corpus are counted by combination (at most 3^8); expectation-
maximisation on these counts estimates how reliable each labeler is and how
likely each combination means personal data. A logistic classifier over the
span's shape and surroundings is fitted to these likelihoods on a bounded
sample and decides on every candidate.

Offsets are code points, ends exclusive. Null counts as the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_text_results, written
from .text import Piece

# Candidates, at most, that fit the classifier.
SAMPLE_ROWS = 20_000
BASE_KINDS = ("email", "ip", "card", "phone")
SOFT_KINDS = ("handle", "number", "ip6", "account", "name")

# The patterns of the kinds found by rule.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_HANDLE = re.compile(r"[^\s@<>|]{1,64}@[^\s@<>|]{2,255}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./-]?[0-9]){7,18}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b")
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don"
_NAME = re.compile(rf"\b(?:{_TITLES})\.?[ ]([^\W\d_][^\W\d_]+(?:[ ][^\W\d_][^\W\d_]+)?)")
_CUES = re.compile(
    r"\b(?:e-?mail|mail|contact|kontakt|contacto|tel|phone|call|mobile|fax|telefon|teléfono"
    r"|téléphone|card|visa|karte|carte|tarjeta|iban|account|konto|compte|cuenta|ip|host"
    r"|address|adresse|name|nom|nombre)\b",
    re.I,
)
_NOT_CUES = re.compile(
    r"\b(?:isbn|issn|version|order|build|commit|hash|sha|token|serial|page|year|section|id)\b", re.I
)
_PROVIDERS = re.compile(r"@(?:[\w-]+\.)*(?:gmail|yahoo|hotmail|outlook|gmx|web|example)\.", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in s.split(".")))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind found by rule: leftmost, not overlapping within a kind, failing ones dropped."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS}
    if "@" in text:
        found["email"] = [m.span() for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if _ip_ok(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [
                m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15
            ]
    return found


def soft_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Candidates of the wider patterns that touch no span of ``taken`` (sorted)."""
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts

    def free(start: int, end: int) -> bool:
        at = int(np.searchsorted(starts, end, "left"))
        return at == 0 or ends[at - 1] <= start

    patterns = []
    if "@" in text:
        patterns.append(("handle", _HANDLE, 0))
    if _DIGIT.search(text):
        patterns += [("number", _NUMBER, 0), ("account", _ACCOUNT, 0)]
    if ":" in text:
        patterns.append(("ip6", _IP6, 0))
    patterns.append(("name", _NAME, 1))
    for kind, pattern, group in patterns:
        for m in pattern.finditer(text):
            start, end = m.span(group)
            if free(start, end):
                yield kind, start, end


VOTERS = 8
FOR, AGAINST = 1, 2


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, list[float]]:
    """The labelers' votes, as base-3 digits, and the span's features."""
    span = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    digits = _digits(span)
    left, right = before[-1:], after[:1]
    cue, not_cue = bool(_CUES.search(before)), bool(_NOT_CUES.search(before))
    crowd = len(_DIGIT.findall(before)) + len(_DIGIT.findall(after))
    alone = not (left.isalnum() or right.isalnum())
    varied = len(set(digits)) > 2
    vote = [
        FOR if kind in BASE_KINDS else 0,
        0,
        FOR if cue else 0,
        AGAINST if not_cue else 0,
        0,
        FOR if alone else AGAINST,
        AGAINST if crowd > 30 else 0,
        AGAINST if len(digits) >= 8 and not varied else 0,
    ]
    if kind in ("card", "number") and len(digits) >= 13:
        vote[1] = FOR if luhn(digits) else AGAINST
    elif kind == "account":
        number = "".join(str(int(c, 36)) for c in span[4:] + span[:4])
        vote[1] = FOR if int(number) % 97 == 1 else AGAINST
    elif kind == "ip":
        vote[1] = FOR
    elif kind == "number":
        vote[1] = AGAINST if len(digits) < 9 else 0
    if kind in ("email", "handle"):
        vote[4] = FOR if _PROVIDERS.search(span) else (AGAINST if "." not in span else 0)
    elif kind == "name":
        vote[4] = FOR if span.istitle() else AGAINST
    code = 0
    for v in vote:
        code = 3 * code + v
    n = max(len(span), 1)
    features = [
        1.0,
        len(digits) / 16,
        sum(c.isalpha() for c in span) / n,
        sum(not c.isalnum() for c in span) / n,
        min(n, 64) / 32,
        float("@" in span),
        float(alone),
        float(cue),
        float(not_cue),
        min(crowd, 40) / 20,
        float(varied),
        float(vote[1] == FOR),
        float(vote[1] == AGAINST),
        *(float(kind == k) for k in SOFT_KINDS),
    ]
    return code, features


CANDIDATE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("votes", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
    ]
)
_FIELDS = [
    *(T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("candidates", T.ArrayType(CANDIDATE)),
]


def _kernel(piece: Piece):
    raw = piece.data.tobytes()
    bounds = piece.bounds.tolist()
    counts: list[list[int]] = [[] for _ in BASE_KINDS]
    hashes, candidates = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text = raw[a:b].decode("utf-8")
        found = base_spans(text)
        mine = [(kind, s, e) for kind in BASE_KINDS for s, e in found[kind]]
        for kind, column in zip(BASE_KINDS, counts, strict=True):
            column.append(len(found[kind]))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in mine)
        hashes.append(hashlib.sha256(listed.encode()).hexdigest())
        taken = sorted((s, e) for _, s, e in mine)
        rows = []
        for kind, s, e in [*mine, *soft_spans(text, taken)]:
            code, features = votes(text, kind, s, e)
            rows.append({"kind": kind, "start": s, "end": e, "votes": code, "features": features})
        candidates.append(rows)
    return [*counts, hashes, candidates]


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the spans by rule, and all candidates with their votes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_text_results(rows, "text", _FIELDS, lambda: _kernel)


@dataclass
class Reliability:
    """What EM found: the share of personal data and P(vote | truth) of each labeler."""

    prior: float
    table: np.ndarray  # labeler, truth, vote

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        ballots = unpack(codes)
        log = np.log([1 - self.prior, self.prior]) + sum(
            np.log(self.table[j][:, ballots[:, j]]).T for j in range(VOTERS)
        )
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))


def unpack(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (VOTERS - 1 - j) % 3 for j in range(VOTERS)], 1)


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, steps: int = 50) -> Reliability:
    """Estimate labelers from how often each combination of votes occurs; starts at the majority."""
    ballots = unpack(codes)
    lead = (ballots == FOR).sum(1) - (ballots == AGAINST).sum(1)
    truth = 1 / (1 + np.exp(-lead.astype(float)))
    found = Reliability(0.5, np.full((VOTERS, 2, 3), 1 / 3))
    for _ in range(steps):
        weight = np.stack([counts * (1 - truth), counts * truth])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        cells = np.ones((VOTERS, 2, 3))
        for j in range(VOTERS):
            for y in range(2):
                cells[j, y] += np.bincount(ballots[:, j], weight[y], minlength=3)
        found = Reliability(prior, cells / cells.sum(2, keepdims=True))
        new = found.posterior(codes)
        done = np.abs(new - truth).max() < 1e-6 if len(new) else True
        truth = new
        if done:
            break
    return found


def _classifier(features: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps with a small ridge."""
    beta = np.zeros(features.shape[1])
    ridge = 1e-2 * np.eye(len(beta))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        step = np.linalg.solve(
            features.T @ (features * (p * (1 - p))[:, None]) + ridge,
            features.T @ (likely - p) - ridge @ beta,
        )
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit(proposed: DataFrame) -> tuple[Reliability, np.ndarray]:
    """Labelers' reliabilities from all candidates, and the classifier's weights."""
    each = proposed.select(F.explode("candidates").alias("c"))
    combos = each.groupBy("c.votes").agg(F.count("*").alias("n")).toArrow()
    codes, counts = combos["votes"].to_numpy(), combos["n"].to_numpy().astype(float)
    reliability = expectation_maximisation(codes, counts)
    sample = (
        each.select("c.votes", "c.features", F.xxhash64("c").alias("order"))
        .orderBy("order")
        .limit(SAMPLE_ROWS)
        .toArrow()
    )
    n_features = 13 + len(SOFT_KINDS)
    features = np.array(sample["features"].to_pylist(), float).reshape(-1, n_features)
    return reliability, _classifier(features, reliability.posterior(sample["votes"].to_numpy()))


def chosen(proposed: DataFrame, weights: np.ndarray) -> DataFrame:
    """``proposed`` with ``spans``: all spans by rule and the candidates the classifier accepts."""

    def z(c: Column) -> Column:
        parts = [c["features"][i] * float(w) for i, w in enumerate(weights)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    order = [*BASE_KINDS, *SOFT_KINDS]
    listed = F.array_sort(
        F.transform(
            F.filter(
                "candidates", lambda c: c["kind"].isin(list(BASE_KINDS)) | (z(c) >= 0)
            ),
            lambda c: F.struct(
                F.array_position(F.array(*map(F.lit, order)), c["kind"]).alias("rank"),
                c["start"].alias("start"),
                c["end"].alias("end"),
                c["kind"].alias("kind"),
            ),
        )
    )
    spans = F.array_join(
        F.transform(
            listed, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))
        ),
        ",",
    )
    return proposed.withColumn("spans", spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    proposed = written(propose(docs, doc_id, text), "personal-data")
    _, weights = fit(proposed)
    return chosen(proposed, weights).drop("candidates")
