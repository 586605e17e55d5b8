"""Personal data found by labelers whose votes are weighed without labels.

Base spans follow fixed rules (email, ip, card, phone) and always stay.  A wider net gives
candidates: what a base rule found but its check refused, phone numbers without a country
code, spelled-out addresses, named secrets.  Four labelers vote on every span, base spans
included: the strict rule, a gazetteer, the words before it, and its shape.  Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors are the soft labels on which a logistic span classifier over the span's own
features is trained.  Candidates it accepts are added where no base span lies.

Votes and features are small codes, so what reaches the driver is a table of counts whose
size is bounded by the codes, not by the data.  Every pattern scans a text in linear time.

Null and empty texts have no span.  Spans may touch but added ones never overlap others;
ties in place go by the order of kinds.  Repeated rows are found alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.common import key_text
from docketflow.session import cut

KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4

# The base rules and the lists of the gazetteer and context labelers.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RULE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
SPELLED_EMAIL = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{2,63})+", re.I)
SECRET_NAME = re.compile(r"(?<![A-Za-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+=-]{8,})", re.I)
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"}
ISSUER_DIGITS = "3456"
CONTEXT = {
    EMAIL: ("mail", "contact", "write", "correo", "courriel", "@"), IP: ("ip", "host", "server", "address", "adresse"),
    CARD: ("card", "visa", "credit", "karte", "carte", "tarjeta", "pan"), PHONE: ("phone", "tel", "call", "fax", "mobile", "anruf"),
    SECRET: ("token", "secret", "password", "passwd", "pwd", "key"),
}
CONTEXT_WIDTH = 24

LABELERS, ABSTAIN, YES, NO = 4, 0, 1, 2
FEATURES = 8  # each a code below 16
EM_ROUNDS, FIT_ROUNDS, FIT_RATE, FIT_DECAY = 60, 400, 0.5, 1e-3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@``: a match's local part holds none."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        size = len(before) - len(before.rstrip(LOCAL_PART))
        floor = at + 1
        if size and (m := DOMAIN.match(text, at + 1)):
            yield at - size, m.end()
            floor = m.end()
        at = text.find("@", floor)


def octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def digits_of(match: str) -> str:
    return "".join(filter(str.isdigit, match))


def base_and_refused(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans (start, kind, end) and the matches that a check refused though their length fits."""
    base, refused = [], []
    if "@" in text:
        base += [(a, EMAIL, b) for a, b in emails(text)]
    for m in CARD_RULE.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19:
            (base if luhn(digits) else refused).append((m.start(), CARD, m.end()))
    if "." in text:
        for m in IP_RULE.finditer(text):
            (base if octets(m[0]) else refused).append((m.start(), IP, m.end()))
    if "+" in text:
        for m in PHONE_RULE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                base.append((m.start(), PHONE, m.end()))
    return sorted(base), refused


def candidates(text: str, has_digit: bool) -> list[tuple[int, int, int]]:
    """Spans of the wider net, as (start, kind, end)."""
    found = []
    if has_digit:
        found += [(m.start(), PHONE, m.end()) for m in LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), SECRET, m.end(1)) for m in SECRET_NAME.finditer(text)]
    lowered = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in lowered or "[at]" in lowered:
        found += [(m.start(), EMAIL, m.end()) for m in SPELLED_EMAIL.finditer(text)]
    return found


def votes_and_features(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, int]:
    """The four votes and the features of a span, each packed into one number."""
    span = text[start:end]
    digits = digits_of(span)
    before = text[max(0, start - CONTEXT_WIDTH) : start].lower()
    near = any(word in before for word in CONTEXT[kind])
    rule = YES if strict else (ABSTAIN if kind in (PHONE, SECRET) or (kind == EMAIL) else NO)
    if kind == EMAIL:
        listed = YES if re.split(r"[.)\]\s]+", span.rstrip())[-1].lower() in TOP_DOMAINS else NO
        shaped = YES if 6 <= len(span) <= 64 else NO
    elif kind == IP:
        listed = ABSTAIN
        shaped = YES if all(len(p) <= 3 for p in span.split(".")) else NO
    elif kind == CARD:
        listed = YES if digits[0] in ISSUER_DIGITS else NO
        shaped = YES if len(digits) in (15, 16) else NO
    elif kind == PHONE:
        listed = ABSTAIN if not strict else YES
        shaped = YES if 10 <= len(digits) <= 13 else NO
    else:
        listed = YES if len(span) in (32, 40, 64) else ABSTAIN
        shaped = YES if digits and len(digits) < len(span) else NO
    votes = 0
    for vote in (rule, listed, YES if near else ABSTAIN, shaped):
        votes = votes * 3 + vote
    left, right = text[start - 1 : start], text[end : end + 1]
    sort = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    marks = sum(c in " -.()" for c in span)
    codes = (
        kind, min(15, len(digits)), min(15, len(span) // 4), min(4, marks), sort(left), sort(right), int(near),
        int(strict) + 2 * int(bool(digits) and digits[0] in ISSUER_DIGITS),
    )
    features = 0
    for code in codes:
        features = features * 16 + code
    return votes, features


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Base spans, and for all spans kind, start, end, votes, features and whether it is a base span, one after another."""
    has_digit = re.search("[0-9]", text) is not None
    base, refused = base_and_refused(text) if has_digit or "@" in text else ([], [])
    wide = refused + candidates(text, has_digit)
    taken, flat = sorted((a, b) for a, _, b in base), []
    for a, kind, b in base:
        flat += [kind, a, b, *votes_and_features(text, a, kind, b, True), 1]
    if wide:
        starts = np.array([a for a, _ in taken], dtype=np.int64)
        furthest = np.maximum.accumulate(np.array([0] + [b for _, b in taken], dtype=np.int64))
        for a, kind, b in sorted(wide):
            # of the base spans that start before its end, none reaches beyond its start
            if furthest[np.searchsorted(starts, b)] <= a:
                flat += [kind, a, b, *votes_and_features(text, a, kind, b, False), 0]
    return base, flat


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def reliabilities(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    ``votes`` is patterns x labelers.  Returns each labeler's chance of each vote given the
    truth (truth x labelers x votes) and each pattern's chance of being personal data.
    """
    yes, no = (votes == YES).sum(axis=1), (votes == NO).sum(axis=1)
    truth = (yes + 0.5) / (yes + no + 1)
    chance = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        weight = np.stack([(1 - truth) * counts, truth * counts])
        for labeler in range(LABELERS):
            for vote in range(3):
                chance[:, labeler, vote] = 0.5 + weight[:, votes[:, labeler] == vote].sum(axis=1)
        chance /= chance.sum(axis=2, keepdims=True)
        logs = np.log(chance)
        prior = np.zeros(len(kinds))
        for kind in np.unique(kinds):
            mine = kinds == kind
            share = (weight[1, mine].sum() + 1) / (weight[:, mine].sum() + 2)
            prior[mine] = np.log(share / (1 - share))
        odds = prior + sum(logs[1, i, votes[:, i]] - logs[0, i, votes[:, i]] for i in range(LABELERS))
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return chance, truth


def _indicators(features: np.ndarray) -> np.ndarray:
    """One column for each value of each feature, alone and crossed with the kind."""
    codes = np.stack([(features >> (4 * (FEATURES - 1 - i))) & 15 for i in range(FEATURES)], axis=1).astype(int)
    x = np.zeros((len(features), FEATURES * 16 + FEATURES * 16 * len(KINDS)))
    for i in range(FEATURES):
        x[np.arange(len(x)), i * 16 + codes[:, i]] = 1
        x[np.arange(len(x)), FEATURES * 16 + (codes[:, 0] * FEATURES + i) * 16 + codes[:, i]] = 1
    return x


def span_classifier(features: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Logistic regression on soft labels; gives the score of every feature code seen."""
    x = _indicators(features)
    w = np.zeros(x.shape[1])
    share = counts / counts.sum()
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= FIT_RATE * (x.T @ (share * (p - truth)) + FIT_DECAY * w)
    scores = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(features.tolist(), scores.tolist()))


_SCANNED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("base", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())),
])
WIDTH = 6


def scan_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, base spans as text and the packed spans of each row, written once."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t or "") for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "base": [joined(b) for b, _ in found], "spans": [s for _, s in found]})

    return cut(docs.select(key_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(scanned, _SCANNED), "pii")


def learn(scanned: DataFrame) -> dict[int, float]:
    """Scores by feature code from the counts of (votes, features) over all spans of all rows."""
    place = F.explode(F.when(F.size("spans") > 0, F.sequence(F.lit(0), F.size("spans") - WIDTH, F.lit(WIDTH))))
    one = scanned.select("spans", place.alias("at")).select(
        F.col("spans")[F.col("at") + 3].alias("votes"), F.col("spans")[F.col("at") + 4].alias("features"))
    rows = one.groupBy("votes", "features").count().orderBy("votes", "features").collect()
    if not rows:
        return {}
    packed, features, counts = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    votes = np.stack([(packed // 3 ** (LABELERS - 1 - i)) % 3 for i in range(LABELERS)], axis=1)
    kinds = features >> (4 * (FEATURES - 1))
    _, truth = reliabilities(votes, kinds, counts.astype(float))
    codes, at = np.unique(features, return_inverse=True)
    total = np.bincount(at, weights=counts)
    return span_classifier(codes, np.bincount(at, weights=counts * truth) / total, total)


def accepted(flat: np.ndarray | list[int], scores: dict[int, float], threshold: float) -> list[tuple[int, int, int]]:
    """Base spans and accepted candidates; of overlapping candidates the first stays."""
    spans, end = [], -1
    for i in range(0, len(flat), WIDTH):
        kind, a, b, _, features, is_base = (int(v) for v in flat[i : i + WIDTH])
        if is_base:
            spans.append((a, kind, b))
        elif a >= end and scores.get(features, 0.0) >= threshold:
            spans.append((a, kind, b))
            end = b
    return sorted(spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, digest of base spans, all spans as text."""
    scanned = scan_texts(docs, key, text)
    scores = learn(scanned)
    schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE_KINDS]],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [[s.split(":", 1)[0] for s in b.split(",")] if b else [] for b in batch["base"]]
            yield pd.DataFrame({
                key: batch["key"], **{f"n_{k}": [found.count(k) for found in kinds] for k in KINDS[:BASE_KINDS]},
                "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in batch["base"]],
                "spans": [joined(accepted(s, scores, threshold)) for s in batch["spans"]],
            })

    return scanned.mapInPandas(final, schema).withColumn(key, F.col(key).cast("long"))


def masked(text: str | None, scores: dict[int, float], threshold: float) -> str | None:
    """``text`` with each span replaced by its kind in brackets.

    Without one span its neighbour may fit a rule that the two together did not, so the
    text is read again until nothing is found; brackets fit no rule, so that ends.
    """
    while text and (spans := accepted(scan(text)[1], scores, threshold)):
        parts, at = [], 0
        for a, kind, b in spans:
            if b > at:
                parts += [text[at : max(a, at)], f"[{KINDS[kind].upper()}]"]
                at = b
        text = "".join([*parts, text[at:]])
    return text


def mask(text: Column, scores: dict[int, float], threshold: float = 0.5) -> Column:
    """``text`` without personal data; null stays null."""

    @F.pandas_udf(T.StringType())
    def masks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([masked(t, scores, threshold) for t in batch], dtype=object)

    return masks(text)


def mask_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data masked and ``length`` (if there) restated; every row stays."""
    scores = learn(scan_texts(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text"))
    hidden = docs.withColumn(text, mask(F.col(text), scores, threshold))
    return hidden.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else hidden
