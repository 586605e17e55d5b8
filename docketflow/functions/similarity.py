"""Best-window similarity of two strings, 0 to 100.

The score is the best ``200 * LCS / (len(window) + len(short))`` of the shorter
string against every window of the longer one that has at most its length,
windows cut by either end included.  It has no built-in counterpart, so it is
an Arrow-batched UDF; callers decide the common case (one string contains the
other: 100) in the JVM first and send only the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketflow.functions.text import let

_ONE = np.uint64(1)
#: Up to so many letters of the shorter string all windows are compared, about so many bytes of lanes at a time.
_LANES_UP_TO, _LANE_BYTES = 128, 1 << 14


def _window_lcs(short: np.ndarray, padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LCS of ``short`` with each window: 64 pattern rows per machine word."""
    m = len(short)
    n_words = (m + 63) // 64
    symbols, slot = np.unique(short, return_inverse=True)
    index = np.searchsorted(symbols, padded)
    index[index == len(symbols)] = 0
    known = symbols[index] == padded
    state, tables = [], []
    for w in range(n_words):
        bits = np.zeros(len(symbols), dtype=np.uint64)
        for row in range(64 * w, min(m, 64 * w + 64)):
            bits[slot[row]] |= _ONE << np.uint64(row - 64 * w)
        tables.append(np.where(known, bits[index], np.uint64(0)))
        state.append(np.full(len(starts), np.uint64(0xFFFFFFFFFFFFFFFF)))
    for k in range(m):
        carry = None
        for w in range(n_words):
            hits = tables[w][starts + k]
            v = state[w]
            shared = v & hits
            total = v + shared
            over = total < v
            if carry is not None:
                total = total + carry
                over = over | ((total == 0) & (carry == 1))
            state[w] = total | (v - shared)
            carry = over.astype(np.uint64) if n_words > 1 else None
    found = np.zeros(len(starts), dtype=np.int64)
    for w in range(n_words):
        width = min(64, m - 64 * w)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) if width == 64 else (_ONE << np.uint64(width)) - _ONE
        found += np.bitwise_count(~state[w] & mask)
    return found


def _single_lcs(short: str, window: str) -> int:
    """LCS of two strings with one Python integer as the bit row."""
    masks: dict[str, int] = {}
    for row, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << row
    full = (1 << len(short)) - 1
    state = full
    for ch in window:
        shared = state & masks.get(ch, 0)
        state = ((state + shared) | (state - shared)) & full
    return len(short) - state.bit_count()


def _lanes(short: str, long: str, cutoff: float, decide: bool) -> float:
    """The best score over all windows, many at a time: each is a lane of one Python integer, with a bit spare for the carry."""
    m, n = len(short), len(long)
    size, n_windows = m // 8 + 1, n + m - 1
    masks: dict[str, int] = {}
    for row, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << row
    none, rows = bytes(size), {ch: mask.to_bytes(size, "little") for ch, mask in masks.items()}
    blank = none * (m - 1)
    padded = blank + b"".join([rows.get(ch, none) for ch in long]) + blank
    lane, step, best = ((1 << m) - 1).to_bytes(size, "little"), max(m, _LANE_BYTES // size), 0.0
    for start in range(0, n_windows, step):
        count = min(step, n_windows - start)
        hits = int.from_bytes(padded[start * size:(start + count + m - 1) * size], "little")
        state = full = int.from_bytes(lane * count, "little")
        for _ in range(m):
            shared = state & hits
            state = ((state + shared) | (state - shared)) & full
            hits >>= 8 * size
        unmatched = np.bitwise_count(np.frombuffer(state.to_bytes(count * size, "little"), dtype=np.uint8).reshape(count, size)).sum(axis=1, dtype=np.int64)
        at = np.arange(start, start + count)
        width = np.minimum(np.minimum(at + 1, m), np.minimum(n_windows - at, n))
        best = max(best, float(np.max(200.0 * (m - unmatched) / (width + m))))
        if decide and best >= cutoff:
            break
    return best


def _one_way(short: str, long: str, cutoff: float, decide: bool) -> float:
    m, n = len(short), len(long)
    if m <= _LANES_UP_TO:
        return _lanes(short, long, cutoff, decide)
    s = np.frombuffer(short.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    padded = np.full(n + 2 * (m - 1), -1, dtype=np.int64)
    padded[m - 1:m - 1 + n] = np.frombuffer(long.encode("utf-32-le"), dtype=np.uint32)
    n_windows = n + m - 1
    at = np.arange(n_windows)
    width = np.minimum(np.minimum(at + 1, m), np.minimum(n_windows - at, n))
    # A window cannot beat its shared letter count.  Windows are taken in the
    # order of that bound until none left can beat the best score so far.
    bound = np.zeros(n_windows, dtype=np.int64)
    for symbol, count in zip(*np.unique(s, return_counts=True)):
        seen = np.concatenate(([0], np.cumsum(padded == symbol)))
        bound += np.minimum(seen[m:m + n_windows] - seen[:n_windows], count)
    limit = 200.0 * bound / (width + m)
    order = np.argsort(-limit, kind="stable")
    best, at, step = 0.0, 0, 256
    while at < n_windows and limit[order[at]] > best and limit[order[at]] >= cutoff:
        if decide and best >= cutoff:
            break
        if at < 2:  # the likeliest windows one by one
            first = int(order[at]) - (m - 1)
            window = long[max(first, 0):first + m]
            best, at = max(best, 200.0 * _single_lcs(short, window) / (len(window) + m)), at + 1
            continue
        chosen = order[at:at + step]
        lcs = _window_lcs(s, padded, chosen)
        best = max(best, float(np.max(200.0 * lcs / (width[chosen] + m))))
        at, step = at + step, step * 2
    return best


def best_window_score(a: str, b: str, cutoff: float = 0.0, decide: bool = False) -> float:
    """Score of two strings; a score below ``cutoff`` may be reported as 0.

    With ``decide`` any score at or above ``cutoff`` may be reported for one that
    is: the search stops at the first window that reaches it.
    """
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    score = _one_way(short, long, cutoff, decide)
    if len(short) == len(long):
        score = max(score, _one_way(long, short, cutoff, decide))
    return score if score >= cutoff else 0.0


def score_jobs(jobs: list[tuple[Column, Column, float]], decide: bool = False) -> Column:
    """For each job (needles, haystacks, cutoff) the best score of each needle over the haystacks, in one call.

    array<array<double>>, an entry for each job; null where its needles or haystacks are null.
    """
    cutoffs = [cutoff for _, _, cutoff in jobs]

    @F.pandas_udf("array<array<double>>")
    def scored(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            out.append([
                None if xs is None or ys is None
                else [max((best_window_score(x, y, cutoff, decide) for y in ys), default=0.0) for x in xs]
                for xs, ys, cutoff in zip(row[0::2], row[1::2], cutoffs)])
        return pd.Series(out, dtype=object)

    # Declared non-deterministic only to keep the optimizer from copying the call
    # into filters and lambdas; its result depends on its arguments alone.
    return scored.asNondeterministic()(*[c for needles, haystacks, _ in jobs for c in (needles, haystacks)])


def best_scores(needles: Column, haystacks: Column, cutoff: float, decide: bool = False) -> Column:
    """For each needle the best score over the haystacks (array<double>); null in, null out."""
    return score_jobs([(needles, haystacks, cutoff)], decide)[0]


def first_reaching(needles: Column, haystacks: Column, cutoff: float) -> Column:
    """For each needle the place (from 0) of the first haystack whose score reaches ``cutoff``; -1 for none."""

    @F.pandas_udf("array<int>")
    def placed(many: pd.Series, against: pd.Series) -> pd.Series:
        out = []
        for xs, ys in zip(many, against):
            out.append(None if xs is None or ys is None else [
                next((i for i, y in enumerate(ys) if y and best_window_score(x, y, cutoff, True) >= cutoff), -1) for x in xs])
        return pd.Series(out, dtype=object)

    return placed.asNondeterministic()(needles, haystacks)


def contained(a: Column, b: Column) -> Column:
    """Whether one of two strings that are not empty contains the other: a score of 100."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def unsettled(needles: Column, haystacks: Column) -> Column:
    """Needles that neither contain nor are contained in any haystack.

    All others score 100 by definition, so only these need the UDF.
    """
    return F.array_distinct(F.filter(needles, lambda x: (x != "") & ~F.exists(haystacks, lambda h: contained(h, x))))


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """False where the pairs of neighbouring letters rule a score of ``cutoff`` out.

    A score c of the shorter string, of m letters, against a window needs a common
    subsequence of L >= c (m + w) / 200 letters in a window of w.  Leaving m - L letters of the
    string out breaks two of its m - 1 pairs each, and the w - L letters put in one each, so
    3 L - m - w - 1 pairs stand in the window.  From c = 200 / 3 on that is least for w = L:
    m (3 c - 200) / (200 - c) - 1.  Below, pairs rule nothing out.
    """
    if 3 * cutoff <= 200:
        return F.lit(True)
    pair = F.when(F.length(a) <= F.length(b), F.struct(a.alias("short"), b.alias("long"))).otherwise(F.struct(b.alias("short"), a.alias("long")))

    def reaches(p: Column) -> Column:
        size = F.length(p["short"])
        kept = F.size(F.filter(
            F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.contains(p["long"], F.substr(p["short"], i, F.lit(2)))))
        return kept >= size * ((3 * cutoff - 200) / (200 - cutoff)) - 1 - 1e-9

    return let(pair, reaches)


def hopeful(rest: Column, haystacks: Column, cutoff: float) -> Column:
    """Those of the unsettled needles that may reach ``cutoff``: only their texts go to Python."""
    if 3 * cutoff <= 200:
        return rest
    return F.filter(rest, lambda x: F.exists(haystacks, lambda h: may_reach(x, h, cutoff)))


def score_maps(jobs: list[tuple[Column, Column, float]]) -> Column:
    """The scores (array<array<double>>) of jobs of hopeful needles, haystacks and cutoff; null for nothing to score.

    Scores tell on which side of its cutoff a needle is.  Rows with nothing left send nulls.
    """
    return score_jobs([
        (F.when(F.size(open_) > 0, open_), F.when(F.size(open_) > 0, haystacks), cutoff) for open_, haystacks, cutoff in jobs], decide=True)


def score_of(needle: Column, rest: Column, open_: Column, scores: Column) -> Column:
    """Score of a needle: settled ones are 100, those ruled out 0, others as in ``scores``, which follow ``open_``."""
    scored = F.element_at(scores, F.array_position(open_, needle).cast("int"))
    return F.when(F.array_contains(open_, needle), scored).when(F.array_contains(rest, needle), 0.0).otherwise(100.0)
