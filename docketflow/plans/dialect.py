"""Small SQL templates that hold for both Spark and DuckDB.

The test tables carry no review entities, so entities are derived from them by
SQL.  One text serves both engines; the few differing spellings are marked
``TS(x)`` (timestamp of epoch micros), ``US[x]`` (epoch micros of a timestamp)
and ``IDIV`` (integer division).
"""

from __future__ import annotations

import re


def to_spark(sql: str) -> str:
    sql = re.sub(r"US\[([^\]]*)\]", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)
    return sql.replace("TS(", "timestamp_micros(").replace(" IDIV ", " div ")


def to_duck(sql: str) -> str:
    sql = re.sub(r"US\[([^\]]*)\]", r"epoch_us(\1)", sql)
    return sql.replace("TS(", "make_timestamp(").replace(" IDIV ", " // ")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(key: str, values: list[str], start: int = 0) -> str:
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values, start))
    return f"CASE {key} {arms} END"


# --- DuckDB spellings used by the stated results ---------------------------

def duck_round(x: str) -> str:
    """One decimal, exact binary value, ties to even."""
    t = f"round_even(({x}) * 20, 0)"
    err = f"((({x}) * 16 - {t}) + ({x}) * 4)"
    near = f"(abs({t}) % 2 = 1 AND abs(({x}) * 20 - {t}) <= abs({t}) * 1e-14)"
    return (
        f"CASE WHEN {near} AND {err} > 0 THEN ({t} + 1) / 20 "
        f"WHEN {near} AND {err} < 0 THEN ({t} - 1) / 20 "
        f"WHEN {near} THEN round_even({t} / 2, 0) / 10 "
        f"ELSE round_even(({x}) * 10, 0) / 10 END"
    )


def duck_mean(x: str, where: str = "TRUE") -> str:
    """Order-independent mean of doubles."""
    whole = f"floor(({x}) * 1048576)"
    rest = f"round_even((({x}) * 1048576 - {whole}) * 68719476736, 0)"
    f = f"FILTER (WHERE {where})"
    return (
        f"(CAST(sum(CAST({whole} AS BIGINT)) {f} AS DOUBLE) / 1048576.0 "
        f"+ CAST(sum(CAST({rest} AS BIGINT)) {f} AS DOUBLE) / 72057594037927936.0) / count({x}) {f}"
    )


def duck_match(text: str, pattern: str) -> str:
    """Search as in Unicode: accented letters count as word characters."""
    return f"regexp_matches({text}, {quote(pattern)}, 'i')"


def duck_ascii(text: str) -> str:
    """Replace Latin letters beyond ASCII by ``x`` so that word boundaries agree."""
    return f"regexp_replace({text}, '[À-ÖØ-öø-ſ]', 'x', 'g')"


def duck_lookup(key: str, table: dict[str, str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {key} {arms}" + (f" ELSE {default}" if default else "") + " END"


def duck_best_window(short: str, long: str) -> str:
    """Best score of a string (120 letters at most) against every window of at most its length of a longer one.

    The longest common subsequence with a window is a row of bits, one for each place of the
    string, folded over the places at which each letter of the window stands in it.
    """
    places = f"list_transform(string_split({long}, ''), lambda c: list_aggregate(list_transform(range(length({short})), lambda i: CASE WHEN substr({short}, i + 1, 1) = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END), 'bit_or'))"
    full = f"((1::HUGEINT << length({short})) - 1)"
    first, last = f"greatest(k - length({short}) + 1, 0)", f"least(k + 1, length({long}))"
    common = f"(length({short}) - bit_count(list_reduce(h[{first} + 1 : {last}], lambda v, c: ((v + (v & c)) | (v - (v & c))) & {full}, {full})))"
    scores = f"list_transform(range(length({long}) + length({short}) - 1), lambda k: 200 * {common} / (length({short}) + {last} - {first}))"
    return f"list_transform([{places}], lambda h: list_max({scores}))[1]"
