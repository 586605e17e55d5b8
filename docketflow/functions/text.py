"""Text functions as Column expressions.  All of them stay in the JVM.

White space follows the Unicode definition plus the four information
separators; line breaks are the Unicode ones plus those separators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketflow import fixed_values as V

_BLANK = r"[\s\x1c-\x1f]"
#: The characters of ``_BLANK``.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
_LINE_BREAK = r"\R|[\x1c-\x1e]"
#: Listed one by one, the characters are looked up in one table; ranges are compared one after another.
_NOT_KEPT = f"[^{ascii_lowercase}{digits}%$]+"
#: The phrase with the word before tried from its first letter alone and never given back: the
#: first match starts there or at the noun, whatever letters of the word come first.
_HARDWARE_ONCE = V.HARDWARE_PHRASE.replace(r"([\w-]+\s+)?", r"((?<![\w-])[\w-]++\s++)?")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row so that lambdas inside ``body`` do not recompute it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware search."""
    return text.rlike("(?iUd)" + pattern)


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){_BLANK}+", " "))


def split_lines(text: Column) -> Column:
    """Lines of ``text``; a final line break does not open another line."""
    parts = F.split(F.coalesce(text, F.lit("")), _LINE_BREAK, -1)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def content_lines(text: Column) -> Column:
    """Lines without their bullets; empty ones are dropped."""
    trimmed = F.transform(split_lines(text), lambda x: F.btrim(x, F.lit(V.BULLET_CHARS)))
    return F.filter(trimmed, lambda x: x != "")


def clean_text(text: Column) -> Column:
    lines = F.transform(split_lines(text), lambda x: strip(F.regexp_replace(x, "[ \\t\\u00A0]+", " ")))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"\A\n+|\n+\z", "")


def normalize(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(lowered, _NOT_KEPT, " "))


def split_sentences(text: Column) -> Column:
    pieces = F.transform(
        content_lines(text),
        lambda line: F.transform(
            F.split(line, rf"(?U)(?<=[.!?]){_BLANK}+(?=[A-Z0-9])"), strip
        ),
    )
    return F.filter(F.flatten(pieces), lambda x: x != "")


def truncate(text: Column, limit: int = 160) -> Column:
    return let(
        collapse_blanks(F.coalesce(text, F.lit(""))),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))
        ),
    )


def words(text: Column) -> Column:
    parts = F.split(collapse_blanks(F.coalesce(text, F.lit(""))), " ")
    return F.filter(parts, lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def looks_like_instruction(text: Column) -> Column:
    return let(
        collapse_blanks(F.coalesce(text, F.lit(""))),
        lambda flat: any_match(flat, V.INSTRUCTION_PATTERNS),
    )


def strip_trailing_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+\z", "")


def short_claim(text: Column) -> Column:
    bare = F.regexp_replace(strip_trailing_dots(strip(text)), "(?iUd)" + V.GOAL_PREFIX_PATTERN, "")
    return truncate(bare, 70)


def lower_first(text: Column) -> Column:
    """Lower the first letter of an ordinary word; acronyms and names keep it."""
    first = F.split(text, " ")[0]
    rest = F.substr(first, F.lit(2))
    ordinary = (
        (F.length(first) > 1)
        & (rest == F.lower(rest))
        & rest.rlike(r"\p{L}")
        & ~F.contains(F.substring(first, 1, 3), F.lit("-"))
    )
    return F.when(
        first.isin("A", "An", "The") | ordinary,
        F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2))),
    ).otherwise(text)


def join_labels(labels: Column) -> Column:
    """"A, B and C" over the distinct labels, in order."""
    return let(
        F.array_distinct(labels),
        lambda d: F.when(F.size(d) <= 1, F.array_join(d, "")).otherwise(
            F.concat(
                F.array_join(F.slice(d, F.lit(1), F.size(d) - 1), ", "), F.lit(" and "), F.element_at(d, -1)
            )
        ),
    )


def page_label(page: Column) -> Column:
    return F.concat(F.lit("Slide "), page.cast("string"))


def unit_key(page: Column) -> Column:
    """slide_01 … slide_99, slide_100: sorted as a string wherever it is sorted."""
    return F.format_string("slide_%02d", page.cast("int"))


def dependency_phrase(key: str, sentence: Column) -> Column:
    if key == "hardware":
        found = F.lower(strip(F.regexp_extract(sentence, "(?iUd)" + _HARDWARE_ONCE, 0)))
        return let(found, lambda f: F.when(f != "", f).otherwise(F.lit(V.HARDWARE_FALLBACK)))
    quoted = truncate(strip_trailing_dots(sentence), V.DEPENDENCY_QUOTE_LIMIT)
    return F.concat(F.lit("“"), quoted, F.lit("”"))


def url_host(link: Column) -> Column:
    """The authority part (user and port included), else the link itself."""
    authority = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.when(authority != "", authority).otherwise(link)


def is_video_host(host: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(host, F.lit(v)) for v in V.VIDEO_HOSTS])


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a fixed wording with columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{%s}" % k), k) for k in values if "{%s}" % k in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, key = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[key].cast("string"))
        rest = rest[at + len(key) + 2:]
    return F.concat(*parts)


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Small fixed dictionary as a CASE chain (no join)."""
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(default) if default is not None else chain
