"""Topics, claims, overview and the per-submission state.

``unit_findings`` is the only stage that reads texts.  It runs every pattern in
the unit's own row and leaves a narrow table (short excerpts and flags), so the
later joins and groupings never move a slide's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.columns import fixed_column
from docketflow.functions.text import (
    any_match,
    dependency_phrase,
    let,
    lower_first,
    matches,
    strip,
    strip_trailing_dots,
    truncate,
    word_count,
)
from docketflow.operators.grounding import REF_TYPE, locate, reference
from docketflow.operators.skew import first_per_group, running_total
from docketflow.operators.view import with_sentences

_TOPIC_HIT = "struct<topic:int,score:int,excerpt:string>"


def is_footer(sentence: Column, team: Column) -> Column:
    return (word_count(sentence) < 3) | F.startswith(F.lower(strip(sentence)), F.lower(team))


def _matching(sentences: str, pattern: str) -> Column:
    return F.filter(sentences, lambda s: matches(s, pattern))


def _strong_hit(index: int, title_pattern: str, body_pattern: str) -> Column:
    def cell(hits: Column) -> Column:
        score = F.when(matches(F.col("title"), title_pattern), 3).otherwise(0) + F.least(F.size(hits), F.lit(2))
        joined = F.nullif(F.array_join("sentences", "; "), F.lit(""))
        excerpt = F.coalesce(F.get(hits, F.lit(0)), F.get("_body", F.lit(0)), joined, F.col("title"))
        return F.when((score >= 3) | (F.size(hits) >= 2), F.struct(
            F.lit(index).alias("topic"), score.cast("int").alias("score"), truncate(excerpt, 200).alias("excerpt")))

    return let(_matching("_body", body_pattern), cell)


def _weak_hit(index: int, body_pattern: str) -> Column:
    def cell(first: Column) -> Column:
        return F.when(
            first.isNotNull() & ~is_footer(first, F.col("team_name")),
            F.struct(F.lit(index).alias("topic"), F.lit(1).alias("score"), truncate(first, 200).alias("excerpt")),
        )

    return let(F.get(_matching("_content", body_pattern), F.lit(0)), cell)


@fixed_column
def _topic_hits() -> Column:
    """Strong hits of all topics, and for two topics a weak one, in topic order."""
    cells = []
    for index, (key, _, title_pattern, body_pattern) in enumerate(V.TOPICS):
        cell = _strong_hit(index, title_pattern, body_pattern)
        if key in V.WEAK_TOPICS:
            cell = F.coalesce(cell, _weak_hit(index, body_pattern))
        cells.append(cell.cast(_TOPIC_HIT))
    return F.filter(F.array(*cells), lambda t: t.isNotNull())


def claim_category(sentence: Column) -> Column:
    chain = F.when(matches(sentence, V.NOVELTY_PATTERN), "novelty")
    for name, pattern in V.CATEGORY_PATTERNS:
        chain = chain.when(matches(sentence, pattern), name)
    return chain.otherwise("quantitative")


def is_claim(sentence: Column) -> Column:
    """A novelty or quantity statement that is neither a plan nor plain pricing."""
    novelty = matches(sentence, V.NOVELTY_PATTERN)
    quantity = any_match(sentence, V.QUANTITY_PATTERNS)
    return (
        (quantity | novelty)
        & ~matches(sentence, V.PLAN_PATTERN)
        & (~matches(sentence, V.PRICING_PATTERN) | novelty)
    )


@fixed_column
def _claims() -> Column:
    def row(s: Column) -> Column:
        category = claim_category(s)
        own = matches(s, V.SUPPORT_PATTERN)
        return F.struct(
            truncate(s, 200).alias("text"), category.alias("category"),
            (own | (F.col("_notes_support") & (category != "novelty"))).alias("supported"),
        )

    return F.transform(F.filter("sentences", is_claim), row)


@fixed_column
def _mentions(index: int, key: str, pattern: str) -> Column:
    return F.transform(
        F.slice(_matching("sentences", pattern), F.lit(1), F.lit(2)),
        lambda s: F.struct(
            F.lit(index).alias("dependency"), dependency_phrase(key, s).alias("what"),
            truncate(s, 200).alias("excerpt")),
    )


def unit_findings(views: DataFrame) -> DataFrame:
    """Everything the rules need to know of a unit, as short values.

    topic_hits array<struct<topic,score,ref>>, claims array<struct<text,category,
    supported,ref>>, mentions array<struct<dependency,what,ref>> (two per
    dependency), appendix ref, explained / approaches array<boolean>,
    target_user, tagline, title, withheld, appendix_title, and head / tail: the
    ends of the unit's text, for phrases that go on in the next unit.
    """
    staged = (
        with_sentences(views)
        .withColumn("_content", F.concat("sentences", "image_sentences"))
        .withColumn("_body", F.filter("_content", lambda s: ~is_footer(s, F.col("team_name"))))
        .withColumn("_notes_support", matches(F.col("notes"), V.SUPPORT_PATTERN))
        .withColumn("_topics", _topic_hits())
        .withColumn("_claims", _claims())
    )
    mentions = F.concat(*[_mentions(i, d[0], d[2]) for i, d in enumerate(V.DEPENDENCIES)])
    appendix = F.get(_matching("sentences", V.APPENDIX_PATTERN), F.lit(0))
    target = F.get(
        F.filter("sentences", lambda s: matches(s, V.TARGET_USER_PATTERN) & ~matches(s, V.NOVELTY_PATTERN)), F.lit(0)
    )
    tagline = F.get(
        F.filter("sentences", lambda s: (word_count(s) >= 4) & ~F.startswith(F.lower(s), F.lit("team"))), F.lit(0)
    )
    staged = (
        staged.withColumn("_mentions", mentions)
        .withColumn("_appendix", F.when(appendix.isNotNull(), truncate(appendix, 200)))
        .withColumn("explained", F.array(*[matches(F.col("all_text"), d[3]) for d in V.DEPENDENCIES]))
        .withColumn("approaches", F.array(*[matches(F.col("all_text"), p) for p, _ in V.COMMON_APPROACHES]))
        .withColumn("target_user", F.when(target.isNotNull(), truncate(target, 200)))
        .withColumn("tagline", strip_trailing_dots(tagline))
        .withColumn("appendix_title", matches(F.col("title"), V.APPENDIX_TITLE_PATTERN))
        .withColumn("_excerpts", F.concat(
            F.transform("_topics", lambda t: t["excerpt"]),
            F.transform("_claims", lambda c: c["text"]),
            F.transform("_mentions", lambda m: m["excerpt"]),
            F.array_compact(F.array("_appendix")),
        ))
    )
    located = locate(staged, "_excerpts", "_via")

    def ref(excerpt: Column) -> Column:
        return reference(excerpt, F.col("_via")).alias("ref")

    return located.select(
        "submission_id", "page_number", "slide_id", "team_name", "submission_title", "title", "withheld",
        "explained", "approaches", "target_user", "tagline", "appendix_title",
        F.substring("all_text", 1, V.BORDER_CHARS).alias("head"), F.substring("all_text", -V.BORDER_CHARS, V.BORDER_CHARS).alias("tail"),
        F.transform("_topics", lambda t: F.struct(t["topic"].alias("topic"), t["score"].alias("score"),
                                                  ref(t["excerpt"]))).alias("topic_hits"),
        F.transform("_claims", lambda c: F.struct(c["text"].alias("text"), c["category"].alias("category"),
                                                  c["supported"].alias("supported"), ref(c["text"]))).alias("claims"),
        F.transform("_mentions", lambda m: F.struct(m["dependency"].alias("dependency"), m["what"].alias("what"),
                                                    ref(m["excerpt"]))).alias("mentions"),
        F.when(F.col("_appendix").isNotNull(), ref(F.col("_appendix"))).alias("appendix"),
    )


def submission_facts(findings: DataFrame) -> DataFrame:
    """One row per submission: counts and first-of-its-kind values, all map-side combinable."""
    seen = ~F.col("withheld")
    page = F.col("page_number")

    def first(value: Column, cond: Column) -> Column:
        return F.min_by(value, F.when(cond, page))

    target = F.col("target_user")
    inner = seen & (page != 1)
    return findings.groupBy("submission_id").agg(
        F.count("*").alias("n_units"),
        F.count_if(seen).alias("n_visible"),
        F.max("team_name").alias("team_name"),
        F.max("submission_title").alias("submission_title"),
        F.bool_or("appendix_title").alias("has_appendix"),
        first(F.struct("title", "tagline"), seen).alias("first_view"),
        first(target, inner & target.isNotNull()).alias("target_inner"),
        first(target, seen & (page == 1) & target.isNotNull()).alias("target_cover"),
        first(F.col("appendix"), seen & F.col("appendix").isNotNull()).alias("appendix"),
        F.array(*[
            F.coalesce(F.bool_or(F.when(seen, F.get("explained", F.lit(i)))), F.lit(False))
            for i in range(len(V.DEPENDENCIES))
        ]).alias("explained"),
        F.array(*[
            F.coalesce(F.bool_or(F.when(seen, F.get("approaches", F.lit(i)))), F.lit(False))
            for i in range(len(V.COMMON_APPROACHES))
        ]).alias("approaches"),
    )


def border_approaches(findings: DataFrame) -> DataFrame:
    """submission_id, over_borders array<boolean>: common approaches named across the end of a visible unit.

    Units are numbered among the visible ones and meet their follower by that
    number, so no task sees a whole submission.  The patterns have two words at
    most, which the kept ends hold.
    """
    seen = findings.filter(~F.col("withheld")).select("submission_id", "page_number", "head", "tail")
    placed = running_total(seen, ["submission_id"], "page_number", {"place": F.lit(1)})
    after = placed.select("submission_id", (F.col("place") - 1).alias("place"), F.col("head").alias("next_head"))
    joint = F.concat("tail", F.lit(" "), "next_head")
    return placed.join(after, ["submission_id", "place"]).groupBy("submission_id").agg(
        F.array(*[F.bool_or(matches(joint, p)) for p, _ in V.COMMON_APPROACHES]).alias("over_borders"))


def with_border_approaches(facts: DataFrame, borders: DataFrame) -> DataFrame:
    both = F.zip_with("approaches", "over_borders", lambda a, b: a | b)
    return facts.join(borders, "submission_id", "left").withColumn(
        "approaches", F.when(F.col("over_borders").isNull(), F.col("approaches")).otherwise(both)).drop("over_borders")


def analysed(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Visible units without the cover, unless the cover is all there is.

    Only units on page 1 depend on the rest of the submission, so only they are
    joined with the counts.
    """
    visible = findings.filter(~F.col("withheld"))
    inner = visible.filter("page_number <> 1")
    single = facts.filter("n_visible = 1").select("submission_id")
    cover = visible.filter("page_number = 1").join(single, "submission_id", "left_semi")
    return inner.unionByName(cover)


def topics(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """submission_id, topic, label, evidence (at most 3 refs, by slide key).

    Weak hits (score 1) count only when a topic has no strong hit: then one of
    them is ranked first.
    """
    hits = analysed(findings, facts).select("submission_id", "page_number", F.inline("topic_hits"))
    best = first_per_group(
        hits, ["submission_id", "topic"], [F.desc("score"), F.col("page_number")], V.MAX_REFS_PER_TOPIC
    ).filter("score > 1 or rn = 1")
    keys = F.array(*[F.lit(t[0]) for t in V.TOPICS])
    labels = F.array(*[F.lit(t[1]) for t in V.TOPICS])
    return (
        best.filter("ref.excerpt <> ''")
        .groupBy("submission_id", F.col("topic").alias("topic_index"))
        .agg(F.sort_array(F.collect_list("ref")).alias("evidence"))
        .select(
            "submission_id", "topic_index", F.get(keys, F.col("topic_index")).alias("topic"),
            F.get(labels, F.col("topic_index")).alias("label"), "evidence",
        )
    )


def claims(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """submission_id, claim_no, id, unsupported_no, text, category, supported, page_number, ord, ref.

    Numbers run over the submission in page order.  They come from per-unit
    counts, so no submission is sorted in one task.  ``unsupported_no`` numbers
    the unsupported claims alone (null for supported ones).
    """
    units = analysed(findings, facts).filter(F.size("claims") > 0).select("submission_id", "page_number", "claims")
    unsupported = F.size(F.filter("claims", lambda c: ~c["supported"]))
    placed = running_total(
        units, ["submission_id"], "page_number", {"before": F.size("claims"), "open_before": unsupported}
    )
    rows = placed.select(
        "submission_id", "page_number", "before", "open_before", "claims", F.posexplode("claims").alias("ord", "c")
    )
    number = F.col("before") + F.col("ord") + 1
    earlier_open = F.size(F.filter(F.slice("claims", F.lit(1), F.col("ord")), lambda c: ~c["supported"]))
    return rows.select(
        "submission_id", number.alias("claim_no"), F.concat(F.lit("c"), number.cast("string")).alias("id"),
        F.when(~F.col("c.supported"), F.col("open_before") + earlier_open + 1).alias("unsupported_no"),
        "c.text", "c.category", "c.supported", "page_number", "ord", "c.ref",
    )


def mentions(findings: DataFrame) -> DataFrame:
    """submission_id, hits map<dependency, array<struct<what,ref>>>: the first two per dependency."""
    rows = findings.filter(~F.col("withheld")).select(
        "submission_id", "page_number", F.posexplode("mentions").alias("ord", "m")
    )
    first = first_per_group(
        rows.select("submission_id", "page_number", "ord", "m.*"),
        ["submission_id", "dependency"], [F.col("page_number"), F.col("ord")], 2,
    )
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("rn", "what", "ref"))),
        lambda x: F.struct(x["what"].alias("what"), x["ref"].alias("ref")),
    )
    per_key = first.groupBy("submission_id", "dependency").agg(listed.alias("hits"))
    return per_key.groupBy("submission_id").agg(
        F.map_from_entries(F.collect_list(F.struct("dependency", "hits"))).alias("mentions")
    )


def overview_text(team: Column, title: Column, first_view: Column, solution: Column) -> Column:
    """One or two neutral sentences; ``solution`` is the first excerpt of that topic."""
    tagline = first_view["tagline"]
    product = strip(F.coalesce(F.nullif(first_view["title"], F.lit("")), title))
    head = F.when(
        F.coalesce(tagline, F.lit("")) != "",
        F.concat(team, F.lit(" proposes "), product, F.lit(": "), lower_first(tagline), F.lit(".")),
    ).otherwise(F.concat(team, F.lit(" proposes "), product, F.lit(".")))
    tail = F.when(solution.isNotNull(), F.concat(strip_trailing_dots(solution), F.lit(".")))
    return F.concat_ws(" ", head, tail)


def submission_state(
    findings: DataFrame, submissions: DataFrame, facts: DataFrame, topic_rows: DataFrame, claim_rows: DataFrame
) -> DataFrame:
    """One row per submission with everything the later rules look up.

    All values are of fixed size: twelve topics with three refs each, six claim
    categories with counts, three dependencies with two hits each.
    """
    by_topic = topic_rows.groupBy("submission_id").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "evidence"))).alias("topics")
    )
    per_category = claim_rows.groupBy("submission_id", "category").agg(
        F.count_if(~F.col("supported")).alias("n_open"), F.count_if(F.col("supported")).alias("n_supported")
    )
    counts = per_category.groupBy("submission_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "n_open"))).alias("open_claims"),
        F.sum("n_open").alias("n_open"),
        F.sum("n_supported").alias("n_supported"),
    )
    no_topics = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast(f"array<array<{REF_TYPE}>>")
    )
    no_counts = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    solution = F.get(F.element_at("topics", F.lit("solution")), F.lit(0))["excerpt"]
    one_view = F.col("n_visible") == 1
    return (
        submissions.select("submission_id", "round_id")
        .join(facts, "submission_id")
        .join(by_topic, "submission_id", "left")
        .join(counts, "submission_id", "left")
        .join(mentions(findings), "submission_id", "left")
        .withColumn("topics", F.coalesce("topics", no_topics))
        .withColumn("open_claims", F.coalesce("open_claims", no_counts))
        .withColumn("n_open", F.coalesce("n_open", F.lit(0)))
        .withColumn("n_supported", F.coalesce("n_supported", F.lit(0)))
        .withColumn("target_users", F.coalesce("target_inner", F.when(one_view, F.col("target_cover"))))
        .withColumn("overview", overview_text(
            F.col("team_name"), F.col("submission_title"), F.col("first_view"), solution))
        .drop("target_inner", "target_cover", "first_view")
    )

