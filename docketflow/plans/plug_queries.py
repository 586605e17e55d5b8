"""Registered queries: live views in batch form, plugged-in stages, documents."""

from __future__ import annotations

import json
import re
import uuid
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow import schemas as C
from docketflow.operators import answers as A
from docketflow.operators import brief as B
from docketflow.operators import integrity as I
from docketflow.operators import outside as O
from docketflow.operators import plugins as P
from docketflow.operators import view as VW
from docketflow.operators.not_assessed import not_assessed
from docketflow.plans import deck_sql as Q
from docketflow.plans.analysis import Seen, documents, see
from docketflow.plans.catalog import Catalog
from docketflow.plans.deck_entities import deck_rubric, deck_submissions, deck_units
from docketflow.plans.deck_queries import _LIMIT, _TO_BRIEF, _refs, _rounds, _run
from docketflow.plans.intake_queries import _docs
from docketflow.plans.review_entities import duck_entities, entity
from docketflow.session import cut, ensure_checkpoint_dir
from docketflow.sources import files as FI
from docketflow.sources.files import check_page_limit
from docketflow.sources.sinks import json_documents
from docketflow.streaming import live

CATALOG = Catalog()


def _micros(*names: str):
    return [F.unix_micros(F.col(n)).alias(n) for n in names]


# --- live views over the events at rest --------------------------------------

_TEN, _FIVE = 600_000_000, 300_000_000


@CATALOG.query("str1_activity_counts", duck_entities("audit") + f"""
SELECT epoch_us(created_at) // {_TEN} * {_TEN} AS window_start, epoch_us(created_at) // {_TEN} * {_TEN} + {_TEN} AS window_end, round_id, action, count(*) AS events
FROM audit GROUP BY ALL""")
def activity_counts(spark, folder):
    rows = live.activity_counts(entity(spark, folder, "audit"))
    return rows.select(*_micros("window_start", "window_end"), "round_id", "action", "events")


@CATALOG.query("str1_sliding_counts", duck_entities("audit") + f"""
SELECT w AS window_start, w + {_TEN} AS window_end, round_id, action, count(*) AS events FROM (
  SELECT *, unnest([epoch_us(created_at) // {_FIVE} * {_FIVE}, epoch_us(created_at) // {_FIVE} * {_FIVE} - {_FIVE}]) AS w FROM audit) GROUP BY ALL""")
def sliding_counts(spark, folder):
    rows = live.activity_counts(entity(spark, folder, "audit"), "10 minutes", "5 minutes")
    return rows.select(*_micros("window_start", "window_end"), "round_id", "action", "events")


@CATALOG.query("str2_current_status", duck_entities("audit") + """
, m AS (SELECT entity_id AS assignment_id, CASE action WHEN 'assignment.created' THEN 1 WHEN 'review.opened' THEN 2 WHEN 'evaluation.submitted' THEN 3
    WHEN 'evaluation.kept' THEN 4 WHEN 'evaluation.revised' THEN 4 ELSE 0 END AS k, action, created_at, id FROM audit)
SELECT assignment_id, ['assigned', 'in_progress', 'submitted', 'completed'][max(k)] AS status, arg_max(action, row(created_at, id)) AS last_action,
  epoch_us(max(created_at)) AS updated_at FROM m WHERE k > 0 GROUP BY 1""")
def current_status(spark, folder):
    return live.current_status(entity(spark, folder, "audit")).withColumn("updated_at", F.unix_micros("updated_at"))


@CATALOG.query("str2_submission_status", duck_entities("audit") + """
SELECT submission_id, arg_max(action, row(created_at, id)) AS last_action, epoch_us(max(created_at)) AS updated_at
FROM audit WHERE starts_with(action, 'submission.') AND submission_id IS NOT NULL GROUP BY 1""")
def submission_status(spark, folder):
    return live.submission_status(entity(spark, folder, "audit")).withColumn("updated_at", F.unix_micros("updated_at"))


@CATALOG.query("str3_reviewer_sessions", duck_entities("audit") + """
, e AS (SELECT actor_id, epoch_us(created_at) AS t, lag(epoch_us(created_at)) OVER (PARTITION BY actor_id ORDER BY created_at) AS before FROM audit),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY t) AS n FROM e)
SELECT actor_id, min(t) AS session_start, max(t) + 1800000000 AS session_end, count(*) AS events, (max(t) - min(t)) / 6e7 AS active_minutes FROM s GROUP BY actor_id, n""")
def reviewer_sessions(spark, folder):
    rows = live.reviewer_sessions(entity(spark, folder, "audit"))
    return rows.select("actor_id", *_micros("session_start", "session_end"), "events", "active_minutes")


@CATALOG.query("str3_review_durations", duck_entities("audit") + """
, m AS (SELECT entity_id AS assignment_id, min(epoch_us(created_at)) FILTER (WHERE action = 'review.opened') AS opened_at,
    min(epoch_us(created_at)) FILTER (WHERE action = 'evaluation.submitted') AS submitted_at FROM audit GROUP BY 1)
SELECT *, (submitted_at - opened_at) / 6e7 AS review_minutes FROM m WHERE opened_at IS NOT NULL AND submitted_at IS NOT NULL""")
def review_durations(spark, folder):
    rows = live.review_durations(entity(spark, folder, "audit"))
    return rows.select("assignment_id", *_micros("opened_at", "submitted_at"), "review_minutes")


@CATALOG.query("str4_intake_marks", """WITH d AS (SELECT doc_id AS submission_id, doc_id % 5 AS round_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes,
    source IN ('src0', 'src1', 'src2', 'src3') AS fresh FROM documents)
SELECT submission_id, round_id, size_bytes, sha256, CASE WHEN f <> submission_id THEN f END AS duplicate_of FROM (
  SELECT *, min(submission_id) OVER (PARTITION BY round_id, sha256) AS f FROM d) WHERE fresh""")
def intake_marks(spark, folder):
    """The uploads of four sources arrive after all others."""
    files = _docs(spark, folder).select(
        F.col("doc_id").alias("submission_id"), (F.col("doc_id") % 5).alias("round_id"), "source", F.col("text").cast("binary").alias("content"))
    digests = FI.file_digests(files)
    late = F.col("source").isin("src0", "src1", "src2", "src3")
    return live.mark_arrivals(digests.filter(late).drop("source"), digests.filter(~late).drop("source"))


# --- documents a model gets ---------------------------------------------------

def _esc(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _block(tag: str, x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN chr(10) || '<{tag}>' || chr(10) || {_esc(x)} || chr(10) || '</{tag}>' ELSE '' END"


_DOCUMENT = f"""
lim AS ({_LIMIT}),
sl AS (SELECT v.submission_id, v.page_number, '<slide id="' || v.slide_id || '" page="' || v.page_number || '"' || CASE WHEN v.title <> '' THEN ' title="' || {_esc('v.title')} || '"' ELSE '' END || '>'
    || chr(10) || '<text>' || chr(10) || {_esc('v.text')} || chr(10) || '</text>' || {_block('speaker_notes', 'v.notes')} || {_block('image_text_ocr', 'v.image_text')}
    || CASE WHEN u.link IS NOT NULL THEN chr(10) || '<links_not_followed>' || {_esc('u.link')} || '</links_not_followed>' ELSE '' END || chr(10) || '</slide>' AS slide
  FROM views v JOIN u USING (submission_id, page_number) JOIN lim USING (submission_id)),
sd AS (SELECT submission_id, count(*) AS pages, string_agg(slide, chr(10) ORDER BY page_number) AS slides FROM sl GROUP BY 1),
np AS (SELECT submission_id, string_agg('- ' || {_esc('reason')}, chr(10) ORDER BY part, page_number, ord, reason) AS n FROM items GROUP BY 1),
docs AS (SELECT b.submission_id, '<submission team="' || {_esc('b.team_name')} || '" title="' || {_esc('b.title')} || '" file_type="' || b.file_type || '" pages="' || sd.pages || '">' || chr(10)
    || sd.slides || chr(10) || '</submission>' || CASE WHEN np.n IS NOT NULL THEN chr(10) || '<not_processed>' || chr(10) || np.n || chr(10) || '</not_processed>' ELSE '' END AS document
  FROM subs b JOIN sd USING (submission_id) LEFT JOIN np USING (submission_id))"""


def _documents(spark, folder, seen: Seen | None = None) -> DataFrame:
    """Submission documents of the submissions within their page limit."""
    units, subs = seen.flagged if seen else deck_units(spark, folder), deck_submissions(spark, folder)
    limits = check_page_limit(units, subs.withColumnRenamed("submission_id", "id"), _rounds(spark, folder))
    views = seen.views if seen else VW.build_views(I.flag_units(units))
    accepted = limits.filter("reject_reason is null")
    return P.render_submissions(views, subs, not_assessed(units, subs), accepted)


@CATALOG.query("udf4_submission_documents", Q.deck_sql("SELECT submission_id, md5(document) AS digest, length(document) AS n FROM docs",
                                                       Q.FLAGS, Q.VIEWS, Q.NOT_ASSESSED, _DOCUMENT))
def submission_documents(spark, folder):
    docs = _documents(spark, folder)
    return docs.select("submission_id", F.md5("document").alias("digest"), F.length("document").alias("n"))


@CATALOG.query("udf4_rubric_documents", Q.deck_sql("""SELECT round_id, '{"score_scale":"1-10","criteria":[' || string_agg('{"criterion_id":' || criterion_id || ',"name":"' || name || '","description":"'
  || coalesce(description, '') || '","weight_percent":' || weight || '}', ',' ORDER BY position) || ']}' AS rubric_json, string_agg(CAST(criterion_id AS STRING), ',' ORDER BY position) AS criterion_ids FROM rubric GROUP BY 1"""))
def rubric_documents(spark, folder):
    rows = P.render_rubric(deck_rubric(spark, folder), _rounds(spark, folder))
    return rows.withColumn("criterion_ids", F.array_join(F.col("criterion_ids").cast("array<string>"), ","))


# --- a run with plugged-in stages ---------------------------------------------

def _plain(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def _answer(stage: str, document: str) -> str:
    """A model that quotes the first line of some slides, and invents a slide and a criterion."""
    slides = {int(p): _plain(t.split("\n")[0]) for p, t in re.findall(r'<slide id="slide_\d+" page="(\d+)"[^>]*>\n<text>\n(.*?)\n</text>', document, re.S)}

    def cite(page: int) -> list[dict]:
        own = [{"slide_id": f"slide_{page:02d}", "excerpt": slides[page]}] * 2 if page in slides else []
        return [*own, {"slide_id": "slide_99", "excerpt": "an invented slide"}]

    if stage == "extractor":
        topics = [("solution", "What is built", 1), ("problem", "The need", 2), ("team", "People", 3), ("extra", "Other", 2), ("mystery", "None", 99)]
        return json.dumps({
            "overview": "", "target_users": None, "topics": [{"topic": t, "label": label, "evidence": cite(p)} for t, label, p in topics],
            "claims": [{"id": f"c{p}", "text": slides.get(p, "?"), "category": "other", "evidence": cite(p), "supporting_evidence_found": False} for p in (1, 2, 99)]})
    if stage == "rubric_analyzer":
        return json.dumps({"criteria": [{
            "criterion_id": c, "criterion": f"C{c}", "assessed": c != 3, "finding": f"Finding {c}", "evidence": cite(c), "score": c + 4.5, "not_assessed_reason": None,
            "issues": [{"type": "unclear", "description": f"Issue {c}", "severity": "low"}] * (c % 2)} for c in (1, 2, 3, 4, 5, 9)]})
    if stage == "verifier":
        rows = [("v1", "unsupported_claim", 1), ("v2", "feasibility_gap", 99), ("v3", "potential_similarity", 99), ("v4", "missing_information", 2)]
        return json.dumps({"items": [
            {"id": i, "title": f"Check {i}", "description": "d", "type": kind, "severity": "medium", "evidence": cite(p), "label": None, "related_criteria": None} for i, kind, p in rows]})
    strengths = [{"id": f"s{n}", "text": f"Strength {n}", "evidence": cite(p)} for n, p in ((1, 1), (2, 99), (3, 2))]
    return json.dumps({"overview": f"A deck of {len(slides)} slides", "strengths": strengths, "verify_order": ["v4", "v9", "v1"]})


_STAGES = {"extractor": C.EXTRACTION, "rubric_analyzer": C.RUBRIC_ANALYSIS, "verifier": C.VERIFICATION, "brief_writer": C.BRIEF_WRITER}


def _store(spark) -> A.AnswerStore:
    return A.AnswerStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/answers")


def outside_run(spark, folder, seen: Seen | None = None):
    """(grounded findings, decoded answers by stage, criteria known to each submission).

    Documents and citations come from the same stored views, and answers are decoded once.
    """
    seen = seen or see(deck_units(spark, folder))
    docs = _documents(spark, folder, seen)
    subs = deck_submissions(spark, folder).select("submission_id", "round_id")
    rubric = deck_rubric(spark, folder)
    known = subs.join(rubric.select("round_id", "criterion_id", "weight"), "round_id").select("submission_id", "criterion_id", "weight")
    ids = subs.join(P.render_rubric(rubric, _rounds(spark, folder)).select("round_id", "criterion_ids"), "round_id")
    # a model is asked once for a prompt, by whichever run comes first
    prompts = cut(docs.withColumnRenamed("document", "prompt"), "prompts")
    answers = {}
    for stage, contract in _STAGES.items():
        said = A.ask(prompts, lambda prompt, stage=stage: _answer(stage, prompt), contract, stage, _store(spark))
        answers[stage] = cut(P.decode_answers(said, contract).drop("answer"), "answers")
    checked = P.check_criteria(answers["rubric_analyzer"], ids.select("submission_id", "criterion_ids"))
    found = O.of_answers(answers["extractor"], checked, answers["verifier"], answers["brief_writer"], known)
    return O.ground(found, seen.views), answers, checked


_EXCERPT = Q.cut("split_part(v.text, chr(10), 1)", 240)
_CITE = f"""
lim AS ({_LIMIT}),
cite AS (SELECT x.submission_id, x.page_number, x.slide_id || '|' || x.excerpt || '|' || {Q.VIA} AS ref FROM (SELECT {_EXCERPT} AS excerpt, v.* FROM views v JOIN lim USING (submission_id)) x),
crit AS (SELECT l.submission_id, r.criterion_id, r.weight, c.ref FROM lim l JOIN rubric r ON r.round_id = l.submission_id % 5 LEFT JOIN cite c ON c.submission_id = l.submission_id AND c.page_number = r.criterion_id)"""
_OUT = (Q.FLAGS, Q.VIEWS, _CITE)


@CATALOG.query("udf5_rubric_answers", Q.deck_sql("""SELECT l.submission_id, CAST(NULL AS STRING) AS error, string_agg(r.criterion_id || ':' || (r.criterion_id + 4.5::DOUBLE), ',' ORDER BY r.criterion_id) AS criteria
FROM lim l JOIN rubric r ON r.round_id = l.submission_id % 5 GROUP BY 1""", *_OUT))
def rubric_answers(spark, folder):
    _, _, checked = outside_run(spark, folder)
    listed = F.transform("criteria", lambda c: F.concat(c["criterion_id"].cast("string"), F.lit(":"), c["score"].cast("string")))
    return checked.select("submission_id", "error", F.array_join(listed, ",").alias("criteria"))


@CATALOG.query("udf3_stored_answers", Q.deck_sql("""SELECT stage, count(*) AS submissions, count(*) AS answers, count(DISTINCT document) AS prompts, 0::BIGINT AS asked_again
FROM docs JOIN lim USING (submission_id), (SELECT unnest(['brief_writer', 'extractor', 'rubric_analyzer', 'verifier']) AS stage) t GROUP BY stage""",
    Q.FLAGS, Q.VIEWS, Q.NOT_ASSESSED, _DOCUMENT))
def stored_answers(spark, folder):
    """A second run over the same prompts asks nothing: all of its answers come from the store."""
    docs = _documents(spark, folder)
    prompts = cut(docs.withColumnRenamed("document", "prompt"), "prompts")
    store, rows = A.AnswerStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/answers-{uuid.uuid4().hex}"), None
    for stage, contract in _STAGES.items():
        for call in (lambda prompt, stage=stage: _answer(stage, prompt), _never):
            said = A.ask(prompts, call, contract, stage, store)
        said = said.select(F.lit(stage).alias("stage"), "answer")
        rows = said if rows is None else rows.unionByName(said)
    asked = store.read(spark).groupBy("stage").agg(F.count("*").alias("prompts"), F.count("error").alias("asked_again"))
    own = rows.groupBy("stage").agg(F.count("*").alias("submissions"), F.count("answer").alias("answers"))
    return own.join(asked, "stage")


def _never(prompt: str) -> str:
    raise RuntimeError("asked again")


@CATALOG.query("grd4_topics_and_claims", Q.deck_sql("""SELECT submission_id, kind, key, label, ref AS refs FROM cite JOIN (
  SELECT unnest(['topic', 'topic', 'topic', 'topic', 'claim', 'claim']) AS kind, unnest(['solution', 'problem', 'team', 'extra', 'c1', 'c2']) AS key,
    unnest(['What is built', 'The need', 'People', 'Other', 'other', 'other']) AS label, unnest([1, 2, 3, 2, 1, 2]) AS p) t ON t.p = page_number""", *_OUT))
def topics_and_claims(spark, folder):
    found, _, _ = outside_run(spark, folder)
    topics = found.topics.select("submission_id", F.lit("topic").alias("kind"), F.col("topic").alias("key"), "label", _refs(F.col("evidence")).alias("refs"))
    claims = found.claims.select("submission_id", F.lit("claim").alias("kind"), F.col("id").alias("key"), F.col("category").alias("label"), _refs(F.col("evidence")).alias("refs"))
    return topics.unionByName(claims)


@CATALOG.query("grd5_criteria", Q.deck_sql(f"""SELECT submission_id, criterion_id, criterion_id <> 3 AND ref IS NOT NULL AS assessed, CASE WHEN criterion_id <> 3 AND ref IS NOT NULL THEN criterion_id + 4.5::DOUBLE END AS score,
  CASE WHEN criterion_id <> 3 AND ref IS NULL THEN {Q.quote(Q.V.UNLINKED_REASON)} END AS reason, coalesce(ref, '') AS refs FROM crit""", *_OUT))
def outside_criteria(spark, folder):
    found, _, _ = outside_run(spark, folder)
    return found.criteria.select("submission_id", "criterion_id", "assessed", "score", "reason", _refs(F.col("evidence")).alias("refs"))


@CATALOG.query("grd6_items", Q.deck_sql(f"""SELECT l.submission_id, t.id, t.label, coalesce(c.ref, '') AS refs FROM lim l, (SELECT unnest(['v1', 'v3', 'v4']) AS id, unnest([1, 99, 2]) AS p,
    unnest([NULL, {Q.quote(Q.V.SIMILARITY_LABEL)}, NULL]) AS label) t LEFT JOIN cite c ON c.submission_id = l.submission_id AND c.page_number = t.p WHERE t.id <> 'v1' OR c.ref IS NOT NULL""", *_OUT))
def outside_items(spark, folder):
    found, _, _ = outside_run(spark, folder)
    return found.items.select("submission_id", "id", "label", _refs(F.col("evidence")).alias("refs"))


@CATALOG.query("grd7_strengths", Q.deck_sql("""SELECT submission_id, t.id, 'Strength ' || t.n AS text, ref AS refs FROM cite JOIN (
  SELECT unnest(['s1', 's3']) AS id, unnest([1, 3]) AS n, unnest([1, 2]) AS p) t ON t.p = page_number""", *_OUT))
def outside_strengths(spark, folder):
    found, _, _ = outside_run(spark, folder)
    return found.strengths.select("submission_id", "id", "text", _refs(F.col("evidence")).alias("refs"))


@CATALOG.query("udf3_brief", Q.deck_sql(f"""
SELECT l.submission_id, 'A deck of ' || l.pages || ' slides' AS overview, 'plugged' AS engine, s.strengths, h.highlights,
  coalesce(i.ids || ',', '') || 'v4,' || CASE WHEN c1.ref IS NOT NULL THEN 'v1,' ELSE '' END || 'v3' AS verify, a.coverage, a.issues, a.overall_score, a.assessed_weight
FROM lim l LEFT JOIN cite c1 ON c1.submission_id = l.submission_id AND c1.page_number = 1
LEFT JOIN (SELECT submission_id, string_agg(id, ',' ORDER BY number) AS ids FROM integ GROUP BY 1) i ON i.submission_id = l.submission_id
JOIN (SELECT submission_id, string_agg(CASE page_number WHEN 1 THEN 's1' ELSE 's3' END, ',' ORDER BY page_number) AS strengths FROM cite WHERE page_number <= 2 GROUP BY 1) s ON s.submission_id = l.submission_id
JOIN (SELECT submission_id, string_agg('e' || n || '|' || label || '|' || ref, chr(10) ORDER BY n) AS highlights FROM (
    SELECT submission_id, label, ref, row_number() OVER (PARTITION BY submission_id ORDER BY o) AS n FROM cite JOIN (
      SELECT unnest(['The need', 'What is built', 'Other']) AS label, unnest([2, 1, 2]) AS p, unnest([1, 2, 3]) AS o) t ON t.p = page_number) GROUP BY 1) h ON h.submission_id = l.submission_id
JOIN (SELECT submission_id, string_agg(criterion_id || ':' || CASE WHEN ref IS NULL THEN 'not_found' ELSE 'limited' END, ',' ORDER BY criterion_id) AS coverage,
    count(*) FILTER (WHERE criterion_id % 2 = 1) AS issues,
    {Q.duck_round('100 * sum(weight * (least(10, criterion_id + 4.5::DOUBLE) / 10) ORDER BY criterion_id) FILTER (WHERE criterion_id <> 3 AND ref IS NOT NULL) / sum(weight) FILTER (WHERE criterion_id <> 3 AND ref IS NOT NULL)')} AS overall_score,
    {Q.duck_round('100 * coalesce(sum(weight) FILTER (WHERE criterion_id <> 3 AND ref IS NOT NULL), 0) / sum(weight)')} AS assessed_weight
  FROM crit GROUP BY 1) a ON a.submission_id = l.submission_id""", *_TO_BRIEF, _CITE))
def outside_brief(spark, folder):
    """From model answers through checks and grounding to the assembled brief."""
    seen, subs = see(deck_units(spark, folder)), deck_submissions(spark, folder)
    found, answers, _ = outside_run(spark, folder, seen)
    packs, _ = documents(_run(spark, folder, seen), seen.flagged, subs, _rounds(spark, folder))
    scale = subs.select("submission_id", F.lit(10).alias("scale"))
    parts = O.brief_parts(found, answers["extractor"], answers["brief_writer"], scale)
    final = B.final_verify_rows(parts, B.integrity_items(seen.flagged))
    rows = B.briefs(parts, final, packs, O.issues(found), engine="plugged", model="quoting", stages=list(_STAGES), note="")
    b, d = F.col("brief"), F.col("assessment_document")
    shown = F.transform(b["evidence_highlights"], lambda h: F.concat_ws("|", h["id"], h["label"], _refs(h["evidence"])))
    return rows.select(
        "submission_id", b["overview"].alias("overview"), b["provenance"]["engine"].alias("engine"),
        F.array_join(F.transform(b["strengths"], lambda s: s["id"]), ",").alias("strengths"), F.array_join(shown, "\n").alias("highlights"),
        F.array_join(F.transform(b["verify_these"], lambda v: v["id"]), ",").alias("verify"),
        F.array_join(F.transform(b["rubric_coverage"], lambda c: F.concat(c["criterion_id"].cast("string"), F.lit(":"), c["coverage"])), ",").alias("coverage"),
        F.aggregate(d["criteria"], F.lit(0).cast("bigint"), lambda n, c: n + F.size(c["issues"])).alias("issues"),
        d["overall_score"].alias("overall_score"), d["assessed_weight"].alias("assessed_weight"))


@cache
def _json(x: str) -> str:
    return f"CAST(to_json({x}) AS STRING)"


@CATALOG.query("src20_json_documents", Q.deck_sql(f"""SELECT o.submission_id, '{{"submission_id":' || o.submission_id || ',"brief":{{"overview":' || {_json('o.overview')} || ',"target_users":' || {_json("coalesce(o.target_users, '')")}
  || ',"strengths":[' || coalesce(s.l, '') || ']}}}}' AS value FROM overviews o LEFT JOIN (
    SELECT submission_id, string_agg('{{"id":' || {_json('id')} || ',"text":' || {_json('text')} || '}}', ',' ORDER BY id) AS l FROM strengths GROUP BY 1) s USING (submission_id)""",
    *_TO_BRIEF, Q.OVERVIEW))
def written_documents(spark, folder):
    parts = _run(spark, folder).parts
    short = F.transform("strengths", lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text")))
    own = F.struct("overview", F.coalesce("target_users", F.lit("")).alias("target_users"), short.alias("strengths"))
    return json_documents(parts.select("submission_id", own.alias("brief")), "brief")
