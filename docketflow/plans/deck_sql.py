"""DuckDB statements of the deck results, as chained common table expressions.

They are written over exploded lines and sentences (the Spark side works on
arrays inside a unit's row).  Flags, views and citations take the comparison of two
texts as a parameter: ``held`` is containment, which is enough for the decks of
whole turns, where a line or excerpt is either contained in its counterpart or far
below the thresholds; ``near`` states the window score itself, for decks whose lines
lie just to either side of each threshold.
"""

from __future__ import annotations

from docketflow import fixed_values as V
from docketflow.plans.deck_entities import duck_decks
from docketflow.plans.dialect import duck_ascii, duck_best_window, duck_match, duck_round, quote


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9%$]+', ' ', 'g'))"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def cut(x: str, n: int) -> str:
    c = flat(x)
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(left({c}, {n - 1})) || '…' END"


def has(x: str, pattern: str) -> str:
    return duck_match(duck_ascii(x), pattern)


def instruction(x: str) -> str:
    return f"regexp_matches({duck_ascii(flat(x))}, {quote('|'.join(f'(?:{p})' for p in V.INSTRUCTION_PATTERNS))}, 'i')"


def either(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def held(a: str, b: str, threshold: float) -> str:
    return either(a, b)


def near(a: str, b: str, threshold: float) -> str:
    one, other = duck_best_window(a, b), duck_best_window(b, a)
    score = f"CASE WHEN length({a}) < length({b}) THEN {one} WHEN length({a}) > length({b}) THEN {other} ELSE greatest({one}, {other}) END"
    return f"(CASE WHEN {either(a, b)} THEN TRUE ELSE {score} >= {threshold} END)"


BULLETS = "' •-–—*' || chr(9)"
D = V.FLAG_DETAILS
SUSPICIOUS, POTENTIAL = "'suspicious_instruction_detected'", "'potential_discrepancy'"


def _split(column: str, source: str, where: str = "TRUE") -> str:
    return (
        f"SELECT submission_id, page_number, unnest(string_split({column}, chr(10))) AS raw, "
        f"generate_subscripts(string_split({column}, chr(10)), 1) AS ln FROM {source} WHERE {column} IS NOT NULL AND {where}"
    )


def flags_sql(like=held) -> str:
    return f"""
l0 AS MATERIALIZED (SELECT *, trim(raw, {BULLETS}) AS line FROM ({_split('text', 'u')})),
l1 AS MATERIALIZED (SELECT *, {norm('line')} AS nrm, {instruction('line')} AS instr FROM l0 WHERE line <> ''),
n1 AS MATERIALIZED (SELECT *, trim(raw, {BULLETS}) AS line FROM ({_split('speaker_notes', 'u')})),
un AS MATERIALIZED (SELECT *, {norm('ocr_text')} AS onrm, {norm('signal_text')} AS snrm, {instruction('coalesce(signal_text, chr(32))')} AS sinstr,
    {instruction('text')} AS tinstr, NOT hidden AND text <> '' AS visible FROM u),
cmp AS MATERIALIZED (SELECT l.*, u.onrm <> '' AND {like('l.nrm', 'u.onrm', V.MATCH_THRESHOLD)} AS seen FROM l1 l JOIN un u USING (submission_id, page_number)
  WHERE u.visible AND u.rendered AND u.ocr_status IN ('completed', 'empty') AND length(l.nrm) >= 14 AND len(string_split(l.nrm, ' ')) >= 3
    AND NOT (u.snrm <> '' AND {either('l.nrm', 'u.snrm')})),
agg AS (SELECT submission_id, page_number, count(*) AS n, count(*) FILTER (WHERE NOT seen AND NOT instr) AS nb,
    string_agg(line, ' ' ORDER BY ln) FILTER (WHERE NOT seen AND instr) AS instr_text,
    string_agg(line, ' / ' ORDER BY ln) FILTER (WHERE NOT seen AND NOT instr) AS benign_text FROM cmp GROUP BY 1, 2),
raw_flags AS (
  SELECT submission_id, page_number, 1 AS step, 0 AS ln, CASE WHEN tinstr THEN 'instruction_like_text' ELSE 'hidden_slide' END AS type,
    CASE WHEN tinstr THEN {SUSPICIOUS} ELSE {POTENTIAL} END AS status, 'slide' AS location, {cut('text', 220)} AS excerpt,
    {quote(D['hidden_slide'])} || CASE WHEN tinstr THEN {quote(D['hidden_slide_instruction'])} ELSE '' END AS detail, TRUE AS withheld
  FROM un WHERE hidden AND text <> ''
  UNION ALL SELECT submission_id, page_number, 2, 0, CASE WHEN sinstr THEN 'instruction_like_text' ELSE signal_reason END,
    CASE WHEN sinstr THEN {SUSPICIOUS} ELSE {POTENTIAL} END, 'slide_text', {cut('signal_text', 220)},
    'Possible hidden content: ' || CASE signal_reason {' '.join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in V.STRUCTURAL_LABELS.items())} END || '.'
      || CASE WHEN sinstr THEN {quote(D['structural_instruction'])} ELSE '' END
      || CASE WHEN regexp_matches(signal_detail, '[0-9]') THEN ' (' || signal_detail || ')' ELSE '' END, TRUE
  FROM un WHERE signal_reason IS NOT NULL
  UNION ALL SELECT submission_id, page_number, 3, 0, 'instruction_like_text', {SUSPICIOUS}, 'slide_text', {cut('instr_text', 220)},
    {quote(D['hidden_instruction'])}, TRUE FROM agg WHERE instr_text IS NOT NULL
  UNION ALL SELECT submission_id, page_number, 4, 0, 'not_visible_in_render', {POTENTIAL}, 'slide_text', {cut('benign_text', 220)},
    nb || {quote(D['benign'])}, FALSE FROM agg WHERE nb >= 2 AND nb / n >= 0.25
  UNION ALL SELECT submission_id, page_number, 5, ln, 'visible_evaluator_address', 'no_discrepancy_detected', 'slide_text', {cut('line', 220)},
    {quote(D['visible_address'])}, FALSE FROM cmp WHERE seen AND instr
  UNION ALL SELECT submission_id, page_number, 6, 0, 'visual_check_unavailable', 'manual_review_required', 'slide', '',
    CASE WHEN NOT rendered THEN {quote(D['not_rendered'])} ELSE {quote(D['not_read'])} END || {quote(D['no_comparison'])}, FALSE
  FROM un WHERE visible AND (ocr_status = 'failed' OR NOT rendered)
  UNION ALL SELECT submission_id, page_number, 7, ln, 'speaker_note_instruction', {SUSPICIOUS}, 'speaker_notes', {cut('line', 220)},
    {quote(D['note_instruction'])}, TRUE FROM n1 WHERE line <> '' AND {instruction('line')}),
flags AS MATERIALIZED (SELECT submission_id, page_number, CAST(row_number() OVER (PARTITION BY submission_id, page_number ORDER BY step, ln) - 1 AS INT) AS ord,
    'slide_' || lpad(CAST(page_number AS STRING), 2, '0') AS slide_id, type, status, location, excerpt, detail, withheld AS withheld_from_ai
  FROM raw_flags)"""


FLAGS = flags_sql()

SEVERITY = "CASE status " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in V.INTEGRITY_SEVERITY.items()) + " END"
_S = V.REPORT_SUMMARIES
_WHERE = "coalesce(CASE WHEN n > 4 THEN n || ' slides' ELSE names END, 'this submission')"

REPORT = f"""
sev AS (SELECT DISTINCT submission_id, page_number, {SEVERITY} AS s FROM flags),
top AS (SELECT submission_id, max(s) AS s FROM sev GROUP BY 1),
named AS (SELECT t.submission_id, t.s, count(*) AS n, string_agg('Slide ' || v.page_number, ', ' ORDER BY v.page_number) AS names
  FROM top t JOIN sev v ON v.submission_id = t.submission_id AND v.s = t.s GROUP BY 1, 2),
lev AS (SELECT b.submission_id, b.ocr_available, greatest(coalesce(t.s, 0), CASE WHEN b.ocr_available THEN 0 ELSE 2 END) AS lv
  FROM subs b LEFT JOIN top t USING (submission_id)),
report AS (SELECT l.submission_id, ['no_discrepancy_detected', 'potential_discrepancy', 'manual_review_required', 'suspicious_instruction_detected'][l.lv + 1] AS status,
  CASE WHEN lv = 0 THEN {quote(_S['no_discrepancy_detected'])}
    WHEN lv = 1 THEN replace({quote(_S['potential_discrepancy'])}, '{{where}}', {_WHERE})
    WHEN lv = 3 THEN replace({quote(_S['suspicious_instruction_detected'])}, '{{where}}', {_WHERE})
    WHEN NOT ocr_available THEN {quote(_S['no_ocr'])}
    ELSE replace({quote(_S['manual_review_required'])}, '{{where}}', {_WHERE}) END AS summary
  FROM lev l LEFT JOIN named n ON n.submission_id = l.submission_id AND n.s = l.lv)"""

_N = V.NOT_ASSESSED
_LABEL = "('Slide ' || page_number)"


def _tpl(text: str, **values: str) -> str:
    out = quote(text)
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


HOST = "CASE WHEN regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) <> '' THEN regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) ELSE link END"
NOT_ASSESSED = f"""
host AS (SELECT *, {HOST} AS h, len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS words,
    'slide_' || lpad(CAST(page_number AS STRING), 2, '0') AS sid FROM u),
items0 AS (
  SELECT submission_id, 1 AS part, page_number, 1 AS step, {_LABEL} || ' (hidden slide)' AS area, {_tpl(_N['hidden'], label=_LABEL)} AS reason, sid FROM host WHERE hidden
  UNION ALL SELECT submission_id, 1, page_number, 2, {_LABEL} || ' visual content', {_tpl(_N['not_rendered'], label=_LABEL)}, sid FROM host WHERE NOT hidden AND NOT rendered AND renderable
  UNION ALL SELECT submission_id, 1, page_number, 3, {_LABEL} || ' images/diagrams', CASE WHEN ocr_status = 'completed' THEN {_tpl(_N['visual_read'], label=_LABEL)}
    ELSE {_tpl(_N['visual_unread'], label=_LABEL)} END, sid FROM host WHERE NOT hidden AND has_visual_content AND words < 25
  UNION ALL SELECT submission_id, 1, page_number, 4, {_LABEL} || CASE WHEN regexp_matches(h, 'youtube|youtu[.]be|vimeo|loom') THEN ' linked video content' ELSE ' linked external content' END,
    {_tpl(_N['link'], label=_LABEL, host='h')}, sid FROM host WHERE NOT hidden AND link IS NOT NULL
  UNION ALL SELECT submission_id, 1, page_number, 5, {_LABEL} || ' embedded media', {_tpl(_N['media'], label=_LABEL)}, sid FROM host WHERE NOT hidden AND has_embedded_media
  UNION ALL SELECT submission_id, 1, page_number, 6, {_LABEL} || ' text', own_note, sid FROM host WHERE NOT hidden AND lower(own_note) LIKE '%failed%'
  UNION ALL SELECT submission_id, 0, 0, 0, 'Slide rendering', {quote(_N['document_render_head'])} || CASE WHEN doc_note IS NOT NULL THEN ' (' || doc_note || ')' ELSE '' END
    || {quote(_N['document_render_tail'])}, NULL FROM subs WHERE NOT renderable
  UNION ALL SELECT submission_id, 2, 0, 0, 'Visual integrity comparison', {quote(_N['document_no_ocr'])}, NULL FROM subs WHERE renderable AND NOT ocr_available),
items AS (SELECT submission_id, part, page_number, CAST(row_number() OVER (PARTITION BY submission_id, part, page_number ORDER BY step) - 1 AS INT) AS ord, area, reason,
    sid AS slide_id FROM items0)"""

MARK = quote(V.WITHHELD_MARK)


def _kept(name: str, column: str, location: str, like) -> str:
    """Lines of a text with withheld ones replaced by one mark per run."""
    return f"""
{name}_ex AS (SELECT submission_id, page_number, {norm("regexp_replace(excerpt, '…+$', '')")} AS ex FROM flags
  WHERE withheld_from_ai AND location = '{location}' AND excerpt <> ''),
{name}_dr AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM {name}_ex e WHERE e.submission_id = l.submission_id AND e.page_number = l.page_number
      AND length(e.ex) >= 8 AND {norm('l.raw')} <> '' AND {like(norm('l.raw'), 'e.ex', V.WITHHELD_THRESHOLD)}) THEN {MARK} ELSE raw END AS shown FROM ({_split(column, 'u')}) l),
{name}_lag AS (SELECT *, lag(shown) OVER (PARTITION BY submission_id, page_number ORDER BY ln) AS prev FROM {name}_dr),
{name} AS (SELECT submission_id, page_number, string_agg(shown, chr(10) ORDER BY ln) FILTER (WHERE NOT (shown = {MARK} AND raw <> {MARK} AND coalesce(prev = {MARK}, FALSE))) AS kept
  FROM {name}_lag GROUP BY 1, 2)"""


def views_sql(like=held) -> str:
    return _kept("kt", "text", "slide_text", like) + "," + _kept("kn", "speaker_notes", "speaker_notes", like) + f""",
im AS (SELECT o.submission_id, o.page_number, string_agg(trim(o.raw), chr(10) ORDER BY o.ln) AS img FROM ({_split('ocr_text', 'u', 'has_visual_content')}) o
  JOIN u USING (submission_id, page_number) WHERE length({norm('o.raw')}) >= 4 AND NOT ({norm('u.text')} <> '' AND {like(norm('o.raw'), norm('u.text'), V.IMAGE_TEXT_THRESHOLD)}) GROUP BY 1, 2),
wh AS (SELECT DISTINCT submission_id, page_number FROM flags WHERE withheld_from_ai AND location = 'slide'),
views AS MATERIALIZED (SELECT u.submission_id, u.page_number, 'slide_' || lpad(CAST(u.page_number AS STRING), 2, '0') AS slide_id, u.team_name, u.submission_title,
    coalesce(u.title, '') AS title, w.page_number IS NOT NULL AS withheld, CASE WHEN w.page_number IS NOT NULL THEN {MARK} ELSE coalesce(kt.kept, '') END AS text,
    CASE WHEN w.page_number IS NOT NULL THEN '' ELSE coalesce(kn.kept, '') END AS notes, CASE WHEN w.page_number IS NOT NULL THEN '' ELSE coalesce(im.img, '') END AS image_text
  FROM u LEFT JOIN kt USING (submission_id, page_number) LEFT JOIN kn USING (submission_id, page_number) LEFT JOIN im USING (submission_id, page_number)
  LEFT JOIN wh w USING (submission_id, page_number))"""


VIEWS = views_sql()


def _sentences(column: str, source: str) -> str:
    return (
        f"SELECT submission_id, page_number, '{source}' AS source, ln, unnest(string_split(regexp_replace(trim(raw, {BULLETS}), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS piece, "
        f"generate_subscripts(string_split(regexp_replace(trim(raw, {BULLETS}), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) AS pn "
        f"FROM ({_split(column, 'views')}) WHERE trim(raw, {BULLETS}) <> ''"
    )


SENTENCES = f"""
s0 AS (SELECT * FROM ({_sentences('text', 'text')}) UNION ALL SELECT * FROM ({_sentences('notes', 'notes')}) UNION ALL SELECT * FROM ({_sentences('image_text', 'image')})),
s1 AS (SELECT s.submission_id, s.page_number, s.source, s.ln, s.pn, trim(s.piece) AS sentence FROM s0 s JOIN views v USING (submission_id, page_number)
  WHERE trim(s.piece) <> '' AND (s.source <> 'text' OR {norm('s.piece')} <> {norm('v.title')})),
sentences AS MATERIALIZED (SELECT submission_id, page_number, source, CAST(row_number() OVER (PARTITION BY submission_id, page_number, source ORDER BY ln, pn) - 1 AS INT) AS ord, sentence FROM s1)"""

def via_sql(like=held) -> str:
    arms = [f"WHEN {norm(f'x.{column}')} <> '' AND {like(norm('x.excerpt'), norm(f'x.{column}'), V.EXCERPT_THRESHOLD)} THEN '{via}'"
            for via, column in (("text", "text"), ("speaker_notes", "notes"), ("ocr", "image_text"))]
    return f"CASE WHEN x.withheld OR {norm('x.excerpt')} = '' THEN 'unknown' {' '.join(arms)} ELSE 'unknown' END"


VIA = via_sql()

_TOPIC_ROWS = " UNION ALL ".join(
    f"""SELECT {i} AS topic_index, '{k}' AS topic, {quote(lab)} AS label, {quote(tp)} AS tp, {quote(bp)} AS bp, {str(k in V.WEAK_TOPICS).upper()} AS weak"""
    for i, (k, lab, tp, bp) in enumerate(V.TOPICS)
)

_BODY_HIT = " ".join(f"WHEN {i} THEN {has('c.sentence', t[3])}" for i, t in enumerate(V.TOPICS))
_TITLE_HIT = " ".join(f"WHEN {i} THEN {has('v.title', t[2])}" for i, t in enumerate(V.TOPICS))

TOPICS = f"""
vis AS (SELECT submission_id, count(*) FILTER (WHERE NOT withheld) AS n_visible FROM views GROUP BY 1),
an AS MATERIALIZED (SELECT v.* FROM views v JOIN vis USING (submission_id) WHERE NOT withheld AND (page_number <> 1 OR n_visible = 1)),
tdef AS ({_TOPIC_ROWS}),
c0 AS (SELECT s.*, a.team_name, row_number() OVER (PARTITION BY s.submission_id, s.page_number ORDER BY CASE source WHEN 'text' THEN 0 ELSE 1 END, s.ord) AS pos
  FROM sentences s JOIN an a USING (submission_id, page_number) WHERE source IN ('text', 'image')),
c1 AS MATERIALIZED (SELECT *, len(string_split({flat('sentence')}, ' ')) < 3 OR starts_with(lower(sentence), lower(team_name)) AS footer FROM c0),
bh AS MATERIALIZED (SELECT c.submission_id, c.page_number, t.topic_index, c.pos, c.footer, c.sentence FROM c1 c JOIN tdef t ON CASE t.topic_index {_BODY_HIT} END),
ut AS (SELECT v.submission_id, v.page_number, v.slide_id, v.title, t.topic_index, t.weak, CASE t.topic_index {_TITLE_HIT} END AS th FROM an v, tdef t),
hc AS (SELECT submission_id, page_number, topic_index, count(*) FILTER (WHERE NOT footer) AS hits, arg_min(sentence, pos) FILTER (WHERE NOT footer) AS first_hit,
    arg_min(sentence, pos) AS any_hit, arg_min(footer, pos) AS any_footer FROM bh GROUP BY 1, 2, 3),
fs AS (SELECT submission_id, page_number, arg_min(sentence, pos) FILTER (WHERE NOT footer) AS first_sentence,
    string_agg(sentence, '; ' ORDER BY pos) FILTER (WHERE source = 'text') AS joined FROM c1 GROUP BY 1, 2),
sc AS (SELECT ut.*, coalesce(hits, 0) AS hits, CASE WHEN th THEN 3 ELSE 0 END + least(coalesce(hits, 0), 2) AS score,
    coalesce(first_hit, first_sentence, nullif(joined, ''), title) AS ex, any_hit, any_footer
  FROM ut LEFT JOIN hc USING (submission_id, page_number, topic_index) LEFT JOIN fs USING (submission_id, page_number)),
strong AS (SELECT submission_id, page_number, slide_id, topic_index, score, ex FROM sc WHERE score >= 3 OR hits >= 2),
weak AS (SELECT submission_id, page_number, slide_id, topic_index, 1 AS score, any_hit AS ex FROM sc WHERE weak AND any_hit IS NOT NULL AND NOT any_footer
  AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.submission_id = sc.submission_id AND s.topic_index = sc.topic_index)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY submission_id, topic_index ORDER BY score DESC, page_number) AS rn FROM strong
  UNION ALL SELECT *, row_number() OVER (PARTITION BY submission_id, topic_index ORDER BY page_number) + CASE WHEN row_number() OVER (PARTITION BY submission_id, topic_index ORDER BY page_number) > 1 THEN 10 ELSE 0 END FROM weak),
tr0 AS (SELECT r.submission_id, r.topic_index, t.topic, t.label, r.slide_id, r.page_number, {cut('r.ex', 200)} AS excerpt, v.text, v.notes, v.image_text, v.withheld
  FROM ranked r JOIN tdef t USING (topic_index) JOIN views v USING (submission_id, page_number) WHERE rn <= 3 AND r.ex <> ''),
topic_refs AS MATERIALIZED (SELECT x.submission_id, x.topic_index, x.topic, x.label, x.slide_id, x.excerpt, x.page_number, {VIA} AS via FROM tr0 x)"""

_CAT = " ".join(f"WHEN {has('sentence', p)} THEN '{k}'" for k, p in V.CATEGORY_PATTERNS)
CLAIMS = f"""
cl0 AS MATERIALIZED (SELECT s.submission_id, s.page_number, s.ord, s.sentence, a.notes, a.slide_id, a.text, a.image_text, a.withheld, {has('s.sentence', V.NOVELTY_PATTERN)} AS novelty,
    {' OR '.join(has('s.sentence', p) for p in V.QUANTITY_PATTERNS)} AS quant, {has('s.sentence', V.PLAN_PATTERN)} AS is_plan, {has('s.sentence', V.PRICING_PATTERN)} AS pricing
  FROM sentences s JOIN an a USING (submission_id, page_number) WHERE s.source = 'text'),
cl1 AS (SELECT *, CASE WHEN novelty THEN 'novelty' {_CAT} ELSE 'quantitative' END AS category, {has('sentence', V.SUPPORT_PATTERN)} AS own, {has('notes', V.SUPPORT_PATTERN)} AS by_notes
  FROM cl0 WHERE (novelty OR quant) AND NOT is_plan AND (NOT pricing OR novelty)),
cl2 AS (SELECT *, own OR (by_notes AND category <> 'novelty') AS supported, {cut('sentence', 200)} AS excerpt FROM cl1),
claims AS MATERIALIZED (SELECT x.submission_id, row_number() OVER (PARTITION BY x.submission_id ORDER BY x.page_number, x.ord) AS claim_no,
    CASE WHEN NOT supported THEN row_number() OVER (PARTITION BY x.submission_id, supported ORDER BY x.page_number, x.ord) END AS unsupported_no,
    x.excerpt AS claim_text, x.category, x.supported, x.page_number, x.slide_id, {VIA} AS via FROM cl2 x)"""

_LF_FIRST = "split_part(tag, ' ', 1)"
OVERVIEW = f"""
fv AS (SELECT submission_id, min(page_number) AS page_number FROM views WHERE NOT withheld GROUP BY 1),
tg AS (SELECT s.submission_id, regexp_replace(arg_min(sentence, ord), '[.]+$', '') AS tag FROM sentences s JOIN fv USING (submission_id, page_number)
  WHERE source = 'text' AND len(string_split({flat('sentence')}, ' ')) >= 4 AND NOT starts_with(lower(sentence), 'team') GROUP BY 1),
tu AS (SELECT s.submission_id, arg_min({cut('s.sentence', 200)}, {{'p': s.page_number, 'o': s.ord}}) AS target_users FROM sentences s JOIN an a USING (submission_id, page_number)
  WHERE s.source = 'text' AND {has('s.sentence', V.TARGET_USER_PATTERN)} AND NOT {has('s.sentence', V.NOVELTY_PATTERN)} GROUP BY 1),
sol AS (SELECT submission_id, arg_min(excerpt, slide_id) AS ex FROM topic_refs WHERE topic = 'solution' GROUP BY 1),
ids AS (SELECT submission_id, max(team_name) AS team, max(submission_title) AS ttl FROM views GROUP BY 1),
ov0 AS (SELECT i.*, v.title, tg.tag, sol.ex, tu.target_users FROM ids i LEFT JOIN fv USING (submission_id) LEFT JOIN views v ON v.submission_id = i.submission_id AND v.page_number = fv.page_number
  LEFT JOIN tg ON tg.submission_id = i.submission_id LEFT JOIN sol ON sol.submission_id = i.submission_id LEFT JOIN tu ON tu.submission_id = i.submission_id),
overviews AS (SELECT submission_id, team || ' proposes ' || trim(coalesce(nullif(title, ''), ttl)) || CASE WHEN coalesce(tag, '') <> '' THEN ': ' ||
    CASE WHEN {_LF_FIRST} IN ('A', 'An', 'The') OR (length({_LF_FIRST}) > 1 AND substr({_LF_FIRST}, 2) = lower(substr({_LF_FIRST}, 2)) AND regexp_matches(substr({_LF_FIRST}, 2), '\\pL')
      AND NOT contains(left({_LF_FIRST}, 3), '-')) THEN lower(left(tag, 1)) || substr(tag, 2) ELSE tag END ELSE '' END || '.'
    || CASE WHEN ex IS NOT NULL THEN ' ' || regexp_replace(ex, '[.]+$', '') || '.' ELSE '' END AS overview, target_users FROM ov0)"""


def _topics_of(text: str) -> str:
    """Topic and first position pairs of a criterion text."""
    parts = []
    pos = 0
    for p, topics in V.CRITERION_HINTS:
        for t in topics:
            parts.append(f"CASE WHEN {has(text, p)} THEN {{'t': '{t}', 'p': {pos}}} END")
            pos += 1
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_OPEN = " OR ".join(
    f"(k.category = '{c}' AND ct.topic IN ({', '.join(quote(t) for t in ts)}))" for c, ts in V.CLAIM_TOPICS.items()
)
RUBRIC = f"""
rt AS (SELECT round_id, criterion_id, position, name, weight, unnest(CASE WHEN len({_topics_of('name')}) > 0 THEN {_topics_of('name')}
    ELSE {_topics_of("name || ' ' || description")} END) AS tp FROM rubric),
ct0 AS (SELECT round_id, criterion_id, tp.t AS topic, min(tp.p) AS p FROM rt GROUP BY 1, 2, 3),
sc1 AS (SELECT b.submission_id, r.round_id, r.criterion_id, r.position, r.name, r.weight FROM subs b JOIN rubric r ON r.round_id = b.round_id),
ct AS MATERIALIZED (SELECT s.submission_id, s.criterion_id, c.topic, c.p FROM sc1 s JOIN ct0 c ON c.round_id = s.round_id AND c.criterion_id = s.criterion_id),
cr0 AS (SELECT ct.submission_id, ct.criterion_id, t.slide_id, t.excerpt, t.page_number, t.via, min(ct.p * 10 + t.page_number / 1000.0) AS p
  FROM ct JOIN topic_refs t ON t.submission_id = ct.submission_id AND t.topic = ct.topic GROUP BY 1, 2, 3, 4, 5, 6),
cr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY submission_id, criterion_id ORDER BY slide_id, p) AS rn FROM cr0),
lab AS (SELECT submission_id, criterion_id, list('Slide ' || page_number ORDER BY slide_id) AS labs FROM (SELECT DISTINCT submission_id, criterion_id, page_number, slide_id FROM cr) GROUP BY 1, 2),
ce0 AS (SELECT *, row_number() OVER (PARTITION BY submission_id, criterion_id, slide_id, {norm('excerpt')} ORDER BY rn) AS d FROM cr WHERE rn <= 5),
ce AS MATERIALIZED (SELECT * FROM ce0 WHERE d = 1),
issue_rows AS MATERIALIZED (SELECT DISTINCT ct.submission_id, ct.criterion_id, k.claim_no AS ord, 'unsupported_claim' AS type,
    replace({quote(V.UNSUPPORTED_ISSUE)}, '{{claim}}', {cut('k.claim_text', 110)}) AS description, CASE WHEN k.category = 'novelty' THEN 'low' ELSE 'medium' END AS severity
  FROM ct JOIN claims k ON k.submission_id = ct.submission_id AND NOT k.supported AND ({_OPEN})
  UNION ALL SELECT ct.submission_id, ct.criterion_id, 1152921504606846976, 'missing_information', {quote(V.MISSING_COMPETITION_ISSUE)}, 'medium' FROM ct
  WHERE topic = 'competition' AND NOT EXISTS (SELECT 1 FROM topic_refs t WHERE t.submission_id = ct.submission_id AND t.topic = 'competition')),
ic AS (SELECT submission_id, criterion_id, count(*) AS n, count(*) FILTER (WHERE severity = 'medium') AS nm, count(*) FILTER (WHERE severity = 'low') AS nl FROM issue_rows GROUP BY 1, 2),
ca AS (SELECT s.*, coalesce(a.refs, 0) AS refs, coalesce(a.slides, 0) AS slides, coalesce(a.spec, FALSE) AS spec, coalesce(ic.n, 0) AS n, coalesce(ic.nm, 0) AS nm, coalesce(ic.nl, 0) AS nl, lab.labs,
    EXISTS (SELECT 1 FROM ct JOIN topic_refs t ON t.submission_id = ct.submission_id AND t.topic = ct.topic WHERE ct.submission_id = s.submission_id
      AND ct.criterion_id = s.criterion_id AND ct.topic = 'validation') AS val
  FROM sc1 s LEFT JOIN (SELECT submission_id, criterion_id, count(*) AS refs, count(DISTINCT slide_id) AS slides, bool_or(regexp_matches(excerpt, '[0-9]')) AS spec FROM cr GROUP BY 1, 2) a
    USING (submission_id, criterion_id) LEFT JOIN ic USING (submission_id, criterion_id) LEFT JOIN lab USING (submission_id, criterion_id)),
criteria AS MATERIALIZED (SELECT submission_id, criterion_id, position, name AS criterion, weight, refs > 0 AS assessed, n AS n_issues,
    CASE WHEN refs = 0 THEN 'No slide was found that explicitly addresses ' || lower(name) || '.' ELSE 'Relevant content appears on ' ||
      CASE WHEN len(labs) = 1 THEN labs[1] ELSE array_to_string(labs[:-2], ', ') || ' and ' || labs[-1] END || ' (' || refs || ' supporting point' || CASE WHEN refs <> 1 THEN 's' ELSE '' END
      || ' located' || CASE WHEN val THEN ', including validation data' ELSE '' END || ').' || CASE WHEN n = 0 THEN '' WHEN n = 1 THEN ' 1 point needs verification.'
      ELSE ' ' || n || ' points need verification.' END END AS finding,
    CASE WHEN refs > 0 THEN round_even(greatest(1.0, least(10.0, 4.0 + least(3, slides) + CASE WHEN val THEN 1.5 ELSE 0 END + CASE WHEN spec THEN 0.5 ELSE 0 END
      - (nm * 0.6::DOUBLE + nl * 0.3::DOUBLE))) * 10 / 10 * 2, 0) / 2 END AS score,
    CASE WHEN refs = 0 THEN {quote(V.NO_EVIDENCE_REASON)} END AS reason FROM ca)"""

_T = V.VERIFY_TEXT
_DEPS = " UNION ALL ".join(
    f"""SELECT {i} AS d, s.submission_id, s.page_number, s.ord, s.sentence FROM vsent s WHERE {has('s.sentence', dep[2])}"""
    for i, dep in enumerate(V.DEPENDENCIES)
)
_EXPL = " UNION ALL ".join(
    f"""SELECT DISTINCT {i} AS d, submission_id FROM vtext WHERE {has('all_text', dep[3])}""" for i, dep in enumerate(V.DEPENDENCIES)
)


def _what(i: int, sentence: str) -> str:
    if i == 0:
        found = f"lower(trim(regexp_extract({sentence}, {quote('(?i)' + V.HARDWARE_PHRASE)}, 0)))"
        return f"coalesce(nullif({found}, ''), 'custom hardware')"
    dotless = f"regexp_replace({sentence}, '[.]+$', '')"
    return f"'“' || {cut(dotless, 90)} || '”'"


_DEP_ITEM = " UNION ALL ".join(
    f"""SELECT submission_id, {i} AS k, {quote(dep[1])} AS title, replace({quote(dep[5])}, '{{what}}', {_what(i, 'w')}) AS description, 'feasibility_gap' AS type,
      '{dep[4]}' AS severity, NULL AS label, refs FROM dep1 WHERE d = {i}""" for i, dep in enumerate(V.DEPENDENCIES)
)
_REF = "slide_id || '|' || excerpt || '|' || via"
_KNOWN = " ".join(
    f"WHEN {has('whole', p)} THEN {quote(_T['differentiation_known']).replace('{pattern}', lab)}" for p, lab in V.COMMON_APPROACHES
)
_SHORT = cut("regexp_replace(regexp_replace(trim(claim_text), '[.]+$', ''), '(?i)" + V.GOAL_PREFIX_PATTERN + "', '')", 70)
VERIFY = f"""
vsent AS MATERIALIZED (SELECT s.* FROM sentences s JOIN views v USING (submission_id, page_number) WHERE s.source = 'text' AND NOT v.withheld),
vtext AS MATERIALIZED (SELECT submission_id, page_number, array_to_string(list_filter([title, text, notes, image_text], lambda x: x <> ''), chr(10)) AS all_text FROM views WHERE NOT withheld),
dep0 AS (SELECT *, row_number() OVER (PARTITION BY d, submission_id ORDER BY page_number, ord) AS rn FROM ({_DEPS})),
dep_x AS (SELECT x.*, {VIA} AS via, row_number() OVER (PARTITION BY d, submission_id, slide_id, {norm('x.excerpt')} ORDER BY rn) AS dd FROM
  (SELECT e.d, e.rn, e.sentence, {cut('e.sentence', 200)} AS excerpt, v.* FROM dep0 e JOIN views v USING (submission_id, page_number) WHERE e.rn <= 2) x),
dep1 AS (SELECT d, submission_id, arg_min(sentence, rn) AS w, string_agg({_REF}, chr(10) ORDER BY rn) FILTER (WHERE dd = 1) AS refs FROM dep_x
  WHERE NOT EXISTS (SELECT 1 FROM ({_EXPL}) q WHERE q.d = dep_x.d AND q.submission_id = dep_x.submission_id) GROUP BY 1, 2),
app0 AS (SELECT s.submission_id, arg_min(s.sentence, {{'p': s.page_number, 'o': s.ord}}) AS sentence, min(s.page_number) AS page_number FROM vsent s
  WHERE {has('s.sentence', V.APPENDIX_PATTERN)} AND NOT EXISTS (SELECT 1 FROM views v WHERE v.submission_id = s.submission_id AND {has('v.title', V.APPENDIX_TITLE_PATTERN)}) GROUP BY 1),
app1 AS (SELECT x.submission_id, x.page_number, x.slide_id || '|' || x.excerpt || '|' || {VIA} AS refs FROM (SELECT {cut('a.sentence', 200)} AS excerpt, v.* FROM app0 a JOIN views v USING (submission_id, page_number)) x),
dif AS (SELECT b.submission_id, CASE {_KNOWN} ELSE {quote(_T['differentiation_unknown'])} END AS mid FROM subs b
  LEFT JOIN (SELECT submission_id, string_agg(all_text, ' ' ORDER BY page_number) AS whole FROM vtext GROUP BY 1) t USING (submission_id)),
sol1 AS (SELECT submission_id, arg_min({_REF}, slide_id) AS refs FROM topic_refs WHERE topic = 'solution' GROUP BY 1),
mis AS (SELECT submission_id, string_agg(criterion, ', ' ORDER BY position) AS names, count(*) AS n FROM criteria WHERE NOT assessed GROUP BY 1),
oth AS ({_DEP_ITEM}
  UNION ALL SELECT submission_id, 10, {quote(_T['appendix_title'])}, replace({quote(_T['appendix'])}, '{{label}}', 'Slide ' || page_number), 'missing_information', 'medium', NULL, refs FROM app1
  UNION ALL SELECT d.submission_id, 11, {quote(_T['differentiation_title'])}, {quote(_T['differentiation_head'])} || d.mid || {quote(_T['differentiation_tail'])}, 'potential_similarity', 'medium',
    {quote(V.SIMILARITY_LABEL)}, coalesce(s.refs, '') FROM dif d LEFT JOIN sol1 s USING (submission_id) WHERE NOT EXISTS (SELECT 1 FROM topic_refs t WHERE t.submission_id = d.submission_id AND t.topic = 'competition')
  UNION ALL SELECT submission_id, 12, {quote(_T['missing_title'])}, {quote(_T['missing_head'])} || names || {quote(_T['missing_tail'])}, 'missing_information',
    CASE WHEN n > 1 THEN 'medium' ELSE 'low' END, NULL, '' FROM mis),
opn AS (SELECT submission_id, count(*) AS n FROM claims WHERE NOT supported GROUP BY 1),
cit AS (SELECT submission_id, unsupported_no AS number, CASE WHEN {has('claim_text', V.TARGET_PATTERN)} THEN 'Stated target: ' ELSE 'Claimed: ' END || {_SHORT} AS title,
    CASE WHEN {has('claim_text', V.TARGET_PATTERN)} THEN {quote(_T['target'])} WHEN category = 'novelty' THEN {quote(_T['novelty'])} ELSE {quote(_T['claim'])} END AS description,
    CASE WHEN category = 'technical' THEN 'feasibility_gap' ELSE 'unsupported_claim' END AS type,
    CASE WHEN {has('claim_text', V.TARGET_PATTERN)} THEN 'low' WHEN category IN ('impact', 'market') AND (contains(claim_text, '%') OR contains(claim_text, '$')) THEN 'high'
      WHEN category = 'business' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN category = 'novelty' THEN {quote(V.SIMILARITY_LABEL)} END AS label,
    slide_id || '|' || claim_text || '|' || via AS refs FROM claims WHERE NOT supported),
alli AS (SELECT * FROM cit UNION ALL SELECT o.submission_id, coalesce(opn.n, 0) + row_number() OVER (PARTITION BY o.submission_id ORDER BY k), title, description, type, severity, label, refs
  FROM oth o LEFT JOIN opn USING (submission_id)),
vord AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, number) AS rn FROM alli),
verify AS MATERIALIZED (SELECT submission_id, CAST(rn - 1 AS INT) AS ord, number, 'v' || number AS id, title, description, type, severity, label, refs FROM vord WHERE rn <= 8)"""

_STRONG = " UNION ALL ".join(
    f"""SELECT {i} AS rule, submission_id, topic, {quote(text)} AS text, slide_id, excerpt, via FROM topic_refs WHERE topic = '{topic}'"""
    + (f" AND {has('excerpt', extra)}" if extra else "")
    + (f""" AND submission_id IN (SELECT submission_id FROM claims WHERE supported UNION SELECT submission_id FROM topic_refs
        WHERE topic = 'validation' AND {has('excerpt', V.SUPPORT_PATTERN)})""" if topic == "validation" else "")
    for i, (topic, text, extra) in enumerate(V.STRENGTH_RULES)
)
_HPOS = "CASE topic " + " ".join(
    f"WHEN '{k}' THEN {i}" for i, k in enumerate(V.HIGHLIGHT_ORDER + ["market"])
) + " END"
BRIEF = f"""
st0 AS (SELECT *, min(rule) OVER (PARTITION BY submission_id, topic) AS best, row_number() OVER (PARTITION BY submission_id, rule ORDER BY slide_id) AS rn FROM ({_STRONG})),
st1 AS (SELECT submission_id, rule, text, string_agg({_REF}, chr(10) ORDER BY rn) AS refs FROM st0 WHERE rule = best AND rn <= 2 GROUP BY 1, 2, 3),
st2 AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY rule) AS n FROM st1),
strengths AS (SELECT submission_id, 's' || n AS id, text, refs FROM st2 WHERE n <= 6),
hl0 AS (SELECT submission_id, {_HPOS} AS p, label, string_agg({_REF}, chr(10) ORDER BY slide_id) AS refs FROM topic_refs WHERE topic <> 'team' GROUP BY 1, 2, 3),
highlights AS (SELECT submission_id, 'e' || row_number() OVER (PARTITION BY submission_id ORDER BY p) AS id, label, refs FROM hl0),
cov AS (SELECT c.submission_id, c.criterion_id, c.criterion, coalesce(string_agg({_REF}, chr(10) ORDER BY rn) FILTER (WHERE k <= 4), '') AS refs,
    CASE count(DISTINCT slide_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'limited' ELSE 'addressed' END AS coverage
  FROM criteria c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY submission_id, criterion_id ORDER BY rn) AS k FROM ce) e USING (submission_id, criterion_id) GROUP BY 1, 2, 3),
asm AS (SELECT submission_id, {duck_round('100 * sum(weight * (greatest(1, least(10, score)) / 10)) FILTER (WHERE assessed) / sum(weight) FILTER (WHERE assessed)')} AS overall_score,
    {duck_round('100 * coalesce(sum(weight) FILTER (WHERE assessed), 0) / sum(weight)')} AS assessed_weight FROM criteria GROUP BY 1),
ii0 AS (SELECT f.*, row_number() OVER (PARTITION BY submission_id ORDER BY page_number, ord) AS number FROM flags f WHERE status IN ({SUSPICIOUS}, {POTENTIAL})),
integ AS (SELECT submission_id, number, 'i' || number AS id, CASE WHEN status = {SUSPICIOUS} THEN replace({quote(_T['integrity_suspicious'])}, '{{where}}', 'Slide ' || page_number)
    ELSE replace({quote(_T['integrity_potential'])}, '{{where}}', 'Slide ' || page_number) END AS title,
    detail || CASE WHEN withheld_from_ai THEN {quote(_T['integrity_withheld'])} ELSE '' END || {quote(_T['integrity_tail'])} AS description,
    CASE WHEN status = {SUSPICIOUS} THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN excerpt = '' THEN '' ELSE slide_id || '|' || {cut('excerpt', 200)} || '|' || CASE WHEN location = 'speaker_notes' THEN 'speaker_notes' ELSE 'text' END END AS refs FROM ii0),
listed AS (SELECT submission_id, 0 AS part, number, id, title, type, severity, refs FROM (SELECT *, 'integrity' AS type FROM integ)
  UNION ALL SELECT submission_id, 1, ord + 1, id, title, type, severity, refs FROM verify WHERE ord < 7),
ev0 AS (SELECT submission_id, 'evidence:' || id AS finding_key, refs FROM highlights UNION ALL SELECT submission_id, 'strength:' || id, refs FROM strengths
  UNION ALL SELECT submission_id, 'verify:' || id, refs FROM listed
  UNION ALL SELECT submission_id, 'criterion:' || criterion_id, string_agg({_REF}, chr(10) ORDER BY rn) FROM ce GROUP BY submission_id, criterion_id),
evidence AS (SELECT submission_id, finding_key, unnest(string_split(refs, chr(10))) AS ref FROM ev0 WHERE refs <> '')"""


def deck_sql(select: str, *stages: str, decks: str | None = None) -> str:
    return (decks or duck_decks()).rstrip() + "," + ",".join(stages) + "\n" + select

