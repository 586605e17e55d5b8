"""Fixed values.

Everything in this module is a constant that results depend on: patterns, word
lists, thresholds, label dictionaries and message wording.  They are stated
plainly and together; the operators hold no literals of their own.
"""

# ---------------------------------------------------------------------------
# Enumerations and thresholds
# ---------------------------------------------------------------------------

INTEGRITY_SEVERITY = {
    "no_discrepancy_detected": 0,
    "potential_discrepancy": 1,
    "manual_review_required": 2,
    "suspicious_instruction_detected": 3,
}

MATCH_THRESHOLD = 62        # line against rendered text
WITHHELD_THRESHOLD = 90     # line against a withheld excerpt
IMAGE_TEXT_THRESHOLD = 80   # rendered line against the text layer
EXCERPT_THRESHOLD = 85      # cited excerpt against its source
MIN_LINE_CHARS = 14
MIN_LINE_WORDS = 3
MIN_WITHHELD_CHARS = 8
MIN_IMAGE_LINE_CHARS = 4
BENIGN_MIN_LINES = 2
BENIGN_MIN_SHARE = 0.25
VISUAL_WORD_LIMIT = 25
TITLE_LIMIT = 200
TITLE_SIZE_STEP = 0.5
PDF_TINY_FONT_PT = 3.0
SLIDE_TINY_FONT_PT = 4.0
LOW_CONTRAST_RATIO = 1.35
MAX_REFS_PER_TOPIC = 3
MAX_VERIFY_ITEMS = 8
MAX_STRENGTHS = 6
MAX_ORDERED_VERIFY = 7
VERIFY_ORDER_LIMIT = 6
SPREAD_THRESHOLD = 15.0
RECENT_EVENTS = 8
AUDIT_PAGE_LIMIT = 500
RECOMMENDATIONS = ["advance", "discuss", "do_not_advance"]
WITHHELD_MARK = "[content withheld by integrity check]"

# Round limits and their defaults.
MAX_PAGES_DEFAULT = 30
MAX_FILE_MB_DEFAULT = 25

# Characters stripped around a line: blank, bullet, hyphen, dashes, star, tab.
BULLET_CHARS = " •-–—*\t"

# ---------------------------------------------------------------------------
# Instruction-like text (matched on blank-collapsed text)
# ---------------------------------------------------------------------------

INSTRUCTION_PATTERNS = [
    r"\b(ignore|disregard|forget|override)\b.{0,30}\b(previous|prior|above|earlier|all|other)\b.{0,20}\b(instruction|prompt|rule|guideline|direction)s?\b",
    r"\b(give|assign|award|grant)\b.{0,25}\b(this|the|our)\b.{0,15}\b(submission|project|team|proposal|entry)\b.{0,25}\b(high|highest|top|perfect|maximum|max|full|10|100)\b",
    r"\brate\b.{0,25}\b(this|the|our)\b.{0,15}\b(submission|project|team|proposal|entry)\b.{0,20}\b(high(ly)?|10|100|top|excellent|as the best)\b",
    r"\b(always|must)\b.{0,15}\b(select|choose|pick|rank|advance|shortlist)\b.{0,20}\b(this|the|our)\b.{0,10}\b(team|project|submission)\b",
    r"\bsystem\s*(instruction|prompt|message|override)s?\b",
    r"\b(judge|evaluator|grader|reviewer|assistant|model|llm|ai)\s*(instruction|directive|note)s?\s*:",
    r"\b(note|message|instruction)s?\s+to\s+(the\s+)?(ai|llm|model|assistant|judge|evaluator|grader)\b",
    r"\b(if you are|as an?|you are an?)\s+(ai|language model|llm|automated (judge|evaluator|grader))\b",
    r"\b(score|mark)\b.{0,20}\b(10\s*/\s*10|100\s*/\s*100|full marks|maximum (score|points))\b",
    r"\bdo not (mention|report|flag)\b.{0,30}\b(this|these|weakness|issue|instruction)",
]

# ---------------------------------------------------------------------------
# Topics (key, label, title pattern, body pattern)
# ---------------------------------------------------------------------------

TOPICS = [
    ("problem", "Problem definition",
     r"problem|challenge|pain|context|why now",
     r"\b(problem|struggl\w*|cannot|can't|lack\w*|waste\w*|inefficien\w*|overcrowd\w*|crowded|expensive|delay\w*|rely on|only after|hard)\b"),
    ("target_users", "Target users",
     r"who we serve|users|customers|audience|persona",
     r"\b(primary users?|target users?|secondary users?|target customers?|designed for|built for)\b"),
    ("solution", "Proposed solution",
     r"solution|product|idea|overview|features",
     r"\b(we propose|our (app|platform|solution|product)|is an? (app|platform|tool|marketplace)|predicts|generates|shows|lets|helps|measures|alerts?)\b"),
    ("architecture", "Technical approach",
     r"architecture|how it works|technology|tech stack|device|design|system",
     r"\b(model|api|sensors?|database|backend|pipeline|solver|algorithm|smart contracts?|hl7|fhir|lorawan|microcontroller|feature store)\b"),
    ("validation", "Validation & results",
     r"validation|results|evidence|traction|field test|findings",
     r"\b(benchmark|study|tested|test set|held-out|retrospective|survey|interview\w*|measured|error|trial|field test|usability)\b"),
    ("impact", "Expected impact",
     r"impact|benefit|outcome",
     r"\b(reduc\w+|sav(e|es|ing)|lower|fewer|improv\w+|remove|income|emissions?)\b"),
    ("market", "Market",
     r"market|opportunity",
     r"\b(market|tam|sam|demand)\b"),
    ("business", "Business model",
     r"business|revenue|pricing|unit cost|monetiz",
     r"\b(licen[cs]e|subscription|fee|pricing|priced|revenue|saas|per unit|target price)\b"),
    ("competition", "Existing alternatives",
     r"competit|alternative|landscape|comparison",
     r"\b(competitors?|alternatives?|existing (solutions?|tools?|products?)|unlike|compared (to|with)|differentiat\w+)\b"),
    ("scalability", "Scaling plan",
     r"scal|growth|expansion|rollout",
     r"\b(scale|scaling|citywide|regional|nationwide|expand\w*|rollout|network of \d+)\b"),
    ("plan", "Implementation plan",
     r"plan|roadmap|timeline|next steps|deployment|milestone",
     r"\b(phase \d|q[1-4]\b|roadmap|milestone|will deploy|deploy\w*)\b"),
    ("team", "Team",
     r"^team|about us|who we are|team$",
     r"\b(engineers?|developers?|scientists?|founders?|advisors?|nurse|researchers?)\b"),
]

WEAK_TOPICS = ["problem", "solution"]

HIGHLIGHT_ORDER = [
    "problem", "target_users", "solution", "architecture", "validation", "impact",
    "business", "competition", "scalability", "plan",
]

# Criterion wording -> topics that count as evidence for it.
CRITERION_HINTS = [
    (r"problem|need|pain|understand", ["problem", "target_users"]),
    (r"innovat|novel|original|creativ|unique|differentiat", ["solution", "competition"]),
    (r"technical|feasib|implement|architect|engineering|execution", ["architecture", "validation", "plan"]),
    (r"impact|benefit|social|environment|outcome", ["impact", "validation"]),
    (r"scal|growth|expan|rollout", ["scalability", "business", "plan"]),
    (r"business|market|commercial|viab|revenue|sustainab", ["business", "market"]),
    (r"team|capab", ["team"]),
    (r"user|design|ux|usab|experience", ["target_users", "solution", "validation"]),
]

# Claim category -> topics it bears on.
CLAIM_TOPICS = {
    "impact": ["impact"],
    "technical": ["architecture"],
    "business": ["business"],
    "market": ["business", "market", "scalability"],
    "novelty": ["solution", "competition"],
    "quantitative": ["impact"],
}

# ---------------------------------------------------------------------------
# claims
# ---------------------------------------------------------------------------

QUANTITY_PATTERNS = [
    r"\b\d+(\.\d+)?\s?%",
    r"[$€£]\s?\d",
    r"\b\d+(\.\d+)?\s?x\b|\b\d+ times (faster|cheaper|more|better)",
    r"\b(reduc\w*|cut\w*|sav\w*|increas\w*|improv\w*|lower\w*|remov\w*|eliminat\w*|doubl\w*|tripl\w*)\b[^.]{0,40}\b\d",
    r"\b\d[\d,.]*\s*(million|billion|thousand)?\s*(tonnes|tons|farms|users|customers|patients|students|households|villages|lives)\b",
    r"\b\d+\s*(years?|months?)\b[^.]{0,30}\b(battery|charge)|\b(battery|charge)\b[^.]{0,30}\b\d+\s*(years?|months?)",
]
NOVELTY_PATTERN = (
    r"\b(world'?s first|first[- ]ever|the first (platform|solution|app|company|tool|marketplace|to)\b"
    r"|the only (platform|solution|app|tool)|revolutioni[sz]\w*|unprecedented|guarantee\w*|100% accurate)"
)
PLAN_PATTERN = r"^(phase \d|q[1-4]\b|step \d|stage \d|year \d)|\b(will deploy|plan to|we plan|roadmap)\b"
TARGET_PATTERN = r"^(goal|target|aim|objective)s?\b|\b(our goal|we aim)\b"
SUPPORT_PATTERN = (
    r"\b(survey\w*|interview\w*|study|studies|pilot results|measured|benchmark\w*|tested|test set|held-out|"
    r"retrospective|trial|experiment\w*|data from|according to|source:|report|n\s?=\s?\d|usability)\b"
)
PRICING_PATTERN = r"\b(fee|target price|priced|pricing|subscription|licen[cs]e)\b"
CATEGORY_PATTERNS = [
    ("business", r"\b(costs? \$|per unit|in parts)\b"),
    ("market", r"\bmarket|revenue|customers|\$\s?\d+\s?(b|bn|billion|m|million)\b"),
    ("technical", r"\b(battery|sensor|accuracy|latency|model|error|uptime)\b"),
    ("impact", r"\b(reduc\w*|sav\w*|fewer|lower|remov\w*|emission\w*|co2|wait|cost\w*|income|onboard)\b"),
]
TARGET_USER_PATTERN = r"\b(primary users?|target users?|target customers?|designed for|built for)\b[:\s]"
GOAL_PREFIX_PATTERN = r"^(goal|target|aim|objective)s?\s*:\s*"

# ---------------------------------------------------------------------------
# Dependencies (key, title, mention, explanation, severity, wording)
# ---------------------------------------------------------------------------

DEPENDENCIES = [
    ("hardware", "Technical feasibility: hardware",
     r"\b(sensors?|devices?|hardware|buoy|modem|drones?|iot)\b",
     r"\b(unit cost|per unit|costs? \$|bill of materials|bom|prototype|datasheet|field test\w*|calibrat\w*)\b",
     "medium",
     "The proposal depends on {what}, but hardware cost, specification or field validation is not explained."),
    ("ai_model", "Technical feasibility: AI/ML model",
     r"\b(ai|machine learning|ml|model|algorithm)\b[^.]{0,50}\b(estimat\w*|predict\w*|detect\w*|classif\w*|recogni\w*|personali[sz]\w*|recommend\w*)|\b(uses? ai|ai[- ]powered|ai recommendations)\b",
     r"\b(accuracy|mean absolute error|error of|precision|recall|validated|benchmark\w*|test set|held-out|trained on)\b",
     "medium",
     "The proposal relies on an AI/ML component ({what}), but no accuracy figures, training data or validation are described."),
    ("integration", "Dependency on external partners",
     r"\b(integrat\w+ with|partner (ngo|hospital|organi[sz]ation)|partner\b[^.]{0,20}\bwill|api access)\b",
     r"\b(agreements?|signed|letter of intent|loi|contract|confirmed|memorandum)\b",
     "low",
     "The plan depends on an external party ({what}); the submission does not state whether access or a partnership is confirmed."),
]
HARDWARE_PHRASE = r"([\w-]+\s+)?(sensors?|devices?|hardware|buoy|modem|drones?)"
HARDWARE_FALLBACK = "custom hardware"
DEPENDENCY_QUOTE_LIMIT = 90

APPENDIX_PATTERN = r"\b(appendix|annex|see attached|attached (document|file|sheet))\b"
APPENDIX_TITLE_PATTERN = r"appendix|annex"

#: Characters kept of either end of a unit; the approaches below are named in two words at most.
BORDER_CHARS = 64
COMMON_APPROACHES = [
    (r"route optimi[sz]\w*|routing solver|collection routes", "sensor-driven collection route optimization"),
    (r"marketplace", "online marketplaces for this domain"),
    (r"blockchain|token", "blockchain-based credit or token platforms"),
    (r"wait[- ]times?", "wait-time forecasting and display tools"),
    (r"study|tutor\w*|learning app|students", "study-group and peer-learning apps"),
    (r"water[- ]quality|sensor network", "low-cost environmental sensor networks"),
    (r"chatbot|assistant", "AI chat assistants"),
]

# ---------------------------------------------------------------------------
# Strengths (topic, wording, extra pattern on the excerpt)
# ---------------------------------------------------------------------------

STRENGTH_RULES = [
    ("problem", "Explicit problem statement backed by specific data", r"\d|survey|report|data"),
    ("problem", "Explicit problem statement", None),
    ("target_users", "Clearly defined target users", None),
    ("validation", "Includes validation evidence (tests, benchmarks or user research)", None),
    ("architecture", "Concrete technical approach / implementation workflow described", None),
    ("competition", "Positions the solution against existing alternatives", None),
    ("plan", "Phased implementation plan with milestones", None),
    ("business", "Revenue model or unit economics stated", None),
    ("scalability", "Describes a concrete path to scale", None),
]

ISSUE_PENALTY = {"high": 1.0, "medium": 0.6, "low": 0.3}
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
EVIDENCE_REQUIRED = ["unsupported_claim", "feasibility_gap", "inconsistency"]
SIMILARITY_LABEL = "Potential similarity — human verification required."

# ---------------------------------------------------------------------------
# Message wording
# ---------------------------------------------------------------------------

STRUCTURAL_LABELS = {
    "low_contrast_text": "text colour nearly matches the background",
    "invisible_text_layer": "text is present in the file but set to be invisible",
    "tiny_text": "text is set in an unreadably small font",
    "off_slide_content": "text is positioned outside the visible slide area",
}
SIGNAL_DETAILS = {
    "invisible_mode": "Text uses an invisible render mode.",
    "tiny": "Font size {size}pt.",
    "off_page": "Text is positioned outside the page.",
    "off_slide": "Text box is positioned outside the visible slide.",
    "hidden_shape": "Shape is marked hidden.",
    "low_contrast": "Text colour is nearly identical to the background.",
}
FLAG_DETAILS = {
    "hidden_slide": "Slide is marked hidden and would not be shown during a presentation.",
    "hidden_slide_instruction": " Its text resembles an instruction to evaluators.",
    "structural": "Possible hidden content: {label}.",
    "structural_instruction": " The text resembles an instruction to evaluators.",
    "not_rendered": "The slide could not be rendered",
    "not_read": "The rendered slide could not be read",
    "no_comparison": ", so its text layer could not be compared with what is visible. Please review this slide manually.",
    "note_instruction": "Speaker notes contain text resembling an instruction to evaluators. Notes are not visible on the slide.",
    "hidden_instruction": "Text in the file's text layer was not found on the rendered slide and resembles an instruction to evaluators.",
    "benign": " line(s) of extracted text could not be matched to the rendered slide. This can be caused by OCR limitations and is not necessarily hidden content.",
    "visible_address": "Visible text addresses evaluators directly. It is visible to human judges, so it is not treated as hidden content; shown for awareness only.",
}
REPORT_SUMMARIES = {
    "no_discrepancy_detected": "No hidden-content discrepancy detected.",
    "potential_discrepancy": "Potential hidden/inconsistent content detected on {where}.",
    "suspicious_instruction_detected": "Potential hidden instruction-like text detected on {where}. The flagged text was withheld from AI analysis. Please review the original slide.",
    "no_ocr": "Integrity check incomplete: visual comparison unavailable (no OCR engine). Manual review required.",
    "manual_review_required": "Integrity check could not be completed for {where}. Manual review required.",
}
REPORT_METHOD = (
    "Fuzzy comparison of the text layer against OCR of rendered slides, structural visibility "
    "checks, and a speaker-note scan for instruction-like text."
)
REPORT_LIMITATIONS = (
    "This check compares the document's text layer with the rendered slides and scans "
    "speaker notes. It cannot detect every form of manipulation."
)
WHERE_FALLBACK = "this submission"
RENDER_REASONS = {
    "unavailable": "Rendering unavailable",
    "hidden": "Hidden slide — not rendered",
    "no_page": "No rendered page for this slide",
}
HIDDEN_SLIDE_NOTE = "Slide is marked hidden and is not shown in presentation mode."
NOT_ASSESSED = {
    "hidden": "{label} is marked hidden in the presentation; its content was excluded from AI analysis.",
    "not_rendered": "{label} could not be rendered, so its visual content was not inspected.",
    "visual_read": "{label} is mostly visual (images/diagrams). Text inside images was read with OCR, but diagrams and charts were not interpreted.",
    "visual_unread": "{label} is mostly visual (images/diagrams) and its visual content could not be interpreted.",
    "link": "External content linked on {label} ({host}) could not be accessed. External links, demos and videos are not analyzed in this version.",
    "media": "Embedded media on {label} (video/audio/object) was not analyzed.",
    "document_render_head": "The document could not be rendered to images",
    "document_render_tail": ". Visual content and the visual integrity comparison were not assessed.",
    "document_no_ocr": "No OCR engine is available, so extracted text could not be compared with the rendered slides. Integrity check limited to structural checks.",
}
VIDEO_HOSTS = ["youtube", "youtu.be", "vimeo", "loom"]

UNSUPPORTED_ISSUE = "“{claim}” — no supporting data or method found."
MISSING_COMPETITION_ISSUE = "Existing alternatives and differentiation are not discussed."
NO_EVIDENCE_FINDING = "No slide was found that explicitly addresses {criterion}."
NO_EVIDENCE_REASON = "No explicit evidence located; the rule-based analyzer does not infer a score without evidence."
UNLINKED_REASON = "No verifiable evidence could be linked to this assessment."

VERIFY_TEXT = {
    "target": "This is presented as a goal; no estimate, model or pilot data supporting it was found.",
    "claim": "No supporting experiment, benchmark, data source or calculation was found in the submission for this claim.",
    "novelty": "Novelty/superlative claim with no comparison to existing work. Potential similarity — human verification required.",
    "appendix_title": "Referenced material not included",
    "appendix": "{label} refers to supporting material (e.g. an appendix) that is not part of the submitted file.",
    "differentiation_title": "Differentiation",
    "differentiation_head": "The submission does not compare itself with existing alternatives. ",
    "differentiation_known": "Approaches of this kind ({pattern}) may already exist. ",
    "differentiation_unknown": "Similar approaches may already exist. ",
    "differentiation_tail": "This has not been verified.",
    "missing_title": "Rubric areas without evidence",
    "missing_head": "No slide explicitly addresses: ",
    "missing_tail": ". Check whether the information is present in a form the system could not read.",
    "integrity_suspicious": "Potential hidden instruction-like text on {where}",
    "integrity_potential": "Potential hidden/inconsistent content on {where}",
    "integrity_withheld": " This text was withheld from AI analysis.",
    "integrity_tail": " Open the original slide to check what a presenter would show.",
}
ASSESSMENT_LABEL = "AI-generated assessment — not a final decision."
INTEGRITY_CLEAR_MESSAGE = "✓ No hidden-content discrepancy detected."
INTEGRITY_WARNING_MESSAGE = "⚠ {summary}"
PIPELINE_VERSION = "1.0"
STAGE_NAMES = ["rule-based-extractor", "rule-based-rubric-analyzer", "rule-based-verifier", "rule-based-brief-writer"]
PROVENANCE_NOTE = (
    "Offline rule-based analyzer: locates evidence and flags claims using transparent text rules. "
    "It does not interpret meaning the way a language model would."
)
COMPONENTS = {
    "validator": "magic-bytes+limits",
    "integrity": "text-vs-render-fuzzy-v1",
    "unavailable": "unavailable",
}

DOCUMENT_FAILURE = "Document could not be fully processed. Manual review required."
ATTENTION_REASONS = {
    "processing_failed": "Document could not be processed.",
    "partial": "Partially assessed: some content could not be processed. Judges should review those parts of the original.",
    "integrity": "Integrity warning",
    "unassigned": "No judges assigned yet — every submission needs human review.",
    "ai_failed": "AI analysis unavailable. Human review can continue.",
}
ATTENTION_ORDER = ["processing_failed", "integrity", "ai_failed", "unassigned", "partial"]
ATTENTION_STATUSES = ["potential_discrepancy", "suspicious_instruction_detected", "manual_review_required"]

COMMENT_LIMIT = 4000
# Zip archives: end record, directory entries, and the parts that make a slide deck.
ZIP_END_REACH = 65_557
ZIP_END_MARK = "PK\x05\x06"
ZIP_ENTRY_MARK = "PK\x01\x02"
ZIP_CONTENT_TYPES = "(?s)PK\x01\x02.{24}\x13\x00.{16}\\[Content_Types\\]\\.xml"
ZIP_DECK_PART = "(?s)PK\x01\x02.{42}ppt/"
SCORE_ERRORS = {
    "unknown": "Unknown criterion {criterion}",
    "range": "Scores must be between 1 and {scale}",
    "step": "Scores must be whole or half points",
    "missing": "Please score every criterion (missing: {names})",
}
RUBRIC_ERRORS = {
    "empty": "Define at least one criterion",
    "total": "Criterion weights must add up to 100% (currently {total}%)",
    "names": "Criterion names must be unique",
}
FINALIZE_ERRORS = {
    "no_evaluation": "Submit your evaluation first.",
    "no_reveal": "Review the AI assessment before finishing.",
    "done": "This evaluation is already complete.",
    "no_scores": "Provide revised scores.",
}
ASSIGN_ERRORS = {
    "submission": "Submission not found",
    "judge": "Judge not found",
    "taken": "Judge is already assigned to this submission",
    "started": "The judge has already started this review.",
}
INTAKE_ERRORS = {
    "closed": "This round is closed to new submissions.",
    "full": "This round accepts at most {limit} submissions.",
    "extension": "Unsupported file type. Allowed: {allowed}.",
    "round_size": "File exceeds the {limit} MB limit for this round.",
    "size": "File is {size} MB; this round accepts files up to {limit} MB.",
    "empty": "File is empty.",
    "unknown": "Unsupported or unreadable file. Upload a PDF or PowerPoint (.pptx) file.",
    "type": "This round does not accept .{detected} files.",
    "mismatch": "File extension .{ext} does not match its contents ({detected}).",
    "pages": "Submission has {pages} pages; this round allows at most {limit}.",
}

# ---------------------------------------------------------------------------
# Display labels
# ---------------------------------------------------------------------------

INTEGRITY_LABELS = {
    "no_discrepancy_detected": "Integrity check: no issue detected",
    "potential_discrepancy": "Integrity review required",
    "suspicious_instruction_detected": "Integrity review required",
    "manual_review_required": "Manual review required",
}
ASSIGNMENT_LABELS = {
    "assigned": "Not started",
    "in_progress": "In review",
    "submitted": "Submitted · compare with AI",
    "completed": "Completed",
}
SEVERITY_LABELS = {"high": "High priority", "medium": "Medium priority", "low": "Low priority"}
VERIFY_TYPE_LABELS = {
    "unsupported_claim": "Unsupported claim",
    "feasibility_gap": "Feasibility",
    "missing_information": "Missing information",
    "potential_similarity": "Differentiation",
    "inconsistency": "Inconsistency",
    "integrity": "Integrity",
}
RECOMMENDATION_LABELS = {"advance": "Advance", "discuss": "Discuss", "do_not_advance": "Do not advance"}
DIRECTION_LABELS = {
    "no_change": "No change",
    "toward_ai": "Moved toward AI",
    "away_from_ai": "Moved away from AI",
    "ai_unavailable": "AI unavailable",
}
STAGE_LABELS = {
    "queued": "Queued",
    "validating": "Validating file",
    "parsing": "Extracting text",
    "rendering": "Rendering slides",
    "ocr": "Reading rendered slides",
    "integrity": "Integrity check",
    "ai_analysis": "Preparing brief",
}
ACTION_LABELS = {
    "auth.login": "Signed in",
    "round.created": "Created round",
    "round.updated": "Updated round settings",
    "rubric.updated": "Updated rubric",
    "submission.uploaded": "Uploaded submission",
    "submission.ingestion_started": "Started document processing",
    "submission.ingested": "Processed document (evidence pack created)",
    "submission.ingestion_failed": "Document processing failed",
    "submission.reprocess_requested": "Requested reprocessing",
    "integrity.flagged": "Integrity check raised a warning",
    "analysis.completed": "Generated judge brief",
    "analysis.failed": "AI analysis failed",
    "assignment.created": "Assigned judge",
    "assignment.removed": "Removed judge assignment",
    "judge.invited": "Added judge",
    "review.opened": "Opened review",
    "finding.responded": "Responded to AI finding",
    "evaluation.submitted": "Submitted independent evaluation",
    "ai.revealed": "Revealed AI assessment",
    "evaluation.kept": "Kept original score",
    "evaluation.revised": "Revised score after AI reveal",
    "results.exported": "Exported anchoring data",
}
ACTION_FILTERS = {
    "submission": "Submissions & processing",
    "analysis": "AI analysis",
    "integrity": "Integrity",
    "assignment": "Assignments",
    "review": "Reviews opened",
    "finding": "Responses to AI findings",
    "evaluation": "Evaluations & revisions",
    "ai.revealed": "AI reveals",
    "rubric": "Rubric changes",
}
ALL_ACTIONS_LABEL = "All events"

SHIFT_COLUMNS = [
    "round_id", "submission_id", "team_name", "judge_id", "judge_name", "opened_at", "submitted_at",
    "revealed_at", "finalized_at", "review_minutes", "human_initial_score", "ai_score", "human_revised_score",
    "decision", "revision_reason", "initial_to_ai_difference", "initial_to_revised_difference",
    "revision_direction", "seconds_since_reveal", "recommendation",
]
