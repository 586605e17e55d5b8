"""Schemas of the stage contracts, and what a model may fill of them."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
L = T.ArrayType

EVIDENCE_REF = _struct(slide_id=S, excerpt=S, page_number=I, verified=B, via=S)
REFS = L(EVIDENCE_REF)
TOPIC = _struct(topic=S, label=S, evidence=REFS)
CLAIM = _struct(id=S, text=S, category=S, evidence=REFS, supporting_evidence_found=B)
EXTRACTION = _struct(overview=S, target_users=S, topics=L(TOPIC), claims=L(CLAIM))
ISSUE = _struct(type=S, description=S, severity=S)
CRITERION = _struct(
    criterion_id=I, criterion=S, assessed=B, finding=S, evidence=REFS, issues=L(ISSUE), score=D, not_assessed_reason=S
)
RUBRIC_ANALYSIS = _struct(criteria=L(CRITERION))
VERIFY_ITEM = _struct(
    id=S, title=S, description=S, type=S, severity=S, evidence=REFS, label=S, related_criteria=L(S)
)
VERIFICATION = _struct(items=L(VERIFY_ITEM))
STRENGTH = _struct(id=S, text=S, evidence=REFS)
BRIEF_WRITER = _struct(overview=S, strengths=L(STRENGTH), verify_order=L(S))
INTEGRITY_FLAG = _struct(
    slide_id=S, type=S, status=S, location=S, excerpt=S, detail=S, withheld_from_ai=B
)
NOT_ASSESSED_ITEM = _struct(area=S, reason=S, slide_id=S)
SOURCE_LOCATION = _struct(kind=S, value=S)
EVIDENCE_UNIT = _struct(
    slide_id=S, page_number=I, source_type=S, source_location=SOURCE_LOCATION, title=S, text=S, speaker_notes=S,
    image_path=S, ocr_text=S, ocr_status=S, has_visual_content=B, links=L(S), integrity_flags=L(INTEGRITY_FLAG),
    processing_notes=L(S),
)
INTEGRITY_REPORT = _struct(status=S, summary=S, flags=L(INTEGRITY_FLAG), method=S, limitations=S)
EVIDENCE_PACK = _struct(
    schema_version=S, submission_id=T.LongType(), source_file=S, file_type=S, page_count=I, units=L(EVIDENCE_UNIT),
    not_assessed=L(NOT_ASSESSED_ITEM), integrity=INTEGRITY_REPORT, processing_status=S,
    ingestion=T.MapType(S, S), created_at=T.TimestampType(),
)
HIGHLIGHT = _struct(id=S, label=S, evidence=REFS)
COVERAGE = _struct(criterion_id=I, criterion=S, evidence=REFS, coverage=S)
PROVENANCE = _struct(engine=S, model=S, pipeline_version=S, stages=L(S), note=S)
INTEGRITY_SUMMARY = _struct(status=S, message=S, flags=L(INTEGRITY_FLAG), limitations=S)
JUDGE_BRIEF = _struct(
    overview=S, target_users=S, evidence_highlights=L(HIGHLIGHT), strengths=L(STRENGTH), verify_these=L(VERIFY_ITEM),
    not_assessed=L(NOT_ASSESSED_ITEM), integrity=INTEGRITY_SUMMARY, rubric_coverage=L(COVERAGE), provenance=PROVENANCE,
)
AI_ASSESSMENT = _struct(
    label=S, score_scale_max=I, overall_score=D, assessed_weight=D, criteria=L(CRITERION), engine=S, model=S
)

# Filled by grounding, never by a model.
SERVER_ONLY = {"page_number", "verified", "via"}

# Optional fields of the contracts: may be null in an answer.
OPTIONAL = {"target_users", "score", "not_assessed_reason", "label", "related_criteria"}

# Closed value sets of the contracts.
ALLOWED = {
    ("claims", "category"): {"quantitative", "technical", "market", "business", "impact", "novelty", "other"},
    ("issues", "type"): {
        "unsupported_claim", "feasibility_gap", "missing_information", "potential_similarity", "inconsistency", "unclear",
    },
    ("items", "type"): {
        "unsupported_claim", "feasibility_gap", "missing_information", "potential_similarity", "inconsistency", "integrity",
    },
    ("issues", "severity"): {"low", "medium", "high"},
    ("items", "severity"): {"low", "medium", "high"},
}


def model_contract(schema: T.DataType) -> T.DataType:
    """The part of a contract a model fills: server-only fields dropped, everywhere required."""
    if isinstance(schema, T.StructType):
        return T.StructType([
            T.StructField(f.name, model_contract(f.dataType), f.name in OPTIONAL)
            for f in schema.fields if f.name not in SERVER_ONLY
        ])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(model_contract(schema.elementType), containsNull=False)
    return schema


CONTRACTS = {
    "evidence_pack": EVIDENCE_PACK,
    "judge_brief": JUDGE_BRIEF,
    "ai_assessment": AI_ASSESSMENT,
    "model_extraction": model_contract(EXTRACTION),
    "model_rubric_analysis": model_contract(RUBRIC_ANALYSIS),
    "model_verification": model_contract(VERIFICATION),
    "model_brief_writer": model_contract(BRIEF_WRITER),
}
