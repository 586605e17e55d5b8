"""Review entities derived from the order tables.

Rounds come from nations, judges from customers, submissions and assignments
from orders (three assignments per submission), scores from line items and the
audit log from events.  Every entity grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.plans.catalog import read, read_spread
from docketflow.plans.dialect import case_of, to_duck, to_spark

_STATUS = (
    "CASE WHEN o_orderkey % 31 = 5 THEN 'assigned' WHEN o_orderkey % 37 = 1 AND o_orderstatus = 'F' THEN 'submitted' "
    "WHEN (o_orderkey IDIV 3) % 4 = 0 OR o_orderstatus = 'F' THEN 'completed' "
    "WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'submitted' "
    "WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'assigned' END"
)
_PRICE = "CAST(FLOOR(o_totalprice) AS BIGINT)"
_INITIAL = f"({_PRICE} % 901 + 100)"
_MACHINE = "(CAST(FLOOR(o_totalprice / 7) AS BIGINT) % 901 + 100)"
_MOVE = "(CASE WHEN o_orderkey % 3 = 1 THEN (o_custkey % 11 - 5) * 10 ELSE 0 END)"
_OPENED = "US[o_orderdate] + 3600000000"
_SUBMITTED = f"US[o_orderdate] + 3600000000 + ({_PRICE} % 7200) * 1000000"
_HAS_AI = "o_orderpriority <> '1-URGENT'"
_TEN = "CAST(10 AS DOUBLE)"

_RUBRIC = [
    (1, "Problem fit", 20), (2, "Novelty", 25), (3, "Technical execution", 20),
    (4, "Impact", 20), (5, "Scalability", 15),
]

ENTITIES: dict[str, tuple[list[str], str]] = {
    "rounds": (["nation"], """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS organization_id, n_name AS name,
          CASE n_nationkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'draft' ELSE 'open' END AS status,
          50 AS score_scale_max, CASE WHEN n_nationkey % 3 = 0 THEN 150 END AS max_submissions,
          CASE WHEN n_nationkey % 5 = 0 THEN 'pdf' ELSE 'pdf,pptx' END AS types,
          10 AS max_file_size_mb, 5 AS max_pages, 3 + n_nationkey % 2 AS judges_per_submission,
          TS(1700000000000000 + (n_nationkey * 7 % 11) * 86400000000) AS created_at
        FROM nation"""),
    "rubric": (["nation"], " UNION ALL ".join(
        f"""SELECT CAST(n_nationkey AS BIGINT) AS round_id, CAST({cid} AS BIGINT) AS criterion_id, {cid - 1} AS position,
          {"CASE WHEN n_nationkey % 7 = 6 THEN ' novelty' ELSE '" + name + "' END" if cid == 5 else "'" + name + "'"}
            AS name,
          CAST({"CASE WHEN n_nationkey % 6 = 5 THEN 10 ELSE 20 END" if cid == 1 else weight} AS DOUBLE) AS weight
        FROM nation""" for cid, name, weight in _RUBRIC)),
    "users": (["customer"], """
        SELECT c_custkey AS id, CAST(c_nationkey % 5 AS BIGINT) AS organization_id, c_name AS name,
          CASE WHEN c_custkey % 50 = 0 THEN 'organizer' ELSE 'judge' END AS role,
          c_acctbal > 0 AS is_active, c_mktsegment AS title
        FROM customer"""),
    "submissions": (["orders"], f"""
        SELECT o_orderkey IDIV 3 AS id, (o_orderkey IDIV 3) % 25 AS round_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'Team ' ELSE 'team ' END || CAST(o_custkey AS STRING) AS team_name,
          'Deck ' || CAST(o_orderkey AS STRING) AS title,
          CASE WHEN o_orderkey % 17 = 0 THEN 'processing_failed' WHEN o_orderkey % 11 = 0 THEN 'partially_processed'
            WHEN o_orderkey % 13 = 0 THEN 'processing' WHEN o_orderkey % 29 = 0 THEN 'uploaded' ELSE 'ready' END AS status,
          CASE WHEN o_orderkey % 34 = 0 THEN 'Unreadable file' WHEN o_orderkey % 17 = 0 THEN '' END AS processing_error,
          {case_of("o_custkey % 4", list(V.INTEGRITY_SEVERITY))} AS integrity_status,
          CASE WHEN o_custkey % 3 = 0 THEN 'Summary ' || CAST(o_custkey AS STRING) END AS integrity_summary,
          CAST(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 5 ELSE 0 END AS INT) AS not_assessed_count,
          TS(US[o_orderdate]) AS created_at
        FROM orders WHERE o_orderkey % 3 = 0"""),
    "files": (["orders"], f"""
        SELECT o_orderkey AS id, o_orderkey IDIV 3 AS submission_id,
          'deck_' || CAST(o_orderkey AS STRING) || '.pdf' AS original_filename, 'pdf' AS file_type,
          {_PRICE} AS size_bytes, CAST(o_custkey % 30 + 1 AS INT) AS page_count
        FROM orders"""),
    "analyses": (["orders"], f"""
        SELECT o_orderkey AS id, o_orderkey IDIV 3 AS submission_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '5-LOW' THEN 'running' ELSE 'completed' END AS status,
          {_MACHINE} / {_TEN} AS ai_overall_score, 'rule-based' AS engine, '1.0' AS pipeline_version,
          CASE WHEN o_custkey % 3 = 0 THEN 'high,medium,high' WHEN o_custkey % 3 = 1 THEN 'low' ELSE '' END AS severities
        FROM orders"""),
    "assignments": (["orders"], f"""
        SELECT o_orderkey AS assignment_id, o_orderkey IDIV 3 AS submission_id, (o_orderkey IDIV 3) % 25 AS round_id,
          o_custkey AS judge_id, status, TS(US[o_orderdate]) AS assigned_at,
          CASE WHEN status <> 'assigned' THEN TS({_OPENED}) END AS opened_at,
          CASE WHEN status IN ('submitted', 'completed') THEN TS({_SUBMITTED}) END AS submitted_at,
          CASE WHEN status = 'completed' THEN TS({_SUBMITTED} + 600000000) END AS completed_at
        FROM (SELECT *, {_STATUS} AS status FROM orders) o"""),
    "evaluations": (["orders"], f"""
        SELECT o_orderkey AS assignment_id, {_INITIAL} / {_TEN} AS weighted_score,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'advance' WHEN '2-HIGH' THEN 'discuss'
            WHEN '3-MEDIUM' THEN 'do_not_advance' WHEN '4-NOT SPECIFIED' THEN 'advance' END AS recommendation,
          TS({_SUBMITTED}) AS submitted_at
        FROM (SELECT *, {_STATUS} AS status FROM orders) o WHERE status IN ('submitted', 'completed')"""),
    "reveals": (["orders"], f"""
        SELECT o_orderkey AS assignment_id, {_HAS_AI} AS ai_available,
          CASE WHEN {_HAS_AI} THEN {_MACHINE} / {_TEN} END AS ai_score_shown,
          TS({_SUBMITTED} + 60000000) AS revealed_at
        FROM (SELECT *, {_STATUS} AS status FROM orders) o
        WHERE status = 'completed' OR (status = 'submitted' AND o_orderkey % 4 = 0)"""),
    "revisions": (["orders"], f"""
        SELECT o_orderkey AS assignment_id, CASE WHEN o_orderkey % 3 = 1 THEN 'revised' ELSE 'kept' END AS decision,
          {_INITIAL} / {_TEN} AS human_initial_score,
          CASE WHEN {_HAS_AI} THEN {_MACHINE} / {_TEN} END AS ai_score,
          ({_INITIAL} + {_MOVE}) / {_TEN} AS human_revised_score,
          'reason ' || CAST(o_custkey AS STRING) AS revision_reason,
          CASE WHEN {_HAS_AI} THEN ({_MACHINE} - {_INITIAL}) / {_TEN} END AS initial_to_ai_difference,
          {_MOVE} / {_TEN} AS initial_to_revised_difference,
          CASE WHEN NOT ({_HAS_AI}) THEN 'ai_unavailable' WHEN {_MOVE} = 0 THEN 'no_change'
            WHEN SIGN({_MOVE}) = SIGN({_MACHINE} - {_INITIAL}) THEN 'toward_ai' ELSE 'away_from_ai' END
            AS revision_direction,
          CAST(540 AS DOUBLE) AS seconds_since_reveal,
          TS({_SUBMITTED} + 600000000) AS created_at
        FROM (SELECT *, {_STATUS} AS status FROM orders) o WHERE status = 'completed'"""),
    "scores": (["lineitem"], """
        SELECT l_orderkey AS assignment_id, CAST(l_linenumber AS BIGINT) AS criterion_id, l_quantity AS score,
          l_extendedprice AS price, l_partkey, l_suppkey, US[l_shipdate] AS shipped, l_discount, l_tax,
          '  ' || l_returnflag || ' ' || l_linestatus || ' ' AS comment
        FROM lineitem"""),
    "audit": (["events"], f"""
        SELECT event_id AS id, CAST(NULL AS BIGINT) AS organization_id, user_id % 25 AS round_id,
          event_id % 400 AS submission_id, user_id AS actor_id,
          {case_of("event_id % 22", list(V.ACTION_LABELS))} AS action,
          'assignment' AS entity_type, (event_id * 7 + user_id) % 997 AS entity_id, props AS details,
          TS(US[ts]) AS created_at, event_type, value
        FROM events"""),
    "responses": (["events"], """
        SELECT event_id AS id, user_id AS assignment_id, 'f' || CAST(event_id % 9 AS STRING) AS finding_key,
          CASE event_id % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' ELSE 'unsure' END AS response,
          ' note ' || CAST(event_id % 5 AS STRING) || ' ' AS note, TS(US[ts]) AS updated_at
        FROM events"""),
}


def entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables, sql = ENTITIES[name]
    sources = {
        t: read_spread(spark, folder, t) if t == "lineitem" else read(spark, folder, t) for t in tables
    }
    text = to_spark(sql)
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    df = spark.sql(text, **sources)
    if name == "scores":
        # Line items have no sequence number; this order makes "last wins" definite.
        df = df.withColumn(
            "ord", F.struct("shipped", "price", "l_partkey", "l_suppkey", "l_discount", "l_tax", "score")
        )
    if name == "rounds":
        df = df.withColumn("allowed_file_types", F.split("types", ",")).drop("types")
    if name == "analyses":
        df = df.withColumn(
            "verify_these",
            F.transform(F.filter(F.split("severities", ","), lambda s: s != ""), lambda s: F.struct(s.alias("severity"))),
        )
    return df


def duck_entities(*names: str) -> str:
    """``WITH`` prefix that defines the entities for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({to_duck(ENTITIES[n][1])})" for n in names) + "\n"
