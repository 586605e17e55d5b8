"""Uploaded files: digest, content type, validation, round intake, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import fixed_values as V
from docketflow.functions.numeric import one_decimal
from docketflow.functions.text import fill, strip
from docketflow.operators.skew import first_per_group_salted

_MB = 1024 * 1024


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of every file below ``path``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )


def with_content(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """uploads(path, …) + content.  File scans skip empty files, so those have no row: their content is empty."""
    return uploads.join(files.select("path", "content"), "path", "left").withColumn(
        "content", F.coalesce("content", F.lit(b""))
    )


def file_digests(files: DataFrame) -> DataFrame:
    """files + size_bytes, sha256; the content itself is dropped."""
    kept = [c for c in files.columns if c not in ("content", "length")]
    return files.select(
        *kept,
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


def _little_endian(raw: Column, at: Column, size: int) -> Column:
    """An unsigned number of ``size`` bytes, lowest first, at position ``at`` (from 1)."""
    digits = F.hex(F.substr(raw, at, F.lit(size)))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("bigint")


def _is_slide_archive(content: Column) -> Column:
    """Whether a zip archive lists the parts of a slide deck; only its directory, at its end, is looked at.

    The end record (within the last 64 KiB) says how long the directory before it
    is; a directory entry is a mark, 42 bytes and the file's name.  Archives
    beyond 4 GiB use another record and count as unknown.
    """
    size = F.octet_length(content)
    reach = F.least(size, F.lit(V.ZIP_END_REACH))
    tail = F.decode(F.substr(content, size - reach + 1, reach), "ISO-8859-1")
    before = F.regexp_extract(tail, "(?s)^(.*)" + V.ZIP_END_MARK + ".{18}", 1)
    found = tail.rlike("(?s)" + V.ZIP_END_MARK + ".{18}")
    end = size - reach + F.length(before) + 1  # of the end record, from 1
    length = _little_endian(content, end + 12, 4)
    listing = F.decode(F.substr(content, (end - length).cast("int"), length.cast("int")), "ISO-8859-1")
    inside = found & (length > 0) & (length < end)
    return F.coalesce(F.when(inside, F.startswith(listing, F.lit(V.ZIP_ENTRY_MARK)) & listing.rlike(V.ZIP_CONTENT_TYPES) & listing.rlike(V.ZIP_DECK_PART)), F.lit(False))


def sniff_file_type(files: DataFrame) -> DataFrame:
    """files + file_type {pdf,pptx,null}, decided by content with binary functions only."""
    is_pdf = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    is_zip = F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")
    return files.withColumn(
        "file_type", F.when(is_pdf, "pdf").when(is_zip & _is_slide_archive(F.col("content")), "pptx"))


def base_name(name: Column) -> Column:
    return F.substring(F.regexp_extract(name, r"([^/]*)/*$", 1), 1, 300)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(name), r"[^/]\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=[^/])\.[^./]+$", "")


def clean_titles(uploads: DataFrame) -> DataFrame:
    """Trim team names; an empty title becomes the file name without its extension."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), stem(F.col("original_filename")))
    return uploads.withColumn("team_name", strip(F.col("team_name"))).withColumn("title", strip(title))


def validate_files(files: DataFrame, rounds: DataFrame) -> DataFrame:
    """files(round_id, original_filename, size_bytes, file_type, …) + reject_reason.

    The first failing rule names the reason.
    """
    limits = rounds.select(
        F.col("id").alias("round_id"),
        F.coalesce("max_file_size_mb", F.lit(V.MAX_FILE_MB_DEFAULT)).alias("_mb"),
        F.coalesce("allowed_file_types", F.array(F.lit("pdf"), F.lit("pptx"))).alias("_types"),
    )
    size, kind, ext = F.col("size_bytes"), F.col("file_type"), extension(F.col("original_filename"))
    E = V.INTAKE_ERRORS
    reason = (
        F.when(size / _MB > F.col("_mb"),
               fill(E["size"], size=one_decimal(size / _MB), limit=F.col("_mb")))
        .when(size == 0, E["empty"])
        .when(kind.isNull(), E["unknown"])
        .when(~F.array_contains("_types", kind), fill(E["type"], detected=kind))
        .when((ext != "") & (ext != kind), fill(E["mismatch"], ext=ext, detected=F.upper(kind)))
    )
    return files.join(limits, "round_id").withColumn("reject_reason", reason).drop("_mb", "_types")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)"""
    return checked.filter("reject_reason is null").drop("reject_reason"), checked.filter("reject_reason is not null")


def check_page_limit(units: DataFrame, submissions: DataFrame, rounds: DataFrame) -> DataFrame:
    """submission_id, page_count, reject_reason (null when within the round's limit)."""
    pages = units.groupBy("submission_id").agg(F.count("*").alias("page_count"))
    limits = rounds.select(
        F.col("id").alias("round_id"),
        F.coalesce("max_pages", F.lit(V.MAX_PAGES_DEFAULT)).alias("max_pages"),
    )
    return (
        pages.join(submissions.select(F.col("id").alias("submission_id"), "round_id"), "submission_id")
        .join(limits, "round_id")
        .select(
            "submission_id", "page_count",
            F.when(
                F.col("page_count") > F.col("max_pages"),
                fill(V.INTAKE_ERRORS["pages"], pages=F.col("page_count"), limit=F.col("max_pages")),
            ).alias("reject_reason"),
        )
    )


def round_intake(uploads: DataFrame, rounds: DataFrame) -> DataFrame:
    """uploads(id, round_id, original_filename, size_bytes, created_at) + reject_reason.

    A round that is closed or full refuses before the file is looked at.  "Full"
    needs no running count over a round: the limit-th accepted upload of each
    limited round is its cutoff, and whatever comes later is refused.
    """
    limits = rounds.select(
        F.col("id").alias("round_id"),
        F.col("status").alias("_status"),
        F.col("max_submissions").alias("_max"),
        F.coalesce("max_file_size_mb", F.lit(V.MAX_FILE_MB_DEFAULT)).alias("_mb"),
        F.coalesce("allowed_file_types", F.array(F.lit("pdf"), F.lit("pptx"))).alias("_types"),
    )
    E = V.INTAKE_ERRORS
    closed = F.col("_status") == "closed"
    wrong_type = ~F.array_contains("_types", extension(F.col("original_filename")))
    too_big = F.col("size_bytes") > F.col("_mb").cast("bigint") * _MB
    joined = uploads.join(limits, "round_id")
    order = [F.col("created_at"), F.col("id")]
    valid = joined.filter(F.col("_max").isNotNull() & ~closed & ~wrong_type & ~too_big).select(
        "round_id", "id", "created_at", "_max"
    )
    cutoffs = (
        first_per_group_salted(valid, ["round_id"], order, "_max", ["id"])
        .filter(F.col("rn") == F.col("_max"))
        .select("round_id", F.struct("created_at", "id").alias("_cutoff"))
    )
    full = F.coalesce(F.struct("created_at", "id") > F.col("_cutoff"), F.lit(False))
    reason = (
        F.when(closed, E["closed"])
        .when(full, fill(E["full"], limit=F.col("_max")))
        .when(wrong_type, fill(E["extension"], allowed=F.array_join("_types", ", ")))
        .when(too_big, fill(E["round_size"], limit=F.col("_mb")))
    )
    return joined.join(cutoffs, "round_id", "left").select(*uploads.columns, reason.alias("reject_reason"))


def duplicates(files: DataFrame) -> DataFrame:
    """files(submission_id, round_id, sha256, …) + duplicate_of: the first equal file of the round.

    The group is reduced to its first id before it is joined back, so many
    copies of one file are never gathered.
    """
    first = files.groupBy("round_id", "sha256").agg(F.min("submission_id").alias("_first"), F.count("*").alias("_n"))
    return (
        files.join(first.filter("_n > 1").drop("_n"), ["round_id", "sha256"], "left")
        .withColumn("duplicate_of", F.when(F.col("_first") != F.col("submission_id"), F.col("_first")))
        .drop("_first")
    )


def intake_status(submissions: DataFrame, packs: DataFrame, failures: DataFrame) -> DataFrame:
    """Status after intake: packs(submission_id, partial, integrity_status), failures(submission_id, detail)."""
    failed = F.col("detail").isNotNull()
    return (
        submissions.select(F.col("id").alias("submission_id"))
        .join(packs.select("submission_id", "partial", "integrity_status"), "submission_id", "left")
        .join(failures.select("submission_id", "detail"), "submission_id", "left")
        .select(
            "submission_id",
            F.when(failed, "processing_failed").when(F.col("partial"), "partially_processed")
            .when(F.col("partial").isNotNull(), "ready").otherwise("uploaded").alias("status"),
            F.when(failed, F.concat(F.lit(V.DOCUMENT_FAILURE + " ("), F.col("detail"), F.lit(")"))).alias(
                "processing_error"
            ),
            F.when(failed, "manual_review_required").otherwise(F.col("integrity_status")).alias("integrity_status"),
        )
    )
