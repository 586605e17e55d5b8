"""Writing packs, exports and unit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(documents: DataFrame, column: str) -> DataFrame:
    """submission_id, value: a JSON object of the submission_id and the struct ``column``, nested."""
    value = F.to_json(F.struct("submission_id", F.col(column).alias(column)))
    return documents.select("submission_id", value.alias("value"))


def write_json_documents(documents: DataFrame, column: str, path: str) -> None:
    """One JSON document per line."""
    json_documents(documents, column).select("value").write.mode("overwrite").text(path)


def write_shift_csv(dataset: DataFrame, path: str) -> None:
    """Header, nulls as empty fields, timestamps in ISO form."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    dataset.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "timestampFormat", iso
    ).csv(path)


def write_shift_parquet(dataset: DataFrame, path: str) -> None:
    dataset.write.mode("overwrite").parquet(path)


def write_units(units: DataFrame, path: str, buckets: int = 1024) -> None:
    """Units in folders by submission bucket; a re-run replaces only its buckets.

    ``units`` must hold every submission of the buckets it touches (see
    ``sources.units.replace_units``).
    """
    bucketed = units.withColumn("bucket", F.pmod(F.xxhash64("submission_id"), F.lit(buckets)))
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def export_schemas(contracts: dict[str, T.StructType], folder: str, spark) -> None:
    """Write each contract's schema as a JSON line."""
    rows = [(name, schema.json()) for name, schema in contracts.items()]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(folder)
