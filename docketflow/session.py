"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docketflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes.

    Partition counts are left to the caller: on a cluster AQE coalesces from a
    high ``spark.sql.shuffle.partitions``; tests pass a low one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have thousands of expressions; recording a call site for each is costly.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="docketflow-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str = "stage", compression: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there.

    Used where several branches read the same costly table.  The files are on
    shared storage, so a lost executor costs one task instead of the whole plan,
    and as Parquet each branch reads only the columns it needs.  A filter on the column
    ``by`` reads the files of its value alone.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docketflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
