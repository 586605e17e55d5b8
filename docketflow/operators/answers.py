"""Model answers that outlive a run.

An answer is stored under the digest of its stage, its contract and its prompt.  A run asks
only what no stored answer fits: another prompt or another contract has another digest, so
changed documents are asked again and their old answers are superseded, while equal prompts,
in one run or over many, are asked once.  Questions go out in waves, each committed by Spark on
its own, so a run that is killed loses one wave and the next run resumes behind the last one.
Failures are reported and asked again by the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.operators.plugins import call_model, model_contract
from docketflow.session import cut

ANSWERS = "digest string, submission_id long, answer string, error string, asked_at timestamp, stage string"
#: Questions of a wave: the most that a killed run may have asked in vain.
WAVE = 10_000
#: Questions of a task: whole documents, which Python takes in at once.
BATCH = 256


@dataclass(frozen=True)
class AnswerStore:
    """Answers in Parquet files under ``path``, a folder for each stage."""

    path: str

    def read(self, spark: SparkSession, stage: str | None = None) -> DataFrame:
        """``ANSWERS``; none before the first question."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
            return spark.createDataFrame([], ANSWERS)
        rows = spark.read.schema(ANSWERS).parquet(self.path)
        return rows if stage is None else rows.filter(F.col("stage") == stage)

    def add(self, answers: DataFrame) -> None:
        answers.write.mode("append").partitionBy("stage").parquet(self.path)


def digest(stage: str, contract: T.StructType, prompt: Column) -> Column:
    """What an answer is stored under."""
    shape = json.dumps(model_contract(contract).jsonValue(), sort_keys=True)
    return F.sha2(F.concat(F.sha2(F.lit(f"{stage}\n{shape}"), 256), prompt), 256)


def ask(
    prompts: DataFrame, call: Callable[[str], str], contract: T.StructType, stage: str, store: AnswerStore, wave: int = WAVE
) -> DataFrame:
    """prompts(submission_id, prompt) → submission_id, answer, error; only what is new is asked.

    ``prompts`` is a written table.  Of submissions with one prompt the first asks, all get the answer.
    The prompts are read a fixed number of times: new ones are written by wave, so that a wave
    reads its own alone, and the answers meet the written digests.
    """
    spark = prompts.sparkSession
    keyed = prompts.select("submission_id", "prompt", digest(stage, contract, F.col("prompt")).alias("digest"))
    wanted = cut(keyed.select("submission_id", "digest"), "wanted")
    answered = store.read(spark, stage).filter("answer is not null").select("digest").distinct()
    new = cut(wanted.join(answered, "digest", "left_anti").groupBy("digest").agg(F.min("submission_id").alias("submission_id")), "new")
    count = new.count()
    waves = -(-count // wave)
    if waves:
        turn = F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")
        questions = cut(keyed.join(new, ["digest", "submission_id"]).withColumn("turn", turn), "questions", "zstd", by="turn")
    for number in range(waves):
        asked = questions.filter(F.col("turn") == number).repartition(-(-min(count, wave) // BATCH))
        said = call_model(asked, call, contract, stage, "digest string, submission_id bigint")
        store.add(said.withColumn("asked_at", F.current_timestamp()).withColumn("stage", F.lit(stage)))
    said = store.read(spark, stage).groupBy("digest").agg(
        F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("asked_at"))).alias("answer"), F.max_by("error", "asked_at").alias("error"))
    return wanted.join(said, "digest", "left").select("submission_id", "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))


def superseded(prompts: DataFrame, contract: T.StructType, stage: str, store: AnswerStore) -> DataFrame:
    """Stored answers of the stage that no prompt of ``prompts`` asks for any more, of the submissions it names."""
    now = prompts.select("submission_id", digest(stage, contract, F.col("prompt")).alias("digest"))
    rows = store.read(prompts.sparkSession, stage).filter("answer is not null")
    return rows.join(now.select("digest").distinct(), "digest", "left_anti").join(now.select("submission_id").distinct(), "submission_id", "left_semi")
