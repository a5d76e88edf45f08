"""Grading as records arrive: a stream of JSON lines, graded in micro-batches, upserted by key and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions import answers as an
from tallyframe.operators.records import last_wins

SCHEMA = "uid string, line_no bigint, text string, gold_answer string, answer_type string, error string"


def read_records(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Rows of a growing folder of JSON lines; malformed lines are left out."""
    lines = spark.readStream.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return lines.where("_corrupt is null").drop("_corrupt")


def grade(records: DataFrame) -> DataFrame:
    """Answer and verdict of every record; failed generations are wrong."""
    kind = F.coalesce("answer_type", F.lit("math"))
    found = records.withColumn("pred_answer", an.extract_col(F.col("text"), kind))
    right = F.col("error").isNull() & F.coalesce(an.equivalent_col(F.col("pred_answer"), F.col("gold_answer"), kind), F.lit(False))
    return found.withColumns({"is_correct": right, "grader_version": F.lit(an.GRADER_VERSION)})


def grade_stream(records: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends graded batches under ``target``; readers take the last row of each uid. A batch that runs twice writes the
    same folder again, so restarts repeat nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        grade(last_wins(batch, "uid", "line_no").drop("first_seen")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_graded(spark: SparkSession, target: str) -> DataFrame:
    """The last graded row of every uid."""
    return last_wins(spark.read.parquet(target), "uid", "line_no").drop("first_seen", "batch")
