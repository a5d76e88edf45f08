"""Grading of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import answers as an


def grade_traces(traces: DataFrame, kind: str = "math") -> DataFrame:
    """traces (item, idx, text, gold) with answer and ok for each."""
    k = F.lit(kind)
    found = traces.withColumn("answer", an.extract_col(F.col("text"), k))
    return found.withColumn("ok", F.coalesce(an.equivalent_col(F.col("answer"), F.col("gold"), k), F.lit(False)))


def with_vote(df: DataFrame, answers: str, kind: Column, choices: Column | None = None, out: str = "vote") -> DataFrame:
    """The plurality over an array column of answers, as a struct (see ``majority_of``)."""
    labels = f"__{out}_classes__"
    return df.withColumn(labels, an.classes_col(F.col(answers), kind, choices)).withColumn(out, an.majority_of(F.col(answers), F.col(labels))).drop(labels)


def grade_records(traces: DataFrame, key: list[str], kind: str = "math") -> DataFrame:
    """One graded record for each key: its samples' answers and verdicts in order, and the vote."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "answer", "ok")))
    got = grade_traces(traces, kind).groupBy(*key).agg(rows.alias("xs"), F.min_by("gold", "idx").alias("gold_answer"))
    k = F.lit(kind)
    got = got.select(*key, "gold_answer", F.col("xs.answer").alias("sample_answers"), F.col("xs.ok").alias("sample_correct"))
    got = with_vote(got, "sample_answers", k).withColumn("gold_normalized", an.normalize_col(F.col("gold_answer"), k))
    at = F.array_position("sample_answers", F.col("vote.answer"))
    return got.select(
        *key, "sample_answers", "sample_correct", "gold_normalized", F.size("sample_answers").cast("long").alias("n_samples_graded"),
        F.size(F.filter("sample_correct", lambda x: x)).cast("long").alias("n_correct_samples"), F.col("vote.answer").alias("vote_answer"),
        F.coalesce(F.get("sample_correct", (at - 1).cast("int")), F.lit(False)).alias("vote_correct"), F.get("sample_answers", F.lit(0)).alias("pred_answer"),
        F.coalesce(F.get("sample_correct", F.lit(0)), F.lit(False)).alias("is_correct"), F.lit(an.GRADER_VERSION).alias("grader_version"), F.lit(an.BACKEND).alias("grader_backend"),
    )


def grade_stored(records: DataFrame, key: str = "uid") -> DataFrame:
    """Grades of raw records (key, gold_answer, answer_type, choices, traces, final_answer, error, trace_policy,
    stored_answers), one for each, with one shuffle by key.

    A record with an error is wrong, not missing. One without a final answer takes what its last trace states, if it
    has no error and its traces are whole. Under a policy that cuts traces, the answers stored when they were
    generated count; else traces are read anew. Nulls: no type is math, no policy is full, no traces are none.
    """
    kind, policy = F.coalesce("answer_type", F.lit("math")), F.lower(F.coalesce("trace_policy", F.lit("full")))
    whole, strings = policy == "full", "array<string>"
    anew = whole | F.col("stored_answers").isNull()
    rows = records.select(
        key, F.coalesce("gold_answer", F.lit("")).alias("gold"), kind.alias("kind"), "choices", whole.alias("whole"), anew.alias("anew"), "final_answer",
        F.coalesce(F.when(anew, F.col("traces")).otherwise(F.col("stored_answers")), F.array().cast(strings)).alias("said"), F.coalesce(F.col("error") != "", F.lit(False)).alias("errored"),
    )
    each = rows.select("*", F.posexplode_outer("said").alias("idx", "one")).drop("said")
    read = an.extract_col(F.when(F.col("anew"), F.col("one")), F.col("kind"), F.col("choices"))
    each = each.withColumn("answer", F.when(F.col("anew"), read).otherwise(F.col("one")))
    each = each.withColumn("ok", an.equivalent_col(F.col("answer"), F.col("gold"), F.col("kind"), F.col("choices")))
    listed = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "answer", "ok"))))
    got = each.groupBy(key).agg(listed.alias("xs"), *[F.first(c).alias(c) for c in ("gold", "kind", "choices", "whole", "final_answer", "errored")])
    got = got.withColumn("sample_answers", F.col("xs.answer")).withColumn("sample_correct", F.col("xs.ok"))
    last = F.when(F.col("whole") & ~F.col("errored"), F.try_element_at("xs", F.lit(-1)))
    got = with_vote(got, "sample_answers", F.col("kind"), F.col("choices")).withColumn("pred_answer", F.coalesce("final_answer", last["answer"]))
    voted = F.get("sample_correct", (F.array_position("sample_answers", F.col("vote.answer")) - 1).cast("int"))
    right = F.when(F.col("final_answer").isNotNull(), an.equivalent_col(F.col("final_answer"), F.col("gold"), F.col("kind"), F.col("choices"))).otherwise(F.coalesce(last["ok"], F.lit(False)))
    return got.select(
        key, "sample_answers", "sample_correct", "pred_answer", an.normalize_col(F.col("gold"), F.col("kind")).alias("gold_normalized"),
        F.when(F.col("pred_answer").isNotNull(), an.normalize_col(F.col("pred_answer"), F.col("kind"))).alias("pred_normalized"),
        F.size("sample_answers").cast("long").alias("n_samples_graded"), F.size(F.filter("sample_correct", lambda x: x)).cast("long").alias("n_correct_samples"),
        F.col("vote.answer").alias("vote_answer"), F.coalesce(voted, F.lit(False)).alias("vote_correct"), (right & ~F.col("errored")).alias("is_correct"),
        F.lit(an.GRADER_VERSION).alias("grader_version"), F.lit(an.BACKEND).alias("grader_backend"),
    )


def summary(graded: DataFrame) -> DataFrame:
    """Totals of a graded file."""
    missing = F.size(F.filter("sample_answers", lambda a: a.isNull()))
    got = graded.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("is_correct").alias("n_correct"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"),
        F.round(F.avg(F.col("vote_correct").cast("int")), 6).alias("vote_accuracy"), F.sum(missing).alias("extraction_failures"), F.sum("n_samples_graded").alias("_n"),
    )
    return got.withColumn("failure_rate", F.round(F.try_divide(F.col("extraction_failures").cast("double"), F.col("_n")), 6)).drop("_n")
