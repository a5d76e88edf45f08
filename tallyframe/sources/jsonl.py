"""Append-only JSON lines, graded tables, manifests and exports."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.identity import path_component
from tallyframe.operators import studies

RECORD = (
    "uid string, example_id string, dataset string, model string, strategy string, seed int, config_hash string, `index` bigint, question string, gold_answer string, "
    "answer_type string, choices array<string>, final_answer string, reasoning_traces array<string>, n_samples bigint, tokens_prompt bigint, tokens_completion bigint, n_calls bigint, "
    "latency_s double, elicitation string, subset string, sample_stats array<struct<tokens_completion:bigint,tokens_prompt:bigint,finish_reason:string,mean_logprob:double,"
    "cumulative_logprob:double,truncated:boolean,rendered_prompt_hash:string,extraction_method:string,extraction_failed:boolean>>, "
    "meta struct<template_id:string,tier:string,subset:string,domain:string,level:string,subject:string,paraphrased:boolean,orig_index:bigint>, extra string, finished_at string, error string"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """Rows of JSON lines files, plain or gzip, folders searched through; malformed and torn lines are left out, and a
    gzip file that breaks off gives what it holds. ``line_no`` orders the lines of a file, files by their path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
    shape = T._parse_datatype_string(f"{schema}, _corrupt string")
    parsed = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    placed = lines.select(parsed.alias("r"), F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))
    whole = placed.where("v <> '' and r is not null and r._corrupt is null")
    return whole.select(*[F.col("r")[f.name].alias(f.name) for f in shape.fields[:-1]], "file", "line_no")


def append_jsonl(df: DataFrame, folder: str, gzip: bool = False) -> None:
    """Adds rows as new files; the commit protocol makes them appear whole or not at all."""
    df.write.mode("append").option("compression", "gzip" if gzip else "none").json(folder)


def export_parquet(samples: DataFrame, folder: str) -> None:
    """Samples by model, dataset and configuration."""
    named = samples.withColumn("model", path_component(F.col("model")))
    named.repartition("model", "dataset", "config").write.mode("overwrite").partitionBy("model", "dataset", "config").parquet(folder)


def csv_value(c: Column, kind: str) -> Column:
    """A value as text: six significant digits, nothing for undefined numbers, ';' between list members."""
    if kind in ("double", "float"):
        shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
        return F.when(c.isNull() | F.isnan(c), "").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(shown)
    if kind.startswith("array"):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    return F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string")


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Frames of differing columns in one CSV table; columns in order of first sight."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    whole.select(*[F.coalesce(csv_value(F.col(c), k), F.lit("")).alias(c) for c, k in whole.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def flatten(config: Any, prefix: str = "") -> dict[str, str]:
    """Dotted paths of a nested configuration."""
    if not isinstance(config, dict):
        return {prefix: json.dumps(config, sort_keys=True)}
    return {k: v for name, x in config.items() for k, v in flatten(x, f"{prefix}.{name}" if prefix else str(name)).items()}


def drift(stored: dict, current: dict) -> list[str]:
    """Paths whose values differ."""
    a, b = flatten(stored), flatten(current)
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_dataset(name: str):
    """Adds a loader of examples (id, question, gold_answer, answer_type, choices) to the registry."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        DATASETS[name] = f
        return f

    return add


def load_examples(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted(DATASETS)) or 'none'}")
    return DATASETS[name](spark, path)


def first_column(df: DataFrame, candidates: list[str]) -> Column:
    """The first of the candidates that the table has."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    raise KeyError(f"none of {candidates} among {df.columns}")


def _examples(df: DataFrame, question: Column, gold: Column, kind: str | Column, choices: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return df.select(F.monotonically_increasing_id().cast("string").alias("id"), question.alias("question"), gold.cast("string").alias("gold_answer"), (F.lit(kind) if isinstance(kind, str) else kind).alias("answer_type"), (none if choices is None else choices).alias("choices"))


@register_dataset("gsm8k")
def _gsm8k(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    gold = F.regexp_replace(F.trim(F.element_at(F.split("answer", "####"), -1)), ",", "")
    return _examples(df, F.col("question"), gold, "math")


@register_dataset("math500")
def _math500(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    return _examples(df, first_column(df, ["problem", "question"]), F.col("answer"), "math")


@register_dataset("aime")
def _aime(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    return _examples(df, first_column(df, ["Problem", "problem", "question"]), first_column(df, ["Answer", "answer"]), "math")


@register_dataset("arc_challenge")
def _arc(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    place = F.array_position(F.col("choices.label"), F.col("answerKey").cast("string"))
    return _examples(df, F.col("question"), F.substring(F.lit("ABCDEFGHIJ"), place.cast("int"), F.lit(1)), "mc", F.col("choices.text"))


@register_dataset("bbh")
def _bbh(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with options on lines of their own are choices, with the letter as gold; others are words, or truth values."""
    df = spark.read.json(path)
    question, gold = first_column(df, ["input", "question"]), F.trim(first_column(df, ["target", "answer"]).cast("string"))
    options = studies.inline_options(question)
    kind = F.when(options.isNotNull(), "mc").when(F.lower(gold).isin("true", "false", "yes", "no"), "bool").otherwise("text")
    return _examples(df, question, F.when(options.isNotNull(), F.regexp_replace(gold, r"[()]", "")).otherwise(gold), kind, options)


@register_dataset("musr")
def _musr(spark: SparkSession, path: str) -> DataFrame:
    """A narrative and its question; choices are a list or a list's text, gold is the index of one."""
    df = spark.read.json(path)
    choices = F.col("choices") if dict(df.dtypes)["choices"].startswith("array") else studies.listed_choices(F.col("choices"))
    return _examples(df, F.concat_ws("\n\n", "narrative", "question"), _letter(F.col("answer_index")), "mc", choices)


@register_dataset("gpqa_diamond")
def _gpqa(spark: SparkSession, path: str) -> DataFrame:
    """The right answer and three wrong ones, in an order by the question's hash."""
    df = spark.read.json(path)
    answers = F.array(*[F.trim(F.col(f"`{c}`")) for c in ("Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3")])
    mixed = studies.shuffled_choices(F.md5(F.col("Question").cast("binary")), answers, answers[0])
    return _examples(df, F.col("Question"), mixed["letter"], "mc", mixed["choices"])


@register_dataset("gsm_symbolic")
def _gsm_symbolic(spark: SparkSession, path: str) -> DataFrame:
    return _gsm8k(spark, path)


@register_dataset("toy")
def _toy(spark: SparkSession, path: str) -> DataFrame:
    """24 sums made by rule; the path plays no part."""
    df = spark.range(24).withColumn("a", 3 * F.col("id") + 2).withColumn("b", F.pmod(7 * F.col("id"), F.lit(11)) + 1)
    return _examples(df, F.concat(F.lit("What is "), F.col("a").cast("string"), F.lit(" + "), F.col("b").cast("string"), F.lit("?")), F.col("a") + F.col("b"), "math")


def _letter(index: Column) -> Column:
    return F.substring(F.lit("ABCDEFGHIJ"), index.cast("int") + 1, F.lit(1))


def save_examples(examples: DataFrame, path: str) -> None:
    """A snapshot of examples as JSON lines."""
    examples.write.mode("overwrite").json(path)


def load_saved_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, gold_answer string, answer_type string, choices array<string>").json(path)
