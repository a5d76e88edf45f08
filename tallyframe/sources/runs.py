"""Configurations, manifests and the runs of a results folder.

A run is a folder with ``raw.jsonl`` (or its gzip), and, where there are, ``graded.jsonl`` and ``manifest.json``. All reads and
writes of the driver go through the Hadoop file system, so that a folder may be in any store that Spark reads.
"""

from __future__ import annotations

import copy
import json
import time
from collections import deque
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import grading as gr
from tallyframe.sources import jsonl

AUXILIARY = ("greedy_pass", "self_refine", "self_verify")


# ------------------------------------------------------------------ files of the driver
def _file(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    """A file's value; the default where it is missing or no JSON."""
    try:
        text = read_text(spark, path)
        return default if text is None else json.loads(text)
    except ValueError:
        return default


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Writes a value beside its place first and renames it there, so that readers see the old one or the new one."""
    fs, at = _file(spark, path)
    beside = at.suffix(f".{time.time_ns()}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True, default=str).encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be put in place")


# ------------------------------------------------------------------ configurations
def scalar(text: str) -> Any:
    """A value as a command line writes it: JSON if it is, the words for true, false and none, else the text."""
    words = {"true": True, "yes": True, "false": False, "no": False, "none": None, "null": None}
    if text.strip().lower() in words:
        return words[text.strip().lower()]
    try:
        return json.loads(text)
    except ValueError:
        return text


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: dictionaries merge, all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def deep_get(config: dict, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def deep_set(config: dict, path: str, value: Any) -> None:
    *above, last = path.split(".")
    for part in above:
        if not isinstance(config.get(part), dict):
            config[part] = {}
        config = config[part]
    config[last] = value


def _parsed(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def load_config(spark: SparkSession, path: str, overrides: Iterable[str] = ()) -> dict:
    """A configuration in JSON, or YAML where that can be read: the file that its ``defaults`` name, beside it, with it laid
    on top, then ``a.b=value`` overrides."""
    own = _parsed(read_text(spark, path) or "{}")
    base = own.pop("defaults", None)
    if base:
        under = _parsed(read_text(spark, f"{path.rsplit('/', 1)[0]}/{base}") or "{}")
        under.pop("defaults", None)
        own = merged(under, own)
    for item in overrides:
        name, _, value = item.partition("=")
        deep_set(own, name.strip(), scalar(value))
    return own


# ------------------------------------------------------------------ runs
class RunState:
    """A run's manifest: its configuration and its sessions."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/manifest.json"
        self.value = read_json(spark, self.path, {"sessions": []})

    def begin_session(self, config: dict) -> list[str]:
        """Opens a session and gives the paths at which the configuration differs from the stored one."""
        drift = jsonl.drift(self.value["config"], config) if "config" in self.value else []
        self.value.setdefault("config", config)
        self.value.setdefault("sessions", []).append({"started": time.time(), "drift": drift})
        write_json(self.spark, self.path, self.value)
        return drift

    def end_session(self, done: int, reason: str) -> None:
        self.value["sessions"][-1] |= {"ended": time.time(), "done": done, "reason": reason}
        write_json(self.spark, self.path, self.value)


def find_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, graded) of all folders below that hold records; found by the cluster's listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    known = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("run"), name.rlike(r"^graded\.jsonl").alias("g"), name.rlike(r"^(raw|graded)\.jsonl(\.gz)?$").alias("ok"))
    return known.where("ok").groupBy("run").agg(F.max("g").alias("graded"))


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of every uid of every run with ``run`` and its grade. Ungraded records are graded on the way."""
    raw = jsonl.read_jsonl(spark, folder).where(F.col("file").rlike(r"/raw\.jsonl(\.gz)?$"))
    run = F.regexp_extract("file", r"^(.*)/[^/]+$", 1).alias("run")
    key = F.coalesce("uid", F.concat_ws("#", "file", F.col("line_no").cast("string"))).alias("uid")
    rest = [c for c in raw.columns if c not in ("uid", "file")]
    last = raw.select(run, key, F.struct(*rest).alias("r")).groupBy("run", "uid").agg(F.max_by("r", "r.line_no").alias("r"))
    rows = last.select("run", "uid", *[F.col(f"r.{c}").alias(c) for c in rest if c != "line_no"])
    extra = lambda name: F.get_json_object("extra", f"$.{name}")
    asked = rows.select(
        F.concat_ws("\u0001", "run", "uid").alias("key"), "gold_answer", "answer_type", "choices", F.col("reasoning_traces").alias("traces"), "final_answer", "error",
        extra("trace_policy").alias("trace_policy"), F.from_json(extra("sample_answers"), "array<string>").alias("stored_answers"),
    )
    graded = gr.grade_stored(asked, "key")
    return rows.withColumn("key", F.concat_ws("\u0001", "run", "uid")).join(graded, "key").drop("key")


def corpus(records: DataFrame, auxiliary: tuple[str, ...] = AUXILIARY) -> tuple[DataFrame, DataFrame]:
    """The records of the main analysis and the auxiliary ones. Those without an elicitation stay out, and so do those
    without a sample that did not fail; auxiliary strategies go apart."""
    known = records.where(F.col("elicitation").isNotNull() & ((F.size("sample_answers") > 0) | F.col("error").isNotNull()))
    aside = F.col("strategy").isin(*auxiliary)
    return known.where(~F.coalesce(aside, F.lit(False))), known.where(aside)


def analysis_meta(meta: Column) -> Column:
    """The known fields of a record's free-form JSON that are set, as a map."""
    names = ("template_id", "tier", "subset", "domain", "level", "subject", "paraphrased", "orig_index")
    found = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.get_json_object(meta, f"$.{n}").alias("v")) for n in names]))
    return F.map_filter(found, lambda _, v: v.isNotNull())


class TimeGuard:
    """Says when to stop a loop of batches: where what is left of a budget is no more than a reserve and one and a half times
    the longer of the recent mean and the recent longest batch."""

    def __init__(self, budget_s: float, reserve_s: float = 0.0, recent: int = 20, clock=time.monotonic) -> None:
        self.budget, self.reserve, self.clock = budget_s, reserve_s, clock
        self.began, self.durations = clock(), deque(maxlen=recent)

    def record(self, seconds: float) -> None:
        self.durations.append(max(0.0, seconds))

    @property
    def remaining(self) -> float:
        return self.budget - (self.clock() - self.began)

    def should_stop(self) -> bool:
        ahead = max(sum(self.durations) / len(self.durations), max(self.durations)) if self.durations else 0.0
        return self.remaining <= self.reserve + 1.5 * ahead
