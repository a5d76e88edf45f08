"""The generation half as relations: prompts, a mock generator, strategies and scorers, all column expressions.

A real model is a ``mapInPandas`` function with the schema of ``mock_samples``; nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import answers as an
from tallyframe.functions import stats as st

Strategy = Callable[..., DataFrame]
Scorer = Callable[[DataFrame], Column]
STRATEGIES: dict[str, Strategy] = {}
SCORERS: dict[str, Scorer] = {}


def register_strategy(name: str):
    """Adds a function from examples and samples to one answer an example."""

    def add(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return add


def register_scorer(name: str):
    """Adds a function from samples to a score column."""

    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


def resolve(registry: dict, spec: str):
    """A registered name, or ``module:function``."""
    if spec in registry:
        return registry[spec]
    if ":" in spec:
        import importlib

        module, _, name = spec.partition(":")
        return getattr(importlib.import_module(module), name)
    raise KeyError(f"no {spec!r}; there are {', '.join(sorted(registry))}")


# ------------------------------------------------------------------ prompts
def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def lettered(choices: Column) -> Column:
    """Choices as lines with letters, under a heading."""
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(an.LETTERS), i + 1, F.lit(1)), F.lit(". "), c))
    return F.concat_ws("\n", F.lit("Options:"), lines)


def build_prompt(question: Column, choices: Column | None = None, system: str | None = None, instruction: str | None = None, shots: list[tuple[str, str]] | None = None, reverse: bool = False) -> Column:
    """A chat: system message, worked examples as turns, then the question with its choices and the instruction."""
    parts = [question]
    if choices is not None:
        parts.append(F.when(F.size(choices) > 0, lettered(choices)))
    if instruction:
        parts.append(F.lit(instruction))
    turns = [message("system", F.lit(system))] if system else []
    for q, a in reversed(shots or []) if reverse else shots or []:
        turns += [message("user", F.lit(q)), message("assistant", F.lit(a))]
    return F.array(*turns, message("user", F.concat_ws("\n\n", *parts)))


def render(chat: Column) -> Column:
    """A chat as plain text."""
    return F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def continue_chat(chat: Column, answer: Column, follow_up: str) -> Column:
    return F.concat(chat, F.array(message("assistant", answer), message("user", F.lit(follow_up))))


# ------------------------------------------------------------------ mock generator
def mock_samples(examples: DataFrame, n: int, accuracy: float, seed: int = 0) -> DataFrame:
    """n samples (id, idx, answer, tok, logprob) for each example (id, gold): right with the given chance, else one of three
    wrong answers; a pure function of id, place and seed."""
    spread = examples.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    at = [F.lit(seed), F.col("id"), F.col("idx")]
    right = st.draw(*at, F.lit("hit"), below=F.lit(1_000_000)) < int(accuracy * 1_000_000)
    wrong = F.concat(F.lit("x"), st.draw(*at, F.lit("miss"), below=F.lit(3)).cast("string"))
    return spread.select("id", "gold", "idx", F.when(right, F.col("gold")).otherwise(wrong).alias("answer"), (20 + st.draw(*at, F.lit("tok"), below=F.lit(100))).alias("tok"), (-st.draw(*at, F.lit("lp"), below=F.lit(1000)) / F.lit(1000.0)).alias("logprob"))


# ------------------------------------------------------------------ strategies
@register_strategy("direct")
@register_strategy("greedy_pass")
def first_sample(samples: DataFrame) -> DataFrame:
    """The first sample's answer."""
    return samples.groupBy("id").agg(F.min_by("answer", "idx").alias("answer"), F.min_by("tok", "idx").alias("tok"))


@register_strategy("self_consistency")
@register_strategy("majority_vote")
def plurality(samples: DataFrame) -> DataFrame:
    """The most frequent answer, ties to the first."""
    counts = samples.groupBy("id", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.sum("tok").alias("t"))
    return counts.groupBy("id").agg(F.max_by("answer", F.struct("n", (-F.col("first")).alias("f"))).alias("answer"), F.sum("t").alias("tok"))


@register_strategy("best_of_n")
def best_of_n(samples: DataFrame, scorer: str = "logprob") -> DataFrame:
    """The answer of the highest score, ties to the first."""
    score = resolve(SCORERS, scorer)(samples)
    return samples.withColumn("_s", score).groupBy("id").agg(F.max_by("answer", F.struct("_s", (-F.col("idx")).alias("f"))).alias("answer"), F.sum("tok").alias("tok"))


@register_scorer("logprob")
def _logprob(samples: DataFrame) -> Column:
    return F.col("logprob")


@register_scorer("length")
def _length(samples: DataFrame) -> Column:
    return -F.col("tok").cast("double")


def verdict(text: Column) -> Column:
    """What a text says of an answer: its last stated verdict, else a word for wrong before one for right; null if neither."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stated = F.try_element_at(F.regexp_extract_all(low, F.lit(r"(?U)verdict\s*[:\-]?\s*(correct|incorrect)"), F.lit(1)), F.lit(-1))
    said = F.when(low.rlike("incorrect|is wrong"), False).when(F.contains(low, F.lit("correct")), True)
    return F.when(stated.isNull(), said).otherwise(stated == "correct")


def tally(calls: DataFrame, by: list[str], group: str) -> DataFrame:
    """Tokens billed: a group of completions pays its prompt once."""
    per = calls.groupBy(*by, group).agg(F.max("prompt").alias("p"), F.sum("completion").alias("c"))
    return per.groupBy(*by).agg(F.sum("p").alias("tokens_prompt"), F.sum("c").alias("tokens_completion"), F.count(F.lit(1)).alias("n_calls"))


def subsample(examples: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n examples by a hash of seed and key: only the n best of each task meet."""
    return examples.withColumn("_k", st.order_key(F.lit(seed), F.col(key))).orderBy("_k", key).limit(n).drop("_k")


def paraphrased(examples: DataFrame, wording: DataFrame, key: str, text: str) -> DataFrame:
    """Examples that have another wording, with it."""
    return examples.drop(text).join(wording.select(key, text), key)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
