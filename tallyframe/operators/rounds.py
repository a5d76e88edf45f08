"""Strategies of several calls as relations: every round adds columns to the row of its example, so a whole strategy is one
pass without a shuffle, and examples that are done cost nothing in later rounds.

A backend is a function (chat, key, tag) to a struct column (text, tokens_prompt, tokens_completion, truncated); a real model
is a pandas UDF of the rendered chat. The tag tells the calls of an example apart. It is given null chats for examples that need no call.
``examples`` have ``id`` and ``question``, and other columns are left out of the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import answers as an
from tallyframe.functions import stats as st
from tallyframe.operators import generation as ge

Backend = Callable[[Column, Column, str], Column]
Extract = Callable[[Column], Column]

THINK = "Work through it step by step, then give the final answer."
CHECK = "Check the solution above. End with 'Verdict: correct' or 'Verdict: incorrect'."
REVISE = "Write a better solution to the same question, with its final answer."
RATE = "Rate this solution from 0 (surely wrong) to 10 (surely right). Answer with the number alone."


def mock_backend(gold: Column, seed: int = 0) -> Backend:
    """Texts by a hash of key, tag and seed: drafts with the right answer, one next to it or none; verdicts either way or
    none. A prompt counts ten tokens a message."""

    def reply(chat: Column, key: Column, tag: str) -> Column:
        at = lambda what, below: st.draw(F.lit(seed), key, F.lit(tag), F.lit(what), below=F.lit(below))
        if tag.startswith("verify"):
            text = F.get(F.array(F.lit("Verdict: correct"), F.lit("VERDICT - incorrect"), F.lit("hmm")), at("text", 3).cast("int"))
        else:
            kind = at("text", 4)
            text = F.when(kind == 3, F.lit("I am not sure.")).otherwise(F.concat(F.lit("The answer is "), (gold + kind % 2).cast("string"), F.lit(".")))
        return F.struct(text.alias("text"), (F.size(chat) * 10).cast("long").alias("tokens_prompt"), (10 + at("tok", 50)).alias("tokens_completion"), (at("cut", 20) == 0).alias("truncated"))

    return reply


def _called(rows: DataFrame, backend: Backend, chat: Column, tag: str) -> DataFrame:
    """``reply`` to a chat, null where the chat is, and the bill of the call."""
    rows = rows.withColumn("chat_now", chat)
    rows = rows.withColumn("reply", F.when(F.col("chat_now").isNotNull(), backend(F.col("chat_now"), F.col("id"), tag)))
    more = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
    return rows.withColumns({
        "n_calls": more("n_calls", F.when(F.col("reply").isNotNull(), 1)), "tokens_prompt": more("tokens_prompt", F.col("reply.tokens_prompt")),
        "tokens_completion": more("tokens_completion", F.col("reply.tokens_completion")),
    })


def _drafted(examples: DataFrame, backend: Backend, chat: Column, tag: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = examples.select("id", chat.alias("chat"), zero.alias("n_calls"), zero.alias("tokens_prompt"), zero.alias("tokens_completion"))
    rows = _called(rows, backend, F.col("chat"), tag)
    return rows.withColumns({"drafts": F.array("reply.text"), "verdicts": F.array().cast("array<boolean>"), "done": F.lit(False), "truncated": F.col("reply.truncated")})


def _verified(rows: DataFrame, backend: Backend, tag: str) -> DataFrame:
    ask = F.when(~F.col("done"), ge.continue_chat(F.col("chat"), F.element_at("drafts", -1), CHECK))
    rows = _called(rows, backend, ask, tag)
    return rows.withColumn("verdicts", F.when(F.col("reply").isNotNull(), F.concat("verdicts", F.array(ge.verdict(F.col("reply.text"))))).otherwise(F.col("verdicts")))


BILL = ["n_calls", "tokens_prompt", "tokens_completion"]


def one_call(examples: DataFrame, backend: Backend, chat: Column, tag: str, extract: Extract = an.last_number_col) -> DataFrame:
    """(id, answer, truncated and the bill) of one chat an example."""
    return _drafted(examples, backend, chat, tag).select("id", extract(F.col("drafts")[0]).alias("answer"), "truncated", *BILL)


@ge.register_strategy("cot_zeroshot")
def cot_zeroshot(examples: DataFrame, backend: Backend, instruction: str = THINK, extract: Extract = an.last_number_col) -> DataFrame:
    """One answer reasoned step by step."""
    return one_call(examples, backend, ge.build_prompt(F.col("question"), instruction=instruction), "cot", extract)


@ge.register_strategy("cot_fewshot")
def cot_fewshot(examples: DataFrame, backend: Backend, shots: list[tuple[str, str]], reverse: bool = False, instruction: str = THINK, extract: Extract = an.last_number_col) -> DataFrame:
    """The same after worked examples as turns, in their order or the reverse one."""
    return one_call(examples, backend, ge.build_prompt(F.col("question"), instruction=instruction, shots=shots, reverse=reverse), "cot_fewshot", extract)


@ge.register_strategy("self_verify")
def self_verify(examples: DataFrame, backend: Backend, extract: Extract = an.last_number_col) -> DataFrame:
    """(id, answer, verdict and the bill): a draft and a verdict on it, which changes nothing."""
    rows = _verified(_drafted(examples, backend, ge.build_prompt(F.col("question"), instruction=THINK), "draft"), backend, "verify")
    return rows.select("id", extract(F.col("drafts")[0]).alias("answer"), F.col("verdicts")[0].alias("verdict"), *BILL)


@ge.register_strategy("self_refine")
def self_refine(examples: DataFrame, backend: Backend, rounds: int = 1, verify: bool = True, stop: bool = True, extract: Extract = an.last_number_col) -> DataFrame:
    """(id, answer, drafts, verdicts, rounds_used, answer_changed, stopped_early and the bill). Each round checks the last draft
    and, unless it was found right and ``stop`` holds, revises it; the answer is the last one that a draft states."""
    rows = _drafted(examples, backend, ge.build_prompt(F.col("question"), instruction=THINK), "draft")
    for r in range(max(0, rounds)):
        if verify:
            rows = _verified(rows, backend, f"verify{r}")
            if stop:
                rows = rows.withColumn("done", F.col("done") | F.coalesce(F.element_at("verdicts", -1), F.lit(False)))
        ask = F.when(~F.col("done"), ge.continue_chat(F.col("chat"), F.element_at("drafts", -1), REVISE))
        rows = _called(rows, backend, ask, f"refine{r}")
        rows = rows.withColumn("drafts", F.when(F.col("reply").isNotNull(), F.concat("drafts", F.array("reply.text"))).otherwise(F.col("drafts")))
    rows = rows.withColumn("answers", F.transform("drafts", extract))
    return rows.select(
        "id", F.try_element_at(F.filter("answers", lambda a: a.isNotNull()), F.lit(-1)).alias("answer"), "drafts", "verdicts", (F.size("drafts") - 1).alias("rounds_used"),
        (~F.col("answers")[0].eqNullSafe(F.element_at("answers", -1))).alias("answer_changed"), F.coalesce(F.try_element_at("verdicts", F.lit(-1)), F.lit(False)).alias("stopped_early"), *BILL,
    )


@ge.register_strategy("configured_sampling")
@ge.register_strategy("cdv_corpus")
def configured_sampling(samples: DataFrame) -> DataFrame:
    """(id, answer, n_samples, n_failures, n_truncated, tok): the most frequent stated answer of an example's samples (id, idx, answer,
    tok, truncated), ties to the first; null if none states one."""
    flag = F.coalesce(F.col("truncated").cast("int"), F.lit(0))
    counts = samples.groupBy("id", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.sum("tok").alias("t"), F.sum(flag).alias("cut"))
    rank = F.when(F.col("answer").isNotNull(), F.struct("n", (-F.col("first")).alias("f")))
    return counts.groupBy("id").agg(
        F.max_by("answer", rank).alias("answer"), F.sum("n").alias("n_samples"), F.coalesce(F.sum(F.when(F.col("answer").isNull(), F.col("n"))), F.lit(0)).alias("n_failures"),
        F.sum("cut").alias("n_truncated"), F.sum("t").alias("tok"),
    )


def judge_chat(question: Column, text: Column) -> Column:
    """What a judge is asked about a candidate."""
    return F.array(ge.message("system", F.lit("Grade strictly.")), ge.message("user", F.concat_ws("\n\n", question, text, F.lit(RATE))))


def rating(text: Column) -> Column:
    """The first number of a judge's reply, within 0 and 10; 0 for none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return F.least(F.lit(10.0), F.coalesce(found.try_cast("double"), F.lit(0.0)))  # no sign is read, so none is below 0


@ge.register_scorer("llm_judge")
def _judge(samples: DataFrame) -> Column:
    """By the judge's replies in ``judged``."""
    return rating(F.col("judged"))
