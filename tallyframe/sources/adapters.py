"""Plain tables read as the relations of repeated-sampling evaluation.

samples: item, model, config, seed, idx, cls, ok, tok; one row for each sampled answer. ``idx`` orders the samples
of a cell (item, model, config, seed). records: one row for each example and strategy. log: an append-only file
with repeats and errors. traces: answer texts with the value they state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = ["item", "model", "config", "seed"]
UNPARSED = "<unparsed>"
#: Configurations in the order in which they are listed.
CONFIG_ORDER = ("c0", "c1", "c2", "c3", "c4", "c5", "c6")
PRIMARY = CONFIG_ORDER[:6]
SEPARATE = CONFIG_ORDER[6:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with one right class, wrong classes and failed extractions; difficulty varies by item and config."""
    t = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 3
    gold = F.col("l_quantity") > 10 + (F.col("l_suppkey") * 7) % 31 + n * (F.col("l_suppkey") % 5) * 2
    cls = (
        F.when(gold, "gold")
        .when(F.col("l_discount") >= 0.095, UNPARSED)
        .otherwise(F.concat(F.lit("w"), (F.round(F.col("l_discount") * 100).cast("int") % 3).cast("string")))
    )
    order = Window.partitionBy("item", "model", "config", "seed").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"
    )
    named = t.select(
        F.col("l_suppkey").cast("string").alias("item"),
        F.col("l_returnflag").alias("model"),
        F.concat(F.lit("c"), n.cast("string")).alias("config"),
        (F.col("l_orderkey") % 2).alias("seed"),
        cls.alias("cls"),
        (F.col("l_quantity").cast("int") + 20 * n).cast("long").alias("tok"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax",
    )
    return named.select(
        *CELL, (F.row_number().over(order) - 1).cast("long").alias("idx"), "cls", (F.col("cls") == "gold").alias("ok"), "tok"
    )


def part_counts(spark: SparkSession, sf_dir: str, least_quantity: int = 25) -> DataFrame:
    """Small ragged cells (item, model, config, n, k), many of them saturated and some items incomplete."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("config"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > least_quantity).alias("k"))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("example"), F.col("o_orderpriority").alias("strategy"),
        (F.col("o_orderstatus") == "F").alias("is_correct"), (F.col("o_totalprice").cast("long") % 1000).alias("tokens"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("uid"), F.col("event_id").alias("line_no"),
        (F.col("event_type") == "error").alias("failed"), "value", "user_id", "event_type",
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, idx, text, gold) with every shape of stated answer; ``gold`` is the item's most usual quantity class."""
    t = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber")
    text = (
        F.when(kind == 1, F.concat(F.lit("so \\boxed{"), q, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("The answer is "), q, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("work 7 #### "), q))
        .when(kind == 4, F.concat(F.lit("3 then we get "), q, F.lit(" units")))
        .when(kind == 5, F.lit("no idea"))
        .when(kind == 6, F.concat(F.lit("first \\boxed{9} then \\boxed{\\frac{"), q, F.lit("}{2}}")))
        .otherwise(F.concat(F.lit("Answer: "), q, F.lit(".50")))
    )
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    return t.select(
        F.col("l_orderkey").alias("item"), (F.row_number().over(order) - 1).cast("long").alias("idx"), kind.alias("kind"),
        F.col("l_quantity").cast("long").alias("q"), text.alias("text"), (F.col("l_orderkey") % 50 + 1).cast("string").alias("gold"),
    )


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of four kinds of answer with three traces each, some failed, some cut, some without a final answer."""
    t = table(spark, sf_dir, "orders")
    kind, p, g = F.col("o_orderkey") % 4, F.col("o_custkey") % 7, F.col("o_custkey") % 5
    names = F.array(*[F.lit(x) for x in ("red fox", "blue whale", "green frog", "grey wolf")])
    letter = lambda x: F.char(65 + x % 4)
    truth = lambda x: F.when(x % 2 == 0, "yes").otherwise("no")
    word = lambda x: F.concat(F.lit("word"), x.cast("string"))
    say = lambda before, x, after="": F.concat(F.lit(before), x.cast("string"), F.lit(after))
    traces = (
        F.when(kind == 0, F.array(say("hence \\boxed{", p, "}"), say("so 3 and the answer is ", g, "."), say("steps #### ", p)))
        .when(kind == 1, F.array(say("I pick (", letter(p), ")"), say("The answer is the ", F.get(names, (g % 4).cast("int"))), say("\\boxed{", letter(p), "}")))
        .when(kind == 2, F.array(say("Answer: ", truth(p)), say("it is ", truth(g)), say("\\boxed{", truth(p), "}")))
        .otherwise(F.array(say("The result is ", word(p)), say("\\boxed{", word(g), "}"), say("#### ", word(p))))
    )
    gold = F.when(kind == 0, g.cast("string")).when(kind == 1, letter(g)).when(kind == 2, F.when(g % 2 == 0, "True").otherwise("False")).otherwise(word(g))
    own = F.when(kind == 0, p.cast("string")).when(kind == 1, letter(p)).when(kind == 2, F.when(p % 2 == 0, "True").otherwise("False")).otherwise(word(p))
    cut = F.col("o_orderkey") % 11 == 0
    return t.select(
        F.col("o_orderkey").alias("uid"), gold.alias("gold_answer"), F.get(F.array(*[F.lit(x) for x in ("math", "mc", "bool", "text")]), kind.cast("int")).alias("answer_type"),
        F.when(kind == 1, names).alias("choices"), traces.alias("traces"), F.when(F.col("o_orderkey") % 3 != 0, gold).alias("final_answer"),
        F.when(F.col("o_orderstatus") == "P", "timed out").alias("error"), F.when(cut, "truncate").alias("trace_policy"), F.when(cut, F.array(gold, gold, own)).alias("stored_answers"),
    )
