"""A corpus pipeline over ``documents``: five stages, each one operator of the ``llm`` subpackage.

Every stage works on all rows that its predecessor kept, written as Parquet and read again. The first four return
the columns of documents: toxic documents go, one document of each group of near copies stays, documents with
benchmark passages go, and secrets in texts are masked. The last returns sampled segmentations of every
document left. Documents with null or empty texts pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate as dc
from tallyframe.llm import near_copies as nc
from tallyframe.llm import secret_ledger as sl
from tallyframe.llm import segmentations as sg
from tallyframe.llm import toxicity as tx
from tallyframe.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't reject."""
    model = tx.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tx.score(docs, model, docs.columns).where("not tx_rejected").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies."""
    rows = nc.with_row(docs)
    dropped = nc.near_copies(rows, row_col=nc.ROW).where("not kept").select(F.col("row").alias(nc.ROW))
    return rows.join(dropped, nc.ROW, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item: one leaked item is enough to go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return dc.match(docs, benchmark, docs.columns, least_items=1).where("not dc_contaminated").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew where a text changed."""
    rows, spans, masked = nc.with_row(docs), "__spans__", "__masked__"
    found = sl.scan_versions(rows, id_col=nc.ROW)[0].where(F.size("spans") > 0).select(nc.ROW, F.col("spans").alias(spans))
    none = F.array().cast(f"array<{sl.SPAN}>")
    joined = rows.join(found, nc.ROW, "left").withColumn(spans, F.coalesce(spans, none))
    changed = joined.withColumn(masked, sl.redact(F.col("text"), F.col(spans)))
    length = F.when(F.size(spans) > 0, F.length(masked).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col(masked), "n_chars": length}
    return changed.select([new.get(c, F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, draw, ids, log_probability, log_inclusion and round_trip of sampled segmentations."""
    import public_tokenizers

    found = sg.segment(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], slice_bytes=2_000_000)
    return found.select(
        "doc_id", F.col("sg_rank").alias("draw"), F.col("sg_ids").alias("ids"), F.col("sg_log_p").alias("log_probability"),
        F.col("sg_log_inclusion").alias("log_inclusion"), F.col("sg_round_trip").alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("segmentations", encode),
]

#: No SQL expresses a fitted model, nor sampling by these hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
