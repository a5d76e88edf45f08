"""Severity grades of documents by cumulative-link ordinal regression on sparse text features.

Features are a document's distinct words and their 4- and 5-byte beginnings, hashed; those kept are over-
represented in toxic documents of the labelled sample. The value of a feature is log(1 + distinct words that
have it). Grades: 0 not toxic; toxic documents are graded 1 or 2 by whether they hold more such evidence than
the median toxic document, as labels only say toxic or not. The model has one weight vector for all ordered
thresholds, P(grade <= k) = sigmoid(t_k - w.x), and yields the expected grade.

It is fitted on at most about ``MAX_LABELLED`` labelled documents, picked by a hash of the id and written once; the
model has the ``MAX_FEATURES`` features of most weight at most. Both bound the fit alone: scoring covers every whole text. A document labelled twice counts as toxic if any label says so; rows without label or id teach
nothing. Null and empty texts have no features. Without a toxic example every document gets severity 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import columns, renamed, slices, texts, words, written

MAX_LABELLED = 20_000
MAX_FEATURES = 4_000
BUCKETS = 1 << 22
#: Natural log of how much likelier a kept feature is in toxic documents.
LEAST_LOG_RATIO = 2.0
REJECT_AT = 0.5


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashed features of one word: itself and its beginnings."""
    found = [b"w" + word]
    found += [b"p" + word[:n] for n in (4, 5) if len(word) > n]
    return tuple(xxhash.xxh3_64_intdigest(f) & (BUCKETS - 1) for f in found)


class Lookup(dict):
    """Selected features of words, as their places in the model; bounded."""

    def __init__(self, places: dict[int, int]) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        got = tuple(self.places[f] for f in features_of(word) if f in self.places)
        if len(self) >= 150_000:
            self.clear()
        self[word] = got
        return got


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        lookup = Lookup({int(b): i for i, b in enumerate(self.buckets)})

        def score(text: bytes | None) -> float:
            return float(sum(self.weights[f] * math.log1p(n) for f, n in evidence(text, lookup).items()))

        return score

    def grades(self, s: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = _sigmoid(self.thresholds[None, :] - np.asarray(s)[:, None])
        edges = np.hstack([np.zeros((len(below), 1)), below, np.ones((len(below), 1))])
        return np.diff(edges, axis=1)


def evidence(text: bytes | None, lookup: Lookup) -> Counter[int]:
    found: Counter[int] = Counter()
    for w in set(words(text)):
        if got := lookup[w]:
            found.update(got)
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of about ``most`` labelled documents at most. The picked ids are few enough to broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _feature_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        n = [0, 0]
        for batch in slices(batches, 256, "text"):
            for t, y in zip(texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                n[y > 0] += 1
                seen[y > 0].update({f for w in set(words(t)) for f in features_of(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        arrays = [[-1, *keys], [n[1], *[seen[1][k] for k in keys]], [n[0], *[seen[0][k] for k in keys]]]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["bucket", "pos", "neg"])

    parts = sample.mapInArrow(count, "bucket long, pos long, neg long")
    return parts.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """The model, or None where nothing toxic is labelled."""
    sample = written(labelled_sample(documents, labels, most), "labelled")
    counts = _feature_counts(sample)
    totals = counts.where("bucket = -1").first()
    if not totals or not totals.pos or not totals.neg:
        return None
    ratio = F.log((F.col("pos") + 0.5) / (totals.pos + 1)) - F.log((F.col("neg") + 0.5) / (totals.neg + 1))
    kept = (
        counts.where("bucket >= 0 and pos >= 2").withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_LOG_RATIO)
        .orderBy((F.col("ratio") * F.sqrt("pos")).desc(), "bucket").limit(MAX_FEATURES).collect()
    )
    buckets = np.array(sorted(r.bucket for r in kept), np.int64)
    places = {int(b): i for i, b in enumerate(buckets)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(places)
        for batch in slices(batches, 256, "text"):
            found = [evidence(t, lookup) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).cast(pa.int32()),
                    pa.array([list(x.keys()) for x in found], pa.list_(pa.int32())),
                    pa.array([list(x.values()) for x in found], pa.list_(pa.int32())),
                ],
                names=["toxic", "f", "n"],
            )

    rows = sample.mapInArrow(vectors, "toxic int, f array<int>, n array<int>").toPandas()
    y = rows["toxic"].to_numpy() > 0
    size = rows["f"].map(len).to_numpy()
    at = np.repeat(np.arange(len(rows)), size)
    cols = np.concatenate([*rows["f"], []]).astype(np.int64)
    vals = np.log1p(np.concatenate([*rows["n"], []]))
    amount = np.bincount(at, vals, minlength=len(rows))
    shown = y & (amount > 0)
    grade = np.where(y, 1 + (amount > (np.median(amount[shown]) if shown.any() else 0)), 0)
    weights, thresholds = fit_ordinal(at, cols, vals, grade, len(buckets), 3)
    return Model(buckets, weights, thresholds)


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, levels: int, steps: int = 400, ridge: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean negative log-likelihood of a sparse design."""
    n = len(grade)
    share = np.array([np.clip((grade <= k).mean(), 1e-4, 1 - 1e-4) for k in range(levels - 1)])
    first = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:width], np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))
        s = np.bincount(rows, w[cols] * vals, minlength=n)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (du - dl) / n
        gw = np.bincount(cols, ds[rows] * vals, minlength=width) + ridge * w
        gt = np.array([(-(du[grade == k]).sum() + (dl[grade == k + 1]).sum()) / n for k in range(levels - 1)])
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(theta[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:width], np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))


SCORES = [
    T.StructField("tx_severity", T.DoubleType()),
    T.StructField("tx_grade", T.IntegerType()),
    T.StructField("tx_probability", T.DoubleType()),
    T.StructField("tx_rejected", T.BooleanType()),
]


def score(documents: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """Columns ``carry`` of every document, whatever their names, then tx_severity (expected grade), tx_grade (likeliest),
    tx_probability (of any toxic grade) and tx_rejected."""
    plain, kept = renamed(documents, carry)
    rows = plain.select(*kept, F.col(plain.columns[documents.columns.index(text_col)]).cast("string").alias("text"))
    schema = T.StructType([*[rows.schema[c] for c in kept], *SCORES])
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        one = model.scorer() if model else None
        for batch in slices(batches, 1024, "text"):
            if model:
                p = model.grades(np.array([one(t) for t in texts(batch, "text")]))
            else:
                p = np.tile([1.0, 0.0, 0.0], (batch.num_rows, 1))
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns(batch, kept),
                    pa.array(p @ np.arange(p.shape[1])),
                    pa.array(p.argmax(axis=1), pa.int32()),
                    pa.array(toxic),
                    pa.array(toxic >= reject_at),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).toDF(*carry, *[f.name for f in SCORES])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model, ["doc_id"]).select(
        "doc_id",
        F.col("tx_severity").alias("expected_severity"),
        F.col("tx_grade").alias("grade"),
        F.col("tx_probability").alias("p_toxic"),
        F.col("tx_rejected").alias("toxic"),
    )
