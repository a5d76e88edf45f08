"""Language of texts: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the 2-, 3- and 4-byte grams of the lower-cased words, joined by spaces; each has a hashed row of
an embedding table, a text is the mean of its rows. As everything after the mean is linear, scoring uses the
product of table and softmax weights.

Learned from documents with a language whose crc32(doc_id as text) mod 5 is not 0, at most about ``PER_LANGUAGE``
for each language, picked by a hash of the id. A fifth of these is kept from training to set the temperature and
the score under which a prediction is rejected, so that the accepted ones are right at ``TARGET`` of the time.
A text that is null or has no letter is ``und`` with score 0. With nothing to learn from, all are ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import columns, renamed, slices, texts, words

PER_LANGUAGE = 800
BUCKETS, WIDTH = 1 << 13, 16
TARGET = 0.99
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def grams(text: bytes | None) -> np.ndarray:
    """How often each hashed gram occurs."""
    b = np.frombuffer(b" " + b" ".join(words(text)) + b" ", np.uint8).astype(np.uint32)
    found = []
    for n, odd in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
        if len(b) >= n:
            h = b[: len(b) - n + 1] * np.uint32(0x01000193)
            for i in range(1, n):
                h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint32(0x01000193)
            h = h * np.uint32(odd)
            found.append((h >> np.uint32(19)).astype(np.int64))
    return np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS, np.int64)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="ignore"))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        z = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: int, epochs: int = 12, rate: float = 4.0, seed: int = 7):
    """Embeddings and softmax weights, by plain SGD with falling rate on batches of 32."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.3, (WIDTH, languages)), np.zeros(languages)
    total, step = epochs * -(-len(y) // 32), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            pick = order[at : at + 32]
            dense = np.zeros((len(pick), BUCKETS))
            for r, i in enumerate(pick):
                dense[r, x[i][0]] = x[i][1]
            h = dense @ table
            z = h @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            lr = rate * (1 - step / total)
            used = np.unique(np.concatenate([x[i][0] for i in pick]))
            dh = p @ weights.T
            weights -= lr * (h.T @ p)
            bias -= 0.1 * lr * p.sum(axis=0)
            table[used] -= 20 * lr * (dense[:, used].T @ dh)
            step += 1
    return table, weights, bias


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    usable = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = usable.groupBy("lang").count().collect()
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    shares = documents.sparkSession.createDataFrame([(r["lang"], int(min(1.0, per_language / r["count"]) * 1_000_000)) for r in found], "lang string, share int")
    # A row for each language: about as many as there are languages written.
    picked = usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, "text"):
            rows = [grams(t) for t in texts(batch, "text")]
            at = [np.flatnonzero(c) for c in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns(batch, ["doc_id", "lang"]),
                    pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())),
                    pa.array([c[a].astype(np.int32) for c, a in zip(rows, at, strict=True)], pa.list_(pa.int32())),
                ],
                names=["doc_id", "lang", "f", "n"],
            )

    schema = T.StructType([picked.schema["doc_id"], picked.schema["lang"], T.StructField("f", T.ArrayType(T.ShortType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    rows = picked.mapInArrow(count, schema).toPandas().sort_values(["doc_id", "lang"], ignore_index=True)
    x = [(np.asarray(f, np.int64), np.asarray(n, float) / max(1, np.sum(n))) for f, n in zip(rows["f"], rows["n"], strict=True)]
    y = rows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    check = np.arange(len(y)) % 5 == 4
    taught = np.flatnonzero(~check)
    table, weights, bias = train([x[i] for i in taught], y[taught], len(languages))
    flat = table @ weights
    logits = np.array([n @ flat[f] + bias for f, n in (x[i] for i in np.flatnonzero(check))]).reshape(-1, len(languages))
    temperature, least = calibrate(logits, y[check])
    return Model(languages, flat, bias, temperature, least)


def calibrate(logits: np.ndarray, y: np.ndarray, target: float = TARGET) -> tuple[float, float]:
    """The temperature of least negative log-likelihood, and the least score at which those at or above it
    are right at ``target`` of the time."""
    if not len(y):
        return 1.0, 0.5

    def chances(t: float) -> np.ndarray:
        z = logits / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    best = min(grid, key=lambda t: -np.log(chances(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = chances(best)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= target)
    return float(best), float(score[order][good[-1]]) if len(good) else 1.0


def predict(documents: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``carry`` of every document, whatever their names, then li_lang, li_score and li_accepted."""
    plain, kept = renamed(documents, carry)
    rows = plain.select(*kept, F.col(plain.columns[documents.columns.index(text_col)]).cast("string").alias("text"))
    added = [T.StructField("li_lang", T.StringType()), T.StructField("li_score", T.DoubleType()), T.StructField("li_accepted", T.BooleanType())]
    schema = T.StructType([*[rows.schema[c] for c in kept], *added])
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches, 1024, "text"):
            got = [model.predict(grams(t)) if model and has_letter(t) else (UNKNOWN, 0.0) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns(batch, kept),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[0] != UNKNOWN and g[1] >= model.least_score if model else False for g in got], pa.bool_()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).toDF(*carry, *[f.name for f in added])


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(documents, fit(documents), ["doc_id"])
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("li_lang").alias("lang_pred"),
        F.col("li_score").alias("score"),
        F.col("li_accepted").alias("accepted"),
    )
