"""What the operators of this subpackage share: words, hashing, batches and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z becomes a-z; every ASCII byte that is no letter or digit becomes a space; bytes from 0x80 on stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of letters, digits and anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from unsigned 64-bit integers."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound so that memory stays flat on any vocabulary."""

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's for checkpoints, or the warehouse where none is set."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else spark.conf.get("spark.sql.warehouse.dir"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tallyframe-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``fresh_path`` whose rows nobody reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there and outlives executors."""
    path = f"{fresh_path(df.sparkSession, name)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, malformed ones included."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, of: str | tuple[str, ...] = (), most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most and, one row at least, of about ``most`` bytes in the columns
    ``of``, so that what is made of one stays small."""
    names = (of,) if isinstance(of, str) else of
    for batch in batches:
        size = np.full(batch.num_rows, 64, np.int64)
        for values in columns(batch, list(names)):
            size += pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        stop, at = np.cumsum(size), 0
        while at < batch.num_rows:
            n = rows
            if names:
                n = min(rows, max(1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + most, side="right")) - at))
            yield batch.slice(at, n)
            at += n


def columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def strings(df: DataFrame, column: str) -> F.Column:
    return df[column].cast(T.StringType())


#: Parts that the rows of one key are dealt to where many rows meet one.
SALTS = 64


def salt(*by: str) -> Column:
    """The part that a row is dealt to."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def renamed(df: DataFrame, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by their places, so that an operator that carries columns of any name beside its
    own never meets a clash, and the names of ``carry`` there."""
    places = [f"__c{i}__" for i in range(len(df.columns))]
    return df.toDF(*places), [places[df.columns.index(c)] for c in carry]
