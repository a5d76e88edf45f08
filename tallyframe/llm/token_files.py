"""Token ids of documents in binary files that give any document without unpacking the rest.

A file is a row of independent zstandard frames, each holding the ids of whole documents as little-endian
unsigned 32-bit integers; a skippable frame with the index of documents; and the seek table of the public
zstandard seekable format: compressed size, size and checksum (low half of XXH64) of every frame, then a
footer. A reader takes the footer, the table and the index from the end of a file and unpacks only the
frames of the documents it wants.

Files are written by the tasks into the shared folder under a name of the attempt; the manifest, itself
a table there, names the files that count, so a task that runs twice leaves a stray file and no doubt.

Rows are ordered by id, then by text: nulls come first, repeated ids stay. A null or empty text has only
the end id.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh_path, slices, texts, written

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 18
_AWKWARD_SPACE = re.compile(r" (?=\s|\Z)")
_BEFORE_SPACED_WORD = re.compile(r"(?= \S)")


class Encoder:
    """Ids of whole texts. Texts are cut before every space that a visible character follows, where the
    byte-level pre-tokenizer always starts a new unit, and each distinct piece is encoded once. New pieces are
    encoded in long runs; as every id stands for a known number of bytes, the run's ids fall to its pieces.
    Pieces used of late stay in memory, at most twice ``kept`` of them."""

    def __init__(self, tokenizer_path: str, kept: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(tokenizer_path), kept
        vocabulary, special = self.tokenizer.get_vocab(), self.tokenizer.get_added_tokens_decoder()
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(special[i].content.encode()) if i in special else len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> tuple[str, list[str]]:
        """What comes before the first cut, and the pieces after it without their leading space."""
        if _AWKWARD_SPACE.search(text):
            first, *rest = _BEFORE_SPACED_WORD.split(text)
            return first, [p[1:] for p in rest]
        first, *rest = text.split(" ")
        return first, rest

    def encode(self, many: list[str]) -> list[bytes]:
        """Per text its ids as bytes."""
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        cut = [self.pieces(t) for t in many]
        got = [list(map(self.known.get, rest)) for _, rest in cut]
        gaps = [[i for i, ids in enumerate(found) if ids is None] if None in found else [] for found in got]
        new = {rest[i] for (_, rest), gap in zip(cut, gaps, strict=True) for i in gap}
        self.known.update({p: self.older[p] for p in new if p in self.older})
        self._learn([p for p in new if p not in self.known])
        for (_, rest), found, gap in zip(cut, got, gaps, strict=True):
            for i in gap:
                found[i] = self.known[rest[i]]
        heads = self.tokenizer.encode_batch_fast([first for first, _ in cut], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() + b"".join(found) for e, found in zip(heads, got, strict=True)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            run = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.length[run])
            want = np.cumsum([len(p.encode()) + 1 for p in some])
            stop = np.searchsorted(ends, want)
            if len(run) and ends[-1] == want[-1] and (ends[stop] == want).all():
                raw, stop = run.tobytes(), ((stop + 1) * 4).tolist()
                self.known.update(zip(some, [raw[s:e] for s, e in zip([0, *stop], stop, strict=False)], strict=True))
            else:  # an id that stands for other bytes than its own
                found = self.tokenizer.encode_batch_fast([" " + p for p in some], add_special_tokens=False)
                self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, found, strict=True))


class FrameWriter:
    """Writes documents to an open binary file, frame by frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.pending: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(self.table), len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        body = self.pack.compress(np.array(self.index, "<i8").reshape(-1, 4).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.table.append((len(body) + 8, 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC))


class FrameReader:
    """Reads documents of one file. ``frames_read`` counts the frames unpacked."""

    def __init__(self, file, size: int) -> None:
        self.file, self.frames_read = file, 0
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: its footer is wrong")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        file.seek(int(self.starts[-2]) + 8)
        body = file.read(int(self.table[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != int(self.table[-1, 2]):
            raise ValueError("the index of documents fails its checksum")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<i8").reshape(-1, 4)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        packed = self.file.read(int(self.table[k, 0]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[k, 2]):
            raise ValueError(f"frame {k} fails its checksum")
        self.frames_read += 1
        return raw

    def documents(self, doc_ids: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids as bytes) in file order, of the documents asked for or of all."""
        wanted = None if doc_ids is None else set(doc_ids)
        at, k, raw = 0, -1, b""
        for doc_id, null, frame, n in self.index.tolist():
            key = None if null else doc_id
            if frame != k:
                k, at, raw = frame, 0, None
            if wanted is None or key in wanted:
                raw = self.frame(k) if raw is None else raw
                yield key, raw[at : at + 4 * n]
            at += 4 * n


def _open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Encode ``text`` of all rows, in order of ``doc_id``, into files in ``folder``, a URI that every
    executor can write to. Returns the manifest (part, file, bytes, n_docs, n_tokens), already written;
    ``part`` ascends with the ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tkz"
        store, top = _open_store(folder)
        docs = tokens = 0
        out = writer = None
        encoder, end = _encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in slices(batches, 1024):
            if writer is None:
                out = store.open_output_stream(f"{top}/{name}", compression=None)
                writer = FrameWriter(out, frame_bytes)
            ids = encoder.encode([(t or b"").decode(errors="replace") for t in texts(batch, "text")])
            for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                writer.add(doc_id, x + end)
                tokens += len(x) // 4 + 1
            docs += batch.num_rows
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            row = {"part": [task.partitionId()], "file": [name], "bytes": [size], "n_docs": [docs], "n_tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(row)

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return written(
        ordered.mapInArrow(write, "part long, file string, bytes long, n_docs long, n_tokens long"), "token-manifest"
    )


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Digest of every document in the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32. The running total is over one row per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["base"], []
                with store.open_input_file(f"{top}/{row['file']}") as f:
                    for doc_id, ids in FrameReader(f, row["bytes"]).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) >= 20_000:
                            yield _digests(rows)
                            rows = []
                yield _digests(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = max(1, min(manifest.count(), 20_000))
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    return based.repartition(files, "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of single documents of one file, unpacking only their frames."""
    store, inner = _open_store(path)
    with store.open_input_file(inner) as f:
        reader = FrameReader(f, store.get_file_info(inner).size)
        return {k: np.frombuffer(x, "<u4") for k, x in reader.documents(doc_ids)}


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-files")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(
        write_token_files(documents, folder, public_tokenizers.path("byte_bpe_50k.json")), folder
    )
