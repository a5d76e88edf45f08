"""Near-duplicate documents by BagMinHash signatures of their multisets of word shingles.

A document is the multiset of its runs of five words. Each distinct shingle owns a Poisson process over its
possible counts, cut into dyadic intervals; the first point of an interval carries a register and a position,
and further points come from its halves, so an interval behaves alike in every document that covers it. A
document takes, for each register, the least position over the intervals its counts cover, and stops wherever a
process has passed its highest register. Two documents agree in a register with the probability of their
weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` registers make candidates: at similarity 0.8 a pair
shares a band with probability 0.9994.

In a band's bucket, every document is first compared with the document that shares most buckets and with the
one of least key; pairs are verified by the exact overlap of the multisets, and verified links make classes by
connected components. Where the other members of a bucket are still of several classes, all pairs of them that
no class joins are compared, in blocks of the bucket, each pair in the first bucket that it shares. So every
pair of a bucket is compared or already of one class, and rows stay linear where a bucket is one class.

Copies of one text count once. Texts without words match nothing;
texts of under five words are one shingle. One row of each class is kept, the one of least doc_id. Rows of
one id are told apart by their text, repeated rows by their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import WordHashes, columns, mix64, salt, slices, texts, unit, words, written
from tallyframe.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 40, 8
#: Shingles whose processes run at once, and bytes of text sketched at once: they bound a worker's memory.
CHUNK, SKETCH_BYTES = 1 << 18, 1 << 20
#: Members and bytes of marks of a part of a bucket; two parts make a block.
PART, PART_BYTES = 128, 1 << 23
#: Up to so many unsettled nodes are broadcast to pick their marks; more are joined by key.
MOST_BROADCAST = 1_000_000
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8

_FACTORS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_HALF, _NEXT = np.uint64(0x517CC1B727220A95), np.uint64(0x2545F4914F6CDD1D)


def shingles(ws: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    with np.errstate(over="ignore"):
        if len(h) >= SHINGLE:
            n = len(h) - SHINGLE + 1
            s = sum(h[i : i + n] * _FACTORS[i] for i in range(SHINGLE))
        elif len(h):
            s = np.array([(h * _FACTORS[: len(h)]).sum() + np.uint64(len(h))], np.uint64)
        else:
            s = h
    return np.unique(mix64(s), return_counts=True)


def _seeded(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An exponential step and a register for each seed."""
    r = mix64(seed)
    return -np.log(unit(r)), (mix64(r) % np.uint64(REGISTERS)).astype(np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, REGISTERS) least positions. ``doc`` ascends and names the document of each shingle."""
    least, top = np.full(docs * REGISTERS, np.inf), np.full(docs, np.inf)
    for at in range(0, len(hashes), CHUNK):
        _descend(hashes[at : at + CHUNK], counts[at : at + CHUNK], doc[at : at + CHUNK], least, top)
    return least.reshape(docs, REGISTERS)


def _descend(hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, least: np.ndarray, top: np.ndarray) -> None:
    """Lowers ``least`` by the processes of some shingles; ``top`` is the highest register of each document."""
    parts = []
    level, low, size = 0, 0, 1
    most = int(counts.max(initial=0))
    while low < most:
        on = np.flatnonzero(counts > low)
        seed = mix64(hashes[on] + np.uint64(level))
        x, k = _seeded(seed)
        parts.append((doc[on], seed, np.full(len(on), low), np.full(len(on), size), x / (REGISTERS * size), k, counts[on]))
        low, level = low + size, level + 1
        size = low
    singles = []
    d, seed, lo, n, x, k, w = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 7
    while len(d):
        full = lo + n <= w
        _lower(least, top, d[full] * REGISTERS + k[full], x[full])
        go = (lo < w) & (x <= top[d])
        d, seed, lo, n, x, k, w = (a[go] for a in (d, seed, lo, n, x, k, w))
        one = n == 1
        singles.append((d[one], seed[one], x[one]))
        d, seed, lo, n, x, k, w = (a[~one] for a in (d, seed, lo, n, x, k, w))
        n = n // 2
        right = (mix64(seed ^ _HALF) >> np.uint64(63)).astype(np.int64)
        other = mix64(seed + (1 - right).astype(np.uint64) + np.uint64(1))
        step, reg = _seeded(other)
        halves = (
            (d, mix64(seed + right.astype(np.uint64) + np.uint64(1)), lo + right * n, n, x, k, w),
            (d, other, lo + (1 - right) * n, n, x + step / (REGISTERS * n), reg, w),
        )
        d, seed, lo, n, x, k, w = (np.concatenate(p) for p in zip(*halves, strict=True))
    # What is left goes on point by point, many at once where few processes are left.
    d, seed, x = (np.concatenate(p) for p in zip(*singles, strict=True)) if singles else [np.zeros(0, np.int64)] * 3
    passed = 0
    while len(d):
        ahead = np.arange(passed + 1, passed + 1 + min(64, max(1, CHUNK // (2 * len(d)))), dtype=np.uint64)
        step, reg = _seeded(seed[:, None] ^ ahead * _NEXT)
        xs = x[:, None] + np.cumsum(step, axis=1) / REGISTERS
        reg += d[:, None] * REGISTERS
        low = xs <= top[d][:, None]
        _lower(least, top, reg[low], xs[low])
        go = xs[:, -1] <= top[d]
        d, seed, x, passed = d[go], seed[go], xs[go, -1], passed + len(ahead)


def _lower(least: np.ndarray, top: np.ndarray, places: np.ndarray, points: np.ndarray) -> None:
    np.minimum.at(least, places, points)
    np.max(least.reshape(-1, REGISTERS), axis=1, out=top)


def bands(signature: np.ndarray) -> np.ndarray:
    """(docs, BANDS) bucket keys."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        h = mix64(h ^ bits[:, :, r])
    return h.view(np.int64)


def expanded(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set of 32-bit marks whose overlaps are those of the multiset: the i-th copy of a shingle is a mark."""
    marks = np.repeat(hashes, counts)
    nth = np.arange(len(marks)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique((mix64(marks + nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))


_KNOWN = WordHashes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048, "text", SKETCH_BYTES):
        found, nodes = [], []
        for t, row in zip(texts(batch, "text"), columns(batch, ["row"])[0].to_pylist(), strict=True):
            ws = words(t)
            found.append(shingles(ws, _KNOWN))
            nodes.append(hashlib.sha256(t if ws else b"row " + row.encode()).digest()[:16])
        size = [len(h) for h, _ in found]
        doc = np.repeat(np.arange(len(found)), size)
        got = bands(signatures(*(np.concatenate(a) for a in zip(*found, strict=True)), doc, len(found)))
        yield pa.RecordBatch.from_arrays(
            [
                *columns(batch, ["doc_id", "row"]),
                pa.array(nodes, pa.binary()),
                pa.array([b if n else [] for b, n in zip(got, size, strict=True)], pa.list_(pa.int64())),
                pa.array([expanded(h, c).tobytes() for h, c in found], pa.binary()),
            ],
            names=["doc_id", "row", "node", "bands", "marks"],
        )


#: A name that tables do not use.
ROW = "__row__"


def with_row(documents: DataFrame) -> DataFrame:
    """The documents, read from files, with ``ROW``: the place of each row in them."""
    return documents.withColumn(ROW, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of marks."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y) or min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return 0.0
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(x) + len(y) - same)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512, ("ma", "mb"), 1 << 22):
        a, b = columns(batch, ["ma", "mb"])
        good = [overlap(x.as_py(), y.as_py()) >= THRESHOLD for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays(columns(batch, ["u", "v"]), names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def buckets(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, n) of the buckets of several nodes, and (bucket, most, least) of their pivots."""
    nodes = sketches.select("node", "bands").dropDuplicates(["node"])
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(rows.join(shared, "bucket"), "buckets")
    central = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = rows.join(central, "node").select("bucket", "node", "weight")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("most"), F.min("node").alias("least"))
    return rows, written(pivots.select("bucket", "most.node", "least").toDF("bucket", "most", "least"), "pivots")


def pivot_pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of nodes: in each bucket, all against its two pivots."""
    met = rows.join(pivots, "bucket").select("node", F.explode(F.array("most", "least")).alias("pivot")).where("node <> pivot")
    return met.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()


def candidates(sketches: DataFrame) -> DataFrame:
    """The pairs of the first pass."""
    return pivot_pairs(*buckets(sketches))


def links(sketches: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Verified pairs of nodes, of the first pass or of ``pairs``."""
    marks = sketches.select("node", "marks").groupBy("node").agg(F.first("marks").alias("marks"))
    pairs = candidates(sketches) if pairs is None else pairs
    pairs = pairs.join(marks.select(F.col("node").alias("v"), F.col("marks").alias("mb")), "v")
    pairs = pairs.join(marks.select(F.col("node").alias("u"), F.col("marks").alias("ma")), "u")
    return pairs.select("u", "v", "ma", "mb").mapInArrow(_verify, "u binary, v binary")


def unsettled(rows: DataFrame, pivots: DataFrame, linked: DataFrame) -> DataFrame:
    """(bucket, node, component, main) of the members, pivots left out, of buckets where these are of several
    components; ``main`` is the bucket's largest one."""
    rest = rows.where("n > 2").join(pivots, "bucket").where("node <> most and node <> least").select("bucket", "node")
    rest = rest.join(linked, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return rest.join(mixed.select("bucket", F.col("top.component").alias("main")), "bucket")


def _compare_block(table: pa.Table) -> pa.Table:
    """Links (u, v) between members of a block that join components."""
    bucket, one, two = (table.column(c)[0].as_py() for c in ("bucket", "one", "two"))
    node, component, marks, part = (table.column(c).to_pylist() for c in ("node", "component", "marks", "part"))
    band = np.array(table.column("bands").to_pylist(), np.int64)
    size = np.array([len(m) for m in marks])
    left = np.array([i for i, p in enumerate(part) if p == one])
    right = left if one == two else np.array([i for i, p in enumerate(part) if p == two])
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    u, v = [], []
    for i in left:
        others = right[right > i] if one == two else right
        if not len(others):
            continue
        same = band[others] == band[i]
        # A pair meets in the first bucket that it shares, if lengths allow a link.
        meet = same.any(axis=1) & (band[i][same.argmax(axis=1)] == bucket)
        meet &= np.minimum(size[others], size[i]) >= THRESHOLD * np.maximum(size[others], size[i])
        for j in others[meet]:
            if (x := root(component[i])) != (y := root(component[j])) and overlap(marks[i], marks[j]) >= THRESHOLD:
                parent[x] = y
                u.append(min(node[i], node[j]))
                v.append(max(node[i], node[j]))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def block_links(rest: DataFrame, sketches: DataFrame) -> DataFrame:
    """Verified links (u, v) between members of ``unsettled`` buckets that are of different components. Members
    outside the main component are dealt to the first parts of a bucket, and each part of these is compared with
    itself and with every other part."""
    ids = rest.select(F.xxhash64("node").alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    known = sketches.join(ids, F.xxhash64("node") == F.col("id"), "left_semi")
    known = written(known.groupBy("node").agg(F.first("marks").alias("marks"), F.first("bands").alias("bands")), "unsettled-marks")
    size = known.select("node", F.length("marks").alias("bytes"))
    rest = rest.join(size, "node").withColumn("other", F.col("component") != F.col("main"))

    def parts(on: F.Column) -> F.Column:
        many = F.count(F.when(on, 1)) / F.lit(PART)
        return F.ceil(F.greatest(many, F.sum(F.when(on, F.col("bytes")).otherwise(0)) / F.lit(PART_BYTES))).cast("int")

    dealt = rest.groupBy("bucket").agg(parts(F.col("other")).alias("q"), parts(~F.col("other")).alias("p"))
    salt = F.xxhash64("node", "bucket")
    part = F.when(F.col("other"), F.pmod(salt, F.col("q"))).otherwise(F.col("q") + F.pmod(salt, F.col("p"))).cast("int")
    placed = rest.join(dealt, "bucket").withColumn("part", part)
    # Parts of the main component meet only those of the others.
    last = F.when(F.col("other"), F.col("q") + F.col("p")).otherwise(F.col("q")) - 1
    placed = placed.select("bucket", "node", "component", "part", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    placed = placed.select("bucket", "node", "component", "part", F.least("part", "at").alias("one"), F.greatest("part", "at").alias("two"))
    return placed.join(known, "node").groupBy("bucket", "one", "two").applyInArrow(_compare_block, "u binary, v binary")


def near_copies(documents: DataFrame, text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row, class_id, kept) of every document. ``row_col`` names a unique string column; without it
    rows are numbered."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id().cast("string")
    rows = documents.select(F.col("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketches = written(rows.mapInArrow(_sketch, f"doc_id {kind}, row string, node binary, bands array<long>, marks binary"), "sketches")
    members, pivots = buckets(sketches)
    linked = connected_components(links(sketches, pivot_pairs(members, pivots)))
    rest = written(unsettled(members, pivots, linked), "unsettled")
    if not rest.isEmpty():
        more = block_links(rest, sketches)
        linked = connected_components(linked.toDF("u", "v").unionByName(more))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    dealt = sketches.select("doc_id", "row", "node", salt("row").alias("part"))
    nodes = dealt.groupBy("node").agg(lead.alias("lead"), F.collect_set("part").alias("parts")).join(linked, "node", "left")
    nodes = nodes.select("node", F.coalesce("component", "node").alias("component"), "lead", "parts")
    classes = nodes.groupBy("component").agg(F.min("lead").alias("first"), F.collect_set(salt("node")).alias("own"))
    classes = classes.select("component", "first", F.explode("own").alias("own"))
    ends = nodes.withColumn("own", salt("node")).join(classes, ["component", "own"]).select("node", "first", F.explode("parts").alias("part"))
    return dealt.join(ends, ["node", "part"]).select(
        "doc_id", "row", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept")
    )


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
