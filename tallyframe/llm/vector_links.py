"""All pairs of vectors with cosine similarity of at least a threshold, by an epsilon grid order join.

On unit vectors a cosine of t or more is a distance of at most e = sqrt(2 - 2 t). Vectors are sorted by their
cells, of width e, on the leading principal dimensions, and cut into blocks, each with its bounding box there.
Pairs of sequence intervals are joined recursively, from a few wide ones down to strips of blocks and, inside a task,
to blocks and short runs of a block; a pair whose boxes are over e apart is skipped, as no link can cross. What is
left is compared exactly in double precision. A task reads two strips, each block once.

A task returns at most one row for each vector of its two strips: how many links it has, and a root in the
strips' own components, so that dense groups never become pairs of rows. Equal vectors count as one with
a weight. Vectors link only with those of their length; the join runs once for each length of the table. Null and
zero vectors and those with null or non-finite components link with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import columns, salt, slices, written
from tallyframe.llm.components import connected_components

THRESHOLD = 0.9
BLOCK, RUN = 4096, 256
LEADING = 8
#: Bits of a block's number below its partition's, and below its strip's: a strip is up to 8 blocks in a row.
_SHIFT, _STRIP = 20, 3


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        keys, raw = [], []
        for v in columns(batch, ["vector"])[0].to_pylist():
            x = np.array(v, np.float64) if v is not None and None not in v else None
            ok = x is not None and np.isfinite(x).all() and x.any()
            raw.append(x.tobytes() if ok else None)
            keys.append(hashlib.sha256(raw[-1]).digest()[:16] if ok else None)
        yield pa.RecordBatch.from_arrays(
            [*columns(batch, ["vec_id"]), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"]
        )


def _units(raw: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, width)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(distinct: DataFrame, width: int, leading: int) -> np.ndarray:
    """(width, leading) axes of largest variance; the moments are summed up by the cluster."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in slices(batches, 4096):
            u = _units(columns(batch, ["raw"])[0].to_pylist(), width)
            total, first, n = total + u.T @ u, first + u.sum(axis=0), n + len(u)
        values = np.concatenate([[n], first, total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "x"])

    sums = distinct.select("raw").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    values = np.zeros(1 + width + width * width)
    for r in sums.collect():
        values[r.i] = r.x
    n, first, total = max(1.0, values[0]), values[1 : width + 1], values[width + 1 :].reshape(width, width)
    mean = first / n
    return np.linalg.eigh(total / n - np.outer(mean, mean))[1][:, ::-1][:, :leading]


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Squared distance between boxes, by rows of a against rows of b."""
    gap = np.maximum(0, np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None]))
    return (gap * gap).sum(axis=2)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def join_blocks(ua: np.ndarray, wa: np.ndarray, ub: np.ndarray, wb: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Weighted link counts of a's vectors then b's, and for each its root (an index into both)."""
    na, reach = len(ua), 2 - 2 * threshold + 1e-9
    n_links = np.zeros(na if same else na + len(ub), np.int64)
    parent = np.arange(len(n_links))
    ya, yb = ua @ axes, ub @ axes
    ra, rb = range(0, na, RUN), range(0, len(ub), RUN)
    box = lambda y, starts: (np.array([y[i : i + RUN].min(axis=0) for i in starts]), np.array([y[i : i + RUN].max(axis=0) for i in starts]))
    near = apart(*box(ya, ra), *box(yb, rb)) <= reach
    for i, j in np.argwhere(near):
        if same and j < i:
            continue
        hit = ua[i * RUN : (i + 1) * RUN] @ ub[j * RUN : (j + 1) * RUN].T >= threshold
        if same and i == j:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        r, c = np.nonzero(hit)
        r, c = r + i * RUN, c + j * RUN
        np.add.at(n_links, r, wb[c])
        if not (same and i == j):
            np.add.at(n_links, c if same else c + na, wa[r])
        _unite(parent, r, c if same else c + na)
    return n_links, parent


def _unite(parent: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Joins the components of r's and c's in ``parent``, which holds the least index of each component."""
    while True:
        x, y = parent[r], parent[c]
        if (x == y).all():
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent[:] = _roots(parent)


def _blocks(width: int, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        raws: list[bytes] = []
        weights: list[int] = []
        ys: list[list[float]] = []

        def block() -> pa.RecordBatch:
            y = np.array(ys)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (part << _SHIFT) + at, "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist(),
                        "keys": b"".join(keys), "raws": b"".join(raws), "weights": np.array(weights, "<i8").tobytes(),
                    }
                ],
                schema=pa.schema(
                    [("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("keys", pa.binary()), ("raws", pa.binary()), ("weights", pa.binary())]
                ),
            )

        for batch in slices(batches, BLOCK):
            for key, raw, weight, y in zip(*[c.to_pylist() for c in columns(batch, ["key", "raw", "weight", "y"])], strict=True):
                keys.append(key)
                raws.append(raw)
                weights.append(weight)
                ys.append(y)
                if len(keys) == BLOCK:
                    yield block()
                    at += 1
                    keys, raws, weights, ys = [], [], [], []
        if keys:
            yield block()

    return run


def block_pairs(boxes: DataFrame, reach: float, widest: int = 64, fan_bits: int = 4) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes are within reach. Groups of consecutive blocks are joined
    first, and their members only where the groups' boxes are within reach."""
    spark = boxes.sparkSession
    top = boxes.agg(F.max("block")).first()[0]
    shifts = list(range(0, 64 if top is None else max(1, top.bit_length() + fan_bits), fan_bits))
    sizes = boxes.agg(*[F.countDistinct(F.shiftright("block", s)).alias(f"s{s}") for s in shifts]).first()
    levels = [0]
    for s in shifts[1:]:
        if sizes[f"s{levels[-1]}"] > widest and sizes[f"s{s}"] < sizes[f"s{levels[-1]}"]:
            levels.append(s)
    dims = len(boxes.schema) and boxes.select(F.size("lo")).limit(1).collect()
    dims = dims[0][0] if dims else 0

    def at(shift: int) -> DataFrame:
        least, most = [F.min(F.col("lo")[i]) for i in range(dims)], [F.max(F.col("hi")[i]) for i in range(dims)]
        return boxes.groupBy(F.shiftright("block", shift).alias("g")).agg(F.array(*least).alias("lo"), F.array(*most).alias("hi"))

    def close(df: DataFrame) -> DataFrame:
        gap = [F.greatest(F.lit(0.0), F.col("la")[i] - F.col("hb")[i], F.col("lb")[i] - F.col("ha")[i]) for i in range(dims)]
        return df.where((F.col("a") <= F.col("b")) & (sum((g * g for g in gap), F.lit(0.0)) <= reach)).select("a", "b")

    groups = sorted((r.g, r.lo, r.hi) for r in at(levels[-1]).collect())
    pairs = []
    if groups:
        lo, hi = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
        pairs = [(groups[i][0], groups[j][0]) for i, j in np.argwhere(apart(lo, hi, lo, hi) <= reach).tolist() if i <= j]
    found = spark.createDataFrame(pairs, "a long, b long")
    for above, shift in zip(levels[:0:-1], levels[-2::-1], strict=True):
        members = at(shift).withColumn("p", F.shiftright("g", above - shift))
        left = members.select(F.col("p").alias("pa"), F.col("g").alias("ga"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        right = members.select(F.col("p").alias("pb"), F.col("g").alias("gb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        wider = found.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
        joined = wider.join(left, "pa").join(right, "pb").withColumnsRenamed({"ga": "a", "gb": "b"})
        found = written(close(joined), "block-pairs")
    return found


def links_of_width(distinct: DataFrame, width: int, threshold: float, leading: int) -> DataFrame:
    """(key, n, root) of the vectors of one length, a row for each pair of strips in which a vector has links."""
    leading = min(leading, width)
    axes = principal_axes(distinct, width, leading)
    edge = float(np.sqrt(max(2 - 2 * threshold, 1e-12)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            y = _units(columns(batch, ["raw"])[0].to_pylist(), width) @ axes
            grid = np.floor(y / edge).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*columns(batch, ["key", "weight", "raw"]), pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(grid.tolist(), pa.list_(pa.int64()))],
                names=["key", "weight", "raw", "y", "cell"],
            )

    placed = distinct.mapInArrow(cells, "key binary, weight long, raw binary, y array<double>, cell array<long>")
    order = [F.col("cell")[i] for i in range(leading)]
    blocks = placed.repartitionByRange(*order, "key").sortWithinPartitions(*order, "key").drop("cell")
    schema = "block long, lo array<double>, hi array<double>, keys binary, raws binary, weights binary"
    blocks = written(blocks.mapInArrow(_blocks(width, leading), schema), "vector-blocks")
    reach = 2 - 2 * threshold + 1e-9
    blocks = blocks.withColumn("strip", F.shiftright("block", _STRIP))
    ends = [F.array(*[f(F.col(c)[i]) for i in range(leading)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    pairs = block_pairs(blocks.groupBy("strip").agg(*ends).withColumnRenamed("strip", "block"), reach)

    def compare(table: pa.Table) -> pa.Table:
        """The links between two strips' blocks, or within one strip."""
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        one, other = rows[0]["a"], rows[0]["b"]
        units = [_units([r["raws"]], width) for r in rows]
        weights = [np.frombuffer(r["weights"], "<i8") for r in rows]
        starts = np.cumsum([0, *map(len, units)])
        lo, hi = (np.array([r[c] for r in rows]) for c in ("lo", "hi"))
        n, parent = np.zeros(starts[-1], np.int64), np.arange(starts[-1])
        for i, j in np.argwhere(apart(lo, hi, lo, hi) <= reach).tolist():
            if j < i or (rows[i]["strip"], rows[j]["strip"]) != (one, other):
                continue
            got, roots = join_blocks(units[i], weights[i], units[j], weights[j], axes, threshold, i == j)
            at = np.arange(starts[i], starts[i + 1])
            at = at if i == j else np.concatenate([at, np.arange(starts[j], starts[j + 1])])
            n[at] += got
            _unite(parent, at, at[roots])
        keys = b"".join(r["keys"] for r in rows)
        on = np.flatnonzero(n)
        name = lambda i: keys[16 * i : 16 * i + 16]
        return pa.table({"key": pa.array([name(i) for i in on], pa.binary()), "n": pa.array(n[on]), "root": pa.array([name(i) for i in parent[on]], pa.binary())})

    ends_of = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))
    return ends_of.join(blocks, "strip").groupBy("a", "b").applyInArrow(compare, "key binary, n long, root binary")


def link_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, leading: int = LEADING) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(_vectors, f"vec_id {kind}, key binary, raw binary"), "vectors")
    distinct = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.first("raw").alias("raw"))
    distinct = written(distinct, "distinct-vectors")
    width = (F.length("raw") / 8).cast("int")
    widths = sorted(r.w for r in distinct.select(width.alias("w")).distinct().collect()) or [1]
    found = links_of_width(distinct.where(width == widths[0]), widths[0], threshold, leading)
    for w in widths[1:]:
        found = found.unionByName(links_of_width(distinct.where(width == w), w, threshold, leading))
    found = written(found, "vector-links")
    parts = connected_components(found.select(F.col("key").alias("u"), F.col("root").alias("v")), "vector-components")
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = nodes.join(counted, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    nodes = nodes.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    nodes = nodes.withColumn("own", salt("key"))
    first = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.collect_set("own").alias("own"))
    nodes = nodes.join(first.select("component", "component_id", F.explode("own").alias("own")), ["component", "own"])
    # Equal vectors may be many: their key meets its rows in the parts that they are dealt to.
    dealt = rows.select("vec_id", "key", salt("vec_id").alias("part"))
    parts = dealt.where("key is not null").groupBy("key").agg(F.collect_set("part").alias("parts"))
    nodes = nodes.join(parts, "key").select("key", "n_links", "component_id", F.explode("parts").alias("part"))
    out = dealt.join(nodes, ["key", "part"], "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair compared: exact, and quadratic, for small tables. Components by repeated least labels.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u),
c AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id"""
