"""Benchmark decontamination: which words of a document lie in a passage of a benchmark.

Every benchmark text gives windows of consecutive words. A window can occur only where all its words do,
so the one rarest in the corpus is the prefix that a document must hold: documents are probed with the
rarest words alone, the word's place in the window bounds where the window could start and end, and the
words there are compared exactly. Rarity is counted over all documents.

Benchmark windows go to the tasks in blocks of about ``BLOCK_CHARS`` characters of benchmark text, filled by running
size; an item beyond a block is cut into pieces that share a window less a word. A larger benchmark makes more passes
over the documents, never a larger block.

Null texts have no words. Items without words give no windows; rows without an item id are left out.
Repeated documents each get their row, repeated items count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import columns, renamed, slices, texts, words, written

WINDOW = 8
#: Characters of benchmark text in one block, which bounds what is sent to a task.
BLOCK_CHARS = 2_000_000

_STATE = [
    T.StructField("dc_n_words", T.LongType()),
    T.StructField("dc_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("dc_items", T.ArrayType(T.StringType())),
]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.string())


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, as (id, words), in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.where("item is not null and text is not null").distinct()
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in items.toLocalIterator():
        for piece in pieces(words(r.text.encode()), window, block_chars):
            more = sum(map(len, piece)) + len(piece)
            if block and size + more > block_chars:
                yield sorted(block)
                block, size = [], 0
            block.append((r.item, piece))
            size += more
    if block:
        yield sorted(block)


def pieces(ws: list[bytes], window: int, chars: int) -> Iterator[list[bytes]]:
    """Parts of an item under about ``chars`` characters, each window of it in one of them."""
    at = 0
    while at < max(1, len(ws) - window + 1):
        stop, size = at, 0
        while stop < len(ws) and (size <= chars or stop - at < window):
            size += len(ws[stop]) + 1
            stop += 1
        yield ws[at:stop]
        if stop >= len(ws):
            return
        at = stop - window + 1


def word_counts(documents: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the (bounded) vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, 1024, "text"):
            for t in texts(batch, "text"):
                seen.update([w for w in words(t) if w in vocabulary])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"]
        )

    counted = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def index_windows(
    items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int = WINDOW
) -> tuple[dict[bytes, list[tuple[int, int]]], dict[tuple[bytes, ...], list[str]]]:
    """Probes (rarest word to its places and window lengths) and windows (words to items)."""
    probes: dict[bytes, set[tuple[int, int]]] = {}
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for item, ws in items:
        size = min(window, len(ws))
        for at in range(len(ws) - size + 1 if size else 0):
            key = tuple(ws[at : at + size])
            if key not in windows:
                place = min(range(size), key=lambda i: (counts.get(key[i], 0), key[i], i))
                probes.setdefault(key[place], set()).add((place, size))
            windows.setdefault(key, set()).add(item)
    return {w: sorted(x) for w, x in probes.items()}, {k: sorted(x) for k, x in windows.items()}


def find(ws: list[bytes], probes: dict, windows: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint ascending word ranges inside windows, and the items whose windows occur."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if probes.keys().isdisjoint(ws):
        return spans, items
    n = len(ws)
    for i in [i for i, w in enumerate(ws) if w in probes]:
        for place, size in probes[ws[i]]:
            begin = i - place
            if begin >= 0 and begin + size <= n and (got := windows.get(tuple(ws[begin : begin + size]))):
                spans.append((begin, begin + size))
                items.update(got)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def match(
    documents: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    text_col: str = "text",
    least_items: int = 2,
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Columns ``carry`` of every document, whatever their names, then dc_n_words, dc_spans (word ranges inside windows), dc_items
    (sorted ids) and dc_contaminated (``least_items`` items or more)."""
    spark = documents.sparkSession
    plain, kept = renamed(documents, carry)
    state = plain.select(*kept, F.col(plain.columns[documents.columns.index(text_col)]).cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, block_chars, window)
    items, ahead = next(blocks, []), True
    while ahead:
        following = next(blocks, None)
        ahead = following is not None
        counts = word_counts(documents, {w for _, ws in items for w in ws}, text_col) if items else {}
        shipped = spark.sparkContext.broadcast(index_windows(items, counts, window))
        keep = [*kept, "text"] if ahead else kept
        schema = T.StructType([*[state.schema[c] for c in keep], *_STATE])
        state = state.mapInArrow(_matcher(shipped, keep, schema), schema)
        state = written(state, "decontaminate") if ahead else state
        items = following
    return state.withColumn("dc_contaminated", F.size("dc_items") >= least_items).toDF(*carry, *[f.name for f in _STATE], "dc_contaminated")


def _matcher(shipped, keep: list[str], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, windows = shipped.value
        for batch in slices(batches, 1024, "text"):
            earlier = columns(batch, ["dc_spans", "dc_items"]) if "dc_spans" in batch.schema.names else None
            n_words, spans, items = [], [], []
            for row, text in enumerate(texts(batch, "text")):
                ws = words(text)
                found, named = find(ws, probes, windows)
                if earlier:
                    found = merged([*found, *[(x["start"], x["end"]) for x in earlier[0][row].as_py()]])
                    named = named | set(earlier[1][row].as_py())
                n_words.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(named))
            yield pa.RecordBatch.from_arrays(
                [*columns(batch, keep), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)],
                names=schema.names,
            )

    return run


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = match(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        F.col("dc_contaminated").alias("contaminated"),
    )


#: Words, windows and their places in plain SQL; a window is its words, joined.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT item, least(len(w), 8) AS size, unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 2), lambda i: array_to_string(w[i : i + least(len(w), 8) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT rid, dw.size, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, size, i FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
