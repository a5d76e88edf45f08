"""Fixity audit of WARC replicas by Merkle trees over records and their offset ranges.

Pages become WARC records in archives of consecutive ids. A leaf hashes a record's offset range and SHA-256
digest; an inner node hashes the range it covers and its up to ``FAN`` children in order. Replicas are compared
at the roots of their archives, then only below nodes that differ, down to the records. Only digests and
ranges move between tasks, never the payload.

A record that is only at another place is intact: what differs is aligned by digest before it is named, so that a missing
record leaves the ones after it whole.

A null page or url counts as empty. Rows without an id share archives picked by their digest. Repeated rows
are records of their own; rows of one id are ordered by digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import written

FAN = 16
PAGES_PER_ARCHIVE, _ARCHIVE_BITS = 1024, 10
SEPARATOR = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One record without its closing separator."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(SEPARATOR),
    )
    return F.concat(head, body)


def records(pages: DataFrame) -> DataFrame:
    """(page_id, archive, record) of every page."""
    record = warc_record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    # Archives of rows without an id are as many as keep them at about the size of the others; below all named ones.
    first, loose = rows.agg(F.min("page_id"), F.count_if(F.col("page_id").isNull())).first()
    below = min(first or 0, 0) >> _ARCHIVE_BITS
    nameless = F.lit(below - 1) - F.pmod(F.xxhash64("record"), F.lit(loose // PAGES_PER_ARCHIVE + 1))
    return rows.select("page_id", F.coalesce(F.shiftright("page_id", _ARCHIVE_BITS), nameless).alias("archive"), "record")


def leaves(rows: DataFrame) -> DataFrame:
    """(page_id, archive, idx, start, stop, digest, hash) of every record, with its place in its archive."""
    whole = F.concat("record", F.lit(SEPARATOR))
    small = rows.select("page_id", "archive", F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length(whole).cast("long").alias("size"))
    order = Window.partitionBy("archive").orderBy("page_id", "digest")
    placed = small.select(
        "page_id", "archive", "digest", (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"), "size",
    )
    return leaf_hashes(placed.withColumn("start", F.col("stop") - F.col("size")))


def leaf_hashes(placed: DataFrame) -> DataFrame:
    hashed = F.sha2(F.concat_ws(":", F.lit("leaf"), "start", "stop", "digest").cast("binary"), 256)
    return placed.select("page_id", "archive", "idx", "start", "stop", "digest", hashed.alias("hash"))


def grow(below: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level of nodes: (archive, idx, start, stop, hash). No group has over ``fan`` members."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    grouped = below.groupBy("archive", F.floor(F.col("idx") / fan).alias("idx")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), kids.alias("kids")
    )
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    hashed = F.sha2(F.concat_ws(":", F.lit("node"), "start", "stop", joined).cast("binary"), 256)
    return grouped.select("archive", "idx", "start", "stop", hashed.alias("hash"))


def tree(bottom: DataFrame, height: int, fan: int = FAN) -> list[DataFrame]:
    """Levels from the leaves up; the last has one node for each archive."""
    levels = [bottom.select("archive", "idx", "start", "stop", "hash")]
    for _ in range(height):
        levels.append(grow(levels[-1], fan))
    return levels


def height_of(*bottoms: DataFrame, fan: int = FAN) -> int:
    most = max((b.agg(F.max("idx")).first()[0] or 0) for b in bottoms) + 1
    height = 0
    while fan**height < most:
        height += 1
    return height


def audit(ours: DataFrame, theirs: DataFrame, fan: int = FAN) -> DataFrame:
    """Records that differ, as (archive, idx, other, status): their places in ``ours`` and in ``theirs``; corrupt (of one id,
    with another digest), missing or extra in ``theirs``. Both are tables of leaves, written."""
    height = height_of(ours, theirs, fan=fan)
    a, b = tree(ours, height, fan), tree(theirs, height, fan)

    def differing(level: int, above: DataFrame | None) -> DataFrame:
        x, y = a[level].select("archive", "idx", F.col("hash").alias("ha")), b[level].select("archive", "idx", F.col("hash").alias("hb"))
        if above is not None:
            bad = above.select("archive", F.col("idx").alias("up"))
            below = lambda z: z.withColumn("up", F.floor(F.col("idx") / fan)).join(bad, ["archive", "up"], "left_semi").drop("up")
            x, y = below(x), below(y)
        return x.join(y, ["archive", "idx"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))

    bad = None
    for level in range(height, -1, -1):
        bad = differing(level, bad)
        bad = written(bad, "fixity")
    places = bad.select("archive", "idx")

    def side(leaves_: DataFrame, name: str) -> DataFrame:
        return leaves_.join(places, ["archive", "idx"], "left_semi").select(*[F.col(c).alias(f"{name}_{c}") for c in ("archive", "idx", "page_id", "digest")])

    def aligned(x: DataFrame, y: DataFrame, by: str) -> DataFrame:
        """Rows of both sides paired by archive and ``by``, equal ones in their order."""
        nth = lambda z, s: z.withColumn(f"{s}_nth", F.row_number().over(Window.partitionBy(f"{s}_archive", f"{s}_{by}").orderBy(f"{s}_idx")))
        on = [F.col(f"our_{c}").eqNullSafe(F.col(f"their_{c}")) for c in ("archive", by, "nth")]
        return nth(x, "our").join(nth(y, "their"), on, "full").drop("our_nth", "their_nth")

    moved = aligned(side(ours, "our"), side(theirs, "their"), "digest")
    sides = [[c for c in moved.columns if c.startswith(s)] for s in ("our", "their")]
    lost = moved.where("their_archive is null").select(sides[0])
    found = moved.where("our_archive is null").select(sides[1])
    got = aligned(lost, found, "page_id").select(F.coalesce("our_archive", "their_archive").alias("archive"), F.col("our_idx").alias("idx"), F.col("their_idx").alias("other"))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("idx").isNull(), "extra").otherwise("corrupt")
    return got.withColumn("status", status)


def write_warc(rows: DataFrame, folder: str) -> None:
    """The records as WARC files, one for each archive; the separator ends every record."""
    order = F.sha2(F.concat("record", F.lit(SEPARATOR)).cast("binary"), 256)
    dealt = rows.withColumn("digest", order).repartition("archive").sortWithinPartitions("archive", "page_id", "digest")
    dealt.select("archive", F.col("record").alias("value")).write.partitionBy("archive").option("lineSep", SEPARATOR).text(folder)


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d*)>")


def parse_warc(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """(id, start, stop, digest) of the records of a file. A header without a sound length ends its record at
    the next header, so damage stays where it is."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        header = data[at : head if head >= 0 else len(data)]
        m = _LENGTH.search(header)
        stop = head + 8 + int(m[1]) if m and head >= 0 else -1
        if not (head + 8 <= stop <= len(data)) or (stop < len(data) and not data.startswith(b"WARC/1.0\r\n", stop)):
            following = data.find(b"\r\n\r\nWARC/1.0\r\n", at)
            stop = following + 4 if following >= 0 else len(data)
        name = _ID.search(header)
        yield (int(name[1]) if name and name[1] else None), at, stop, hashlib.sha256(data[at:stop]).hexdigest()
        at = stop


def scan_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of a written replica. One file is read as a whole, so archives bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = [(n, archive, i, s, e, d) for i, (n, s, e, d) in enumerate(parse_warc(content))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_LEAF)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    named = files.select(F.regexp_extract("path", r"archive=(-?\d+)", 1).cast("long").alias("archive"), "content")
    return leaf_hashes(named.mapInArrow(run, "page_id long, archive long, idx long, start long, stop long, digest string"))


_LEAF = pa.schema([("page_id", pa.int64()), ("archive", pa.int64()), ("idx", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.string())])
#: The replica that the query audits has its first byte changed in pages whose id leaves this remainder.
ROT_EVERY, ROT_AT = 97, 13


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica with known bit rot: every record with its place, digest and whether it is intact."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rotten = (F.pmod("page_id", F.lit(ROT_EVERY)) == ROT_AT) & (F.length("html") > 0)
    replica = pages.withColumn("html", F.when(rotten, F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html")))
    ours, theirs = written(leaves(records(pages)), "leaves"), written(leaves(records(replica)), "leaves")
    bad = audit(ours, theirs)
    out = ours.join(bad.where("idx is not null"), ["archive", "idx"], "left")
    return out.select(
        "page_id", "archive", F.col("idx").alias("ordinal"), F.col("start").alias("offset"),
        (F.col("stop") - F.col("start")).alias("length"), F.col("digest").alias("sha256"), F.col("status").isNull().alias("intact"),
    )


SQL = f"""
WITH r AS (
  SELECT page_id, html, CAST(floor(page_id / {PAGES_PER_ARCHIVE}) AS BIGINT) AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) ||
         'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
         'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) ||
         chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
d AS (SELECT page_id, html, archive, sha256(record) AS sha256, CAST(strlen(record) AS BIGINT) AS length FROM r)
SELECT page_id, archive, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal,
       CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, sha256,
       NOT (page_id % {ROT_EVERY} = {ROT_AT} AND coalesce(length(html), 0) > 0) AS intact
FROM d WINDOW w AS (PARTITION BY archive ORDER BY page_id, sha256)"""
