"""Secret scans over versions of texts, each distinct content once for each version of each rule.

Every version is addressed by the SHA-256 of its content (its blob). A ledger holds the (blob, rule,
rule version) pairs scanned so far; a scan looks only at pairs that it lacks, then joins findings back to
every path with that content. All of it is DataFrame expressions.

A null text is the empty text. Repeated rows and copies share a blob and each gets its findings. A row's
columns besides id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import salt, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has under ``least`` characters
    are dropped after matching. ``probe`` is a cheaper pattern found in every text with a finding."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    probe: str


# The patterns of the contract, in the order in which kinds are listed.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""({KEYWORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 2, 6, f"""(?:{KEYWORDS})["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]{{6}}"""),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)

SPAN = "struct<start:int,end:int,ord:int,kind:string>"


#: Values folded at once: a fold copies what it has gathered at every step.
_FOLD = 256


def running(values: Column, merge, zero: Column) -> Column:
    """What comes of merging all values of an array before each of them, in about linear time: folds run within blocks
    and over the blocks' totals."""
    kind = "array<int>"

    def fold(xs: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _FOLD).cast("int")), lambda i: F.slice(values, i * _FOLD + 1, F.lit(_FOLD)))
    totals = F.transform(blocks, lambda xs: F.aggregate(xs, zero, merge))
    found = F.flatten(F.zip_with(blocks, fold(totals, zero), fold))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast(kind))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in code points. What lies between matches and the matches alternate, so lengths
    summed up give positions."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    steps = F.zip_with(F.arrays_zip(whole.alias("len"), kept.alias("ok")), gaps, lambda m, gap: F.struct(gap.alias("gap"), F.coalesce(m["len"], F.lit(0)).alias("len"), m["ok"].alias("ok")))

    def placed(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x["gap"] + x["len"]), lambda p, q: p + q, F.lit(0))
        begin = F.zip_with(xs, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), F.coalesce(x["ok"], F.lit(False)).alias("ok")))
        return F.transform(F.filter(begin, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"], x["ord"], x["kind"]))

    return _let(steps, placed).cast(f"array<{SPAN}>")


def address(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, content) of every row; ``blob`` is the SHA-256 of the content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(id_col), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("content"))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, scanned, spans) of distinct blobs with any unseen rule: ``scanned`` lists the rules looked at,
    ``spans`` what they found. ``ledger`` has (blob, rule, version)."""
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", current)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
        todo = F.when(F.col("seen").isNull(), current).otherwise(F.array_except(current, F.col("seen")))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0)
    none = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(
            F.array_contains("todo", f"{r.kind}@{r.version}") & F.col("content").rlike(r.probe),
            _spans(F.col("content"), r, i),
        ).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return blobs.select("blob", F.col("todo").alias("scanned"), F.array_sort(F.concat(*found)).alias("spans"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """What a scan adds to the ledger."""
    pairs = scanned.select("blob", F.explode("scanned").alias("pair"))
    part = lambda i: F.split("pair", "@")[i]
    return pairs.select("blob", part(0).alias("rule"), part(1).cast("int").alias("version"))


def distinct_blobs(addressed: DataFrame) -> DataFrame:
    """One row per content; copies meet after each task has dropped its own."""
    return addressed.groupBy("blob").agg(F.first("content").alias("content"))


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings (id, blob, spans) of every version, and the scan's own (blob, scanned, spans) to add to the
    ledger and to the findings of earlier scans. Give ``findings`` (blob, spans) of those with ``ledger``."""
    addressed = address(versions, id_col, text_col).withColumn("part", salt(id_col))
    scanned = written(scan_blobs(distinct_blobs(addressed), ledger, rules), "scanned-blobs")
    found = scanned.where(F.size("spans") > 0).select("blob", "spans")
    if findings is not None:
        found = (
            found.unionByName(findings.select("blob", "spans"))
            .groupBy("blob")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        )
    # A content may have very many paths: its findings meet them in the parts that they are dealt to.
    parts = addressed.groupBy("blob").agg(F.collect_set("part").alias("parts"))
    found = found.join(parts, "blob").select("blob", "spans", F.explode("parts").alias("part"))
    back = addressed.select(id_col, "blob", "part").join(found, ["blob", "part"], "left")
    none = F.array().cast(f"array<{SPAN}>")
    return back.select(id_col, "blob", F.coalesce("spans", none).alias("spans")), scanned


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans, in order of their starts, replaced by ``mask``."""

    def cut(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda s: s["end"]), lambda p, q: F.greatest(p, q), F.lit(0))
        begun = F.filter(F.zip_with(xs, ends, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at"))), lambda s: s["start"] >= s["at"])
        pieces = F.transform(begun, lambda s: F.concat(F.substring(text, s["at"] + 1, s["start"] - s["at"]), F.lit(mask)))
        last = F.array_max(F.transform(xs, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(spans, cut)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_history(snapshots: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (id, blob, spans) of the snapshots of a history, oldest first, over a ledger that grows with each: what one
    has scanned, those after it take from there. Every scan's part of the ledger is a written table."""
    ledger = findings = found = None
    for snapshot in snapshots:
        here, scanned = scan_versions(snapshot, ledger, findings, id_col, text_col, rules)
        pairs, spans = ledger_rows(scanned), scanned.select("blob", "spans")
        ledger, findings = (pairs, spans) if ledger is None else (ledger.unionByName(pairs), findings.unionByName(spans))
        found = here if found is None else found.unionByName(here)
    return found


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is taken as two snapshots, the older and the newer half of its range of ids (null ids with the older)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = documents.agg(((F.min("doc_id") + F.max("doc_id")) / 2).cast("long")).first()[0]
    newer = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    found = scan_history([documents.where(~newer), documents.where(newer)])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in RULES],
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _kind_sql(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT rid, '{rule.kind}' AS kind, {order} AS ord, unnest(regexp_split_to_array(t, '{pattern}')) AS gap,
           unnest(list_append(regexp_extract_all(t, '{pattern}', 0), '')) AS whole,
           unnest(list_append(regexp_extract_all(t, '{pattern}', {rule.group}), '')) AS part,
           {rule.least} AS least, generate_subscripts(list_append(regexp_extract_all(t, '{pattern}', 0), ''), 1) AS i
    FROM d WHERE regexp_matches(t, '{rule.probe.replace("'", "''")}')"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({" UNION ALL ".join(_kind_sql(r, i) for i, r in enumerate(RULES))}),
placed AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, ord ORDER BY i) AS stop FROM cut),
hit AS (
  SELECT rid, kind, ord, CAST(stop - length(whole) AS BIGINT) AS s, CAST(stop AS BIGINT) AS e
  FROM placed WHERE length(part) >= least),
per AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM hit GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""
