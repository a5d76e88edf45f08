from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tallyframe.llm import secret_ledger as sl

PATTERNS = [(r.kind, re.compile(r.pattern), r.group, r.least) for r in sl.RULES]
HEX = "0123456789abcdef01234567"
ODD = [
    None, "", "nothing", "token=abcdef", "TOKEN: 'abcde", "passwd=token:abcdefgh", "password=token=abcdef api-key=zzzzzz",
    f"token = \"{HEX}\" {HEX}", f"é😀 api_key:{HEX}", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "AKIA" + "A" * 15, HEX[:23], HEX + "x" + HEX,
    "secret=aaa secret=bbbbbb secret=cccccc", "apikey=123456" * 3, "x" * 5000 + " secret: longenough " + "y" * 5000,
]


def brute(text: str | None) -> str:
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_spans_against_python(spark, sf):
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(ODD + ODD)], "doc_id long, text string, blob string")
    got = {r.doc_id: r.s for r in sl.scan_versions(df)[0].select("doc_id", sl._joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(ODD + ODD)}


def test_query_digest(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sl.op3_secret_ledger(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.spans == brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "plain")], "doc_id long, text string")
    found, scanned = sl.scan_versions(first)
    ledger, findings = sl.ledger_rows(scanned).cache(), scanned.select("blob", "spans").cache()
    assert ledger.count() == 2 * len(sl.RULES)
    second = spark.createDataFrame([(1, "token=abcdef"), (3, "plain"), (4, f"new {HEX}")], "doc_id long, text string")
    found, scanned = sl.scan_versions(second, ledger, findings)
    assert scanned.count() == 1
    got = {r.doc_id: [s.kind for s in r.spans] for r in found.collect()}
    assert got == {1: ["assign"], 3: [], 4: ["hex"]}
    newer = tuple(sl.Rule(r.kind, 2 if r.kind == "hex" else 1, r.pattern, r.group, r.least, r.probe) for r in sl.RULES)
    scanned = sl.scan_versions(second, ledger, findings, rules=newer)[1].collect()
    assert sorted(sorted(r.scanned) for r in scanned) == [["access@1", "assign@1", "hex@2"], ["hex@2"], ["hex@2"]]


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([(1, f"é token = \"{HEX}\" and {HEX}!")], "doc_id long, text string")
    out = sl.scan_versions(df)[0].join(df, "doc_id").select(sl.redact(F.col("text"), F.col("spans"))).first()[0]
    assert out == 'é [SECRET]" and [SECRET]!'


def test_empty_table(spark):
    assert sl.scan_versions(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_history_takes_from_the_ledger(spark):
    rows = [[(1, "token=abcdef"), (2, "plain"), (None, None)], [(3, "plain"), (4, "token=abcdef"), (5, f"new {HEX}")], [(6, f"new {HEX}")]]
    got = sl.scan_history([spark.createDataFrame(r, "doc_id long, text string") for r in rows]).collect()
    assert {r.doc_id: [s.kind for s in r.spans] for r in got} == {1: ["assign"], 2: [], None: [], 3: [], 4: ["assign"], 5: ["hex"], 6: ["hex"]}


def test_texts_with_very_many_findings(spark):
    text = "é token=abcdef " * 1500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = sl.scan_versions(df)[0].join(df, "doc_id").select(sl._joined(F.col("spans")).alias("s"), sl.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert r.s == brute(text) and r.t == "é [SECRET] " * 1500
