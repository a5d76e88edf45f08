from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import language as lg
from tallyframe.llm import toxicity as tx


def test_ordinal_fit_recovers_weights():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    s = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    grade = (s > 1).astype(int) + (s > 2.5)
    r, c = np.nonzero(x)
    w, t = tx.fit_ordinal(r, c, x[r, c], grade, 3, 3, ridge=0)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(t, [1, 2.5], atol=0.25) and t[0] < t[1]
    p = tx.Model(np.arange(3), w, t).grades(np.array([0.0, 5.0]))
    assert np.allclose(p.sum(axis=1), 1) and p[1, 2] > p[0, 2]


def test_toxic_documents_are_caught_and_others_left(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = tx.fit(documents, labels.where(~held))
    scored = tx.score(documents, model, ["doc_id"]).join(labels.where(held), "doc_id").toPandas()
    toxic = scored["toxic"] > 0
    assert scored.loc[toxic, "tx_rejected"].mean() > 0.85  # some labels are wrong
    assert scored.loc[~toxic, "tx_rejected"].mean() < 0.01
    assert scored.loc[toxic, "tx_severity"].mean() > 1 > scored.loc[~toxic, "tx_severity"].mean()


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "vile vile thing", 7), (4, "fine thing", 7), (4, "fine thing", 7), (None, "x", 7)], "doc_id long, text string, tx_grade int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    got = tx.score(docs, tx.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 6
    none = tx.fit(docs, labels.where("toxic = 0"))
    assert none is None and not any(r.tx_rejected for r in tx.score(docs, none, ["doc_id"]).collect())
    assert tx.score(docs.limit(0), None, ["doc_id"]).count() == 0


def test_language_held_out_accuracy(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    got = lg.op9_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got["held_out"]]
    assert len(out) > 100 and (out["lang"] == out["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_never_learns_from_held_out(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    lied = documents.withColumn("lang", F.when(lg.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in lg.fit(lied).languages


def test_language_of_odd_rows(spark, sf):
    model = lg.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "é"), (None, "the of and " * 9000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lg.predict(docs, model, ["doc_id"]).collect()}
    assert [got[i].li_lang for i in (1, 2, 3)] == ["und"] * 3 and got[4].li_lang != "und" and got[None].li_lang == "en"
    assert lg.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.li_lang for r in lg.predict(docs, None, ["doc_id"]).collect()} == {"und"}


def test_calibration_rejects_what_is_often_wrong():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    strength = rng.uniform(0, 6, 2000)
    seen = np.where(rng.random(2000) < 1 / (1 + np.exp(-strength)), y, 1 - y)
    logits = np.zeros((2000, 2))
    logits[np.arange(2000), seen] = strength * 3
    temperature, least = lg.calibrate(logits, y)
    assert 2 < temperature < 4.5 and 0.9 < least < 1


def test_columns_may_have_any_names(spark, sf):
    """Carried columns named like the operators' own, in any case, and twice."""
    from tallyframe.llm import decontaminate as dc
    from tallyframe.llm import page_text as pt
    from tallyframe.llm import segmentations as sg

    import public_tokenizers

    own = ["tx_rejected", "TX_Grade", "li_lang", "dc_items", "dc_spans", "sg_text", "sg_ids", "sg_key", "pt_host", "pt_html", "pt_text", "ids", "row", "tokens", "main"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for c in own:
        docs = docs.withColumn(c, F.lit("own"))
    carry, path = ["doc_id", *own], public_tokenizers.path("piece_bpe_32k.model")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    segmented = sg.segment(docs, path, carry)
    for df in (
        tx.score(docs, None, carry), lg.predict(docs, None, carry), dc.match(docs, benchmark, carry, block_chars=20_000), segmented, sg.decode(segmented.toDF(*[f"{c}{i}" for i, c in enumerate(segmented.columns)]), path, ["doc_id0"], f"sg_ids{len(carry) + 1}"),
        pt.extract(docs, carry, url_col="source", html_col="text"),
    ):
        assert df.count() >= 20 and all(set(r) in ({"own"}, set()) for r in (tuple(v for c, v in zip(df.columns, row, strict=True) if c in own and v == "own") for row in df.collect()))


def test_scores_against_plain_python(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    model, speech = tx.fit(documents, labels), lg.fit(documents)
    weight = {int(b): w for b, w in zip(model.buckets, model.weights, strict=True)}
    got = {r.doc_id: r for r in tx.score(documents, model, ["doc_id"]).collect()}
    said = {r.doc_id: r for r in lg.predict(documents, speech, ["doc_id"]).collect()}
    for k, text in texts.items():
        distinct = set(re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())))
        holds = {}
        for w in distinct:
            for f in tx.features_of(w):
                holds[f] = holds.get(f, 0) + 1
        s = sum(weight.get(f, 0.0) * math.log(1 + n) for f, n in holds.items())
        p = [1 / (1 + math.exp(-(t - s))) for t in model.thresholds]
        assert math.isclose(got[k].tx_probability, 1 - p[0], abs_tol=1e-9) and math.isclose(got[k].tx_severity, (p[1] - p[0]) + 2 * (1 - p[1]), abs_tol=1e-9)
        if lg.has_letter((text or "").encode()):
            counts = lg.grams(text.encode())
            z = [(sum(int(n) * speech.table[b, j] for b, n in enumerate(counts) if n) / counts.sum() + speech.bias[j]) / speech.temperature for j in range(len(speech.languages))]
            assert said[k].li_lang == speech.languages[z.index(max(z))] and math.isclose(said[k].li_score, 1 / sum(math.exp(x - max(z)) for x in z), abs_tol=1e-9)


def test_items_beyond_a_block_are_cut_without_loss():
    from tallyframe.llm import decontaminate as dc

    ws = [b"%d" % i for i in range(500)]
    for n in (0, 1, 7, 8, 9, 500):
        parts = list(dc.pieces(ws[:n], 8, 60))
        windows = {tuple(p[i : i + 8]) for p in parts for i in range(max(1, len(p) - 7))}
        assert windows == {tuple(ws[:n][i : i + 8]) for i in range(max(1, n - 7))} and all(len(p) <= 40 for p in parts)
