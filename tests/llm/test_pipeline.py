from __future__ import annotations

import pytest

import corpus_pipeline as cp
from tallyframe.llm import decontaminate as dc
from tallyframe.llm import near_copies as nc
from tallyframe.llm.common import written
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_near_copies import brute as classes
from tests.llm.test_secret_ledger import brute as secrets


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What every stage takes and returns."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf), "t")
        seen.append((docs, out))
        docs = out
    return seen


def test_columns_of_documents_stay(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near copies", "decontamination", "secrets", "segmentations"]
    for before, after in stages[:4]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_one_of_each_group_stays(stages):
    before, after = (x.collect() for x in stages[1])
    rows = [(r.doc_id, r.text) for r in before]
    assert sorted(r.doc_id for r in after) == sorted({c for c in classes(rows)})


def test_leaked_documents_go(spark, sf, stages):
    before, after = (x.collect() for x in stages[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaked(r.text, items)[2])


def test_secrets_are_masked_and_texts_else_kept(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[3])
    assert before.keys() == after.keys()
    for k, r in after.items():
        if secrets(before[k].text):
            assert "[SECRET]" in r.text and not secrets(r.text) and r.n_chars == len(r.text)
        else:
            assert r == before[k]


def test_run_is_the_stages_in_a_row(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.draw, tuple(r.ids)) for r in df.collect())
    assert key(cp.run(spark, sf)) == key(stages[-1][1])
    assert cp.ORACLE_SQL is None and dc and nc


def test_nulls_repeats_and_clashing_columns(spark, sf, tmp_path):
    secret = "token=abcdefgh and more words here " * 2
    rows = [(1, None, None, "s", 0), (2, "", "en", "s", 0), (3, secret, "en", None, len(secret)), (3, secret, "en", None, len(secret)), (None, "a " * 9000, "en", "s", 18000), (5, "x", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "spans", "masked", "node", "kept", "toxic", "content", "blob"):
        df = df.withColumn(name, cp.F.lit("own"))
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for _, stage in cp.STAGES[:4]:
        columns, docs = docs.columns, written(stage(spark, docs, sf), "t")
        assert docs.columns == columns and docs.where("row <> 'own' or spans <> 'own' or masked <> 'own'").count() == 0
    got = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [k for k, _ in got] == [0, 1, 2, 3, 5] and got[3][1] == "[SECRET] and more words here " * 2
    assert cp.STAGES[4][1](spark, docs, sf).count() > 5
    empty = docs.limit(0)
    empty.write.parquet(str(tmp_path / "none"))
    for _, stage in cp.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "none")), sf).count() == 0
