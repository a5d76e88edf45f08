from __future__ import annotations

import re

from tallyframe.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items):
    ws, hit, named = split(doc), set(), set()
    for item, text in items:
        iw = split(text)
        n = min(8, len(iw))
        for a in range(len(iw) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[a : a + n]:
                    hit.update(range(p, p + n))
                    named.add(str(item))
    return len(ws), len(hit), sorted(named)


ITEMS = [(1, "One two three four five six seven eight nine ten"), (2, "two THREE four"), (3, None), (4, "!!"), (5, "é漢 x"), (1, "rare words"), (None, "ten")]
DOCS = [None, "", "zero one two three four five six seven eight nine ten eleven", "two, three; four two three four", "é漢 X", "rare words words", "one two three", "ten", "a " * 3000]


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(DOCS + DOCS)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    items = [x for x in ITEMS if x[0] is not None]
    want = {i: brute(t, items) for i, t in enumerate(DOCS + DOCS)}
    for size in (dc.BLOCK_CHARS, 15):
        got = {}
        for r in dc.match(docs, bench, ["doc_id", "n_words"], block_chars=size).collect():
            got[r.doc_id] = (r.dc_n_words, sum(s.end - s.start for s in r.dc_spans), r.dc_items)
            assert r.dc_contaminated == (len(r.dc_items) >= 2) and r.n_words == 5
        assert got == want


def test_rarest_word_is_the_prefix():
    probes, _ = dc.index_windows([("1", [b"a", b"b", b"c"])], {b"a": 9, b"b": 1, b"c": 5})
    assert probes == {b"b": [(1, 3)]}


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.match(none, bench, ["doc_id"]).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in dc.match(some, bench, ["doc_id"]).collect()] == [(1, 2, [], [], False)]
