from __future__ import annotations

from collections import Counter

import numpy as np

from tallyframe.llm import near_copies as nc
from tallyframe.llm.common import words
from tallyframe.llm.components import connected_components

RNG = np.random.default_rng(3)


def text(n, seed=None):
    rng = RNG if seed is None else np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def bag(t):
    ws = words((t or "").encode())
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def similarity(a, b):
    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


def brute(rows):
    """Class of each (id, text) row: exact copies and links of 0.8 or more, joined up."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if words((a or "").encode()) and words((b or "").encode()) and (a == b or similarity(a, b) >= 0.8):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [min(least[find(i)]) for i in range(len(rows))]


def test_signatures_estimate_weighted_jaccard():
    def signature(counts):
        h = np.array(sorted(counts), np.uint64)
        return nc.signatures(h, np.array([counts[int(k)] for k in h]), np.zeros(len(h), int), 1)[0]

    gaps = []
    for _ in range(30):
        keys = [int(k) for k in RNG.integers(0, 2**63, 60)]
        a = {k: int(RNG.integers(1, 40)) for k in keys[:45]}
        b = {k: max(1, a.get(k, 5) + int(RNG.integers(-3, 4))) for k in keys[10:]}
        both = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys)
        total = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        gaps.append((signature(a) == signature(b)).mean() - both / total)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_batches_do_not_change_signatures():
    bags = [nc.shingles(words(text(n).encode()), nc._KNOWN) for n in (3, 40, 200)]
    doc = np.repeat([0, 1, 2], [len(h) for h, _ in bags])
    whole = nc.signatures(np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]), doc, 3)
    for i, (h, c) in enumerate(bags):
        assert (nc.signatures(h, c, np.zeros(len(h), int), 1)[0] == whole[i]).all()


def test_classes_against_brute_force(spark):
    base = [text(n, n) for n in (30, 60, 120, 300)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base * 3):
        ws = t.split()
        for _ in range(1 + i % 3):
            ws[int(RNG.integers(len(ws)))] = "changed"
        rows.append((100 + i, " ".join(ws)))
    shared = text(55, 999)
    rows += [(200 + i, text(40, 500 + i) + " " + shared) for i in range(12)]  # a common passage is no near copy
    rows += [(300, base[0]), (301, base[0]), (302, None), (303, ""), (304, ""), (305, "!!"), (306, "!!"), (307, "one two"), (308, "one two"), (309, "two one"), (310, "a " * 4000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: r for r in nc.near_copies(df).collect()}
    want = brute(rows)
    assert {k: got[k].class_id for k, _ in rows} == {k: c for (k, _), c in zip(rows, want, strict=True)}
    assert all(got[k].kept == (k == c) for (k, _), c in zip(rows, want, strict=True))


def test_repeated_rows_keep_one(spark):
    t = text(50, 1)
    df = spark.createDataFrame([(1, t), (1, t), (1, text(50, 2)), (None, t)], "doc_id long, text string")
    got = nc.near_copies(df).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.class_id for r in got) == [1, 1, 1, 1]


def test_a_large_group_of_copies_makes_few_pairs(spark):
    ws = text(80, 5).split()
    rows = []
    for i in range(300):
        own = list(ws)
        own[i % 80] = f"c{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = nc.written(df.select("doc_id", nc.F.col("doc_id").cast("string").alias("row"), "text").mapInArrow(nc._sketch, "doc_id long, row string, node binary, bands array<long>, marks binary"), "t")
    assert nc.candidates(sketches).count() < 300 * 60
    assert nc.near_copies(df).select("class_id").distinct().count() == 1


def _straddling(n, words_, edits, seed):
    """Variants of one text whose similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = text(words_, seed).split()
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(int(rng.integers(edits[0], edits[1] + 1))):
            ws[int(rng.integers(words_))] = f"e{int(rng.integers(10**9))}"
        rows.append((i, " ".join(ws)))
    return rows


def test_a_group_that_straddles_the_threshold_loses_no_pair_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(nc, "PART", 16)
    rows = _straddling(400, 200, (3, 6), 11)
    found = [nc.shingles(words(t.encode()), nc._KNOWN) for _, t in rows]
    doc = np.repeat(np.arange(len(rows)), [len(h) for h, _ in found])
    keys = nc.bands(nc.signatures(*(np.concatenate(a) for a in zip(*found, strict=True)), doc, len(rows)))
    marks = [nc.expanded(h, c).tobytes() for h, c in found]
    want = list(range(len(rows)))  # all pairs of a bucket verified
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and (keys[i] == keys[j]).any() and nc.overlap(marks[i], marks[j]) >= nc.THRESHOLD:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in nc.near_copies(df).collect()}
    assert len(set(want)) > 20
    assert got == dict(enumerate(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 104), 100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert nc.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
