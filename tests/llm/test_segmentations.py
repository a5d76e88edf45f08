from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers

from tallyframe.llm import segmentations as sg

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sg.Pieces(PATH)


def brute(text):
    """Every segmentation and its log probability."""
    known = {v.decode(): k for k, v in enumerate(PIECES.spelled) if k >= 259}

    def rest(u):
        if not u:
            return [((), 0.0)]
        out = []
        for n in range(1, min(PIECES.longest, len(u)) + 1):
            w = u[:n].replace(sg.SPACE, " ")
            if w in known:
                ids = (known[w],)
            elif n == 1:
                ids = tuple(PIECES.byte_id[list(w.encode())].tolist())
            else:
                continue
            lw = float(PIECES.log_weight[list(ids)].sum())
            out += [(ids + r, lw + x) for r, x in rest(u[n:])]
        return out

    found = [((), 0.0)]
    for u in sg.units_of(text):
        found = [(a + b, x + y) for a, x in found for b, y in rest(u)]
    total = np.logaddexp.reduce([x for _, x in found])
    return {a: x - total for a, x in found}


def draws(text, n, k):
    for row in sg.sample([text] * n, [str(i).encode() for i in range(n)], PIECES, draws=k):
        yield [(tuple(sg.ids_of(c, PIECES).tolist()), lp, inc) for c, lp, inc in row]


def test_draws_follow_sampling_without_replacement():
    text, n = "the cat", 4000
    p = {k: math.exp(v) for k, v in brute(text).items()}
    first, pairs = Counter(), Counter()
    for row in draws(text, n, 3):
        assert len({ids for ids, _, _ in row}) == 3
        for ids, lp, _ in row:
            assert abs(math.exp(lp) - p[ids]) < 1e-6
        first[row[0][0]] += 1
        pairs[row[0][0], row[1][0]] += 1
    for a, n_a in first.most_common(3):
        assert abs(n_a / n - p[a]) < 4 * math.sqrt(p[a] / n)
    for (a, b), n_ab in pairs.most_common(3):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(n_ab / n - want) < 4 * math.sqrt(want / n)


def test_inclusion_scores_weigh_draws_fairly():
    text, n, total = "abba", 3000, 0.0
    for row in draws(text, n, 2):
        total += sum(math.exp(lp - inc) for _, lp, inc in row)
    assert abs(total / n - 1) < 0.1  # the Horvitz-Thompson estimate of the sum of probabilities


def test_all_segmentations_come_out_if_there_are_few():
    every = brute("ab")
    (row,) = draws("ab", 1, 50)
    assert {ids for ids, _, _ in row} == set(every)


def test_round_trip_of_odd_texts(spark):
    odd = [None, "", " ", "  a  b ", "line\n\nline\t x", "漢字 é 😀", "x" * 5000, "a\0b", "▁mark", "tok " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)] + [(1, "", 1)], "doc_id long, text string, sg_rank int")
    got = sg.segment(df, PATH, ["doc_id"]).collect()
    assert all(r.sg_round_trip == (r.doc_id != 8) for r in got)  # the space mark decodes as a space
    n = Counter(r.doc_id for r in got)
    assert n[0] == 1 and n[1] == 2 and n[3] == 2
    for r in got:
        assert PIECES.decode(r.sg_ids) == (odd[r.doc_id] or "").replace("▁", " ")
    assert sg.segment(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_partitions_and_neighbours_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"some words number {i} here") for i in range(40)], "doc_id long, text string")
    key = lambda d: sorted((r.doc_id, r.sg_rank, tuple(r.sg_ids)) for r in sg.segment(d, PATH, ["doc_id"]).collect())
    assert key(df.coalesce(1)) == key(df.repartition(7))


def test_decoding_a_table_gives_the_texts_back(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "one two\nthree é😀"), (2, ""), (3, None), (4, "a\u2581b"), (5, " lead and  gaps ")]
    got = sg.segment(spark.createDataFrame(rows, "doc_id long, text string"), path, ["doc_id"])
    back = {(r.doc_id, r.sg_text) for r in sg.decode(got, path, ["doc_id"]).collect()}
    assert back == {(1, "one two\nthree é😀"), (2, ""), (3, ""), (4, "a b"), (5, " lead and  gaps ")}
    assert {r.doc_id: r.sg_round_trip for r in got.collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
