from __future__ import annotations

import numpy as np

from tallyframe.llm import vector_links as vl


def brute(rows, t=0.9):
    ok = [(i, np.array(v, float)) for i, (k, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16]
    links = {i: set() for i in range(len(rows))}
    for i, a in ok:
        for j, b in ok:
            if i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
                links[i].add(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (len(links[i]), min(rows[j][0] for j in seen))
    return out


def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    found = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0.01, 0.1, 0.2, 0.3, 0.4)]
    found += rng.normal(size=(200, 16)).tolist()
    found += [found[0], found[0], (np.array(found[0]) * 3).tolist(), None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, []]
    return [(i * 3, v) for i, v in enumerate(found)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vl, "BLOCK", 16)
    data = rows()
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "vec_id long, embedding array<double>, key int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vl.link_vectors(df).collect()}
    assert got == brute(data)


def test_runs_inside_a_block_skip_only_what_is_apart(monkeypatch):
    monkeypatch.setattr(vl, "RUN", 3)
    u = vl._units([np.array(v).tobytes() for _, v in rows()[:100]], 16)
    w = np.ones(len(u), int)
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(16, 4)))[0]
    whole = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert (vl.join_blocks(u, w, u, w, axes, 0.9, True)[0] == whole).all()
    n, _ = vl.join_blocks(u[:60], w[:60], u[60:], w[60:], axes, 0.9, False)
    assert (n[:60] == (u[:60] @ u[60:].T >= 0.9).sum(axis=1)).all() and (n[60:] == (u[60:] @ u[:60].T >= 0.9).sum(axis=1)).all()


def test_block_pairs_lose_none(spark):
    rng = np.random.default_rng(4)
    boxes = []
    for b in range(150):
        lo = rng.uniform(-5, 5, 3)
        boxes.append(((b // 40 << 20) + b % 40, lo.tolist(), (lo + rng.uniform(0, 0.5, 3)).tolist()))
    df = spark.createDataFrame(boxes, "block long, lo array<double>, hi array<double>")
    got = {tuple(r) for r in vl.block_pairs(df, 1.0, widest=8).collect()}
    lo, hi = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])
    near = vl.apart(lo, hi, lo, hi) <= 1.0
    assert got == {(boxes[i][0], boxes[j][0]) for i, j in np.argwhere(near) if boxes[i][0] <= boxes[j][0]}


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vl.link_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert vl.link_vectors(df.limit(0)).count() == 0


def test_every_length_links_and_no_finite_vector_is_left_out(spark):
    data = [(i, [1.0, i / 100, 0.0, 0.0]) for i in range(4)] + [(10, [1.0, 0.0]), (11, [2.0, 0.1]), (12, [0.0, 1.0]), (13, [3.0]), (14, [5.0]), (15, [-1.0])]
    data += [(20, [1e300, 0.0, 0.0]), (21, [1e-300, 0.0, 0.0]), (22, [0.0, 5e-324, 0.0]), (23, [0.0, 1.7e308, 1e300])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vl.link_vectors(df).collect()}
    want = {i: (3, 0) for i in range(4)} | {10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (1, 13), 14: (1, 13), 15: (0, 15)}
    assert got == want | {20: (1, 20), 21: (1, 20), 22: (1, 22), 23: (1, 22)}
