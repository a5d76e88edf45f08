from __future__ import annotations

import numpy as np
import pandas as pd

from tallyframe.operators import glmm


def test_shares_of_a_synthetic_design_are_recovered():
    rng = np.random.default_rng(5)
    n_items, truth = 80, {"item": 1.2**2, "model": 0.3**2, "config": 0.3**2, "item_model": 0.6**2, "item_config": 0.8**2, "model_config": 0.1**2}
    draw = lambda e, *shape: rng.normal(0, truth[e] ** 0.5, shape)
    eta = draw("item", n_items)[:, None, None] + draw("model", 3)[None, :, None] + draw("config", 4)[None, None] + draw("item_model", n_items, 3)[:, :, None] + draw("item_config", n_items, 4)[:, None] + draw("model_config", 3, 4)[None]
    k = rng.binomial(24, 1 / (1 + np.exp(-eta)))
    rows = [(i, m, c, k[i, m, c], 24) for i in range(n_items) for m in range(3) for c in range(4)]
    got = glmm.fit(pd.DataFrame(rows, columns=["item", "model", "config", "k", "n"]), steps=40)
    total, whole = sum(got.values()), sum(truth.values())
    for e in ("item", "item_model", "item_config"):
        assert abs(got[e] / total - truth[e] / whole) < 0.12


def test_groups_and_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f"i{i}", f"m{m}", f"c{c}", int(rng.integers(0, 13)), 12) for g in (0, 1) for i in range(6) for m in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "seed int, item string, model string, config string, k int, n int")
    got = glmm.decompose(df, ["seed"]).toPandas()
    assert len(got) == 12 and np.allclose(got.groupby("seed")["share"].sum(), 1)
