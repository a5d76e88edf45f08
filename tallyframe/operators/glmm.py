"""Crossed binomial mixed model: k of n right, with random item, model, config and their two-way effects on the logit.

Fitted by penalised quasi-likelihood: working responses and weights from the current fit, Henderson's mixed model
equations for the effects, and expectation-maximisation for the variances. One group's counts (not its samples) are
one task's work, a row for each cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EFFECTS = ("item", "model", "config", "item_model", "item_config", "model_config")


def fit(frame: pd.DataFrame, steps: int = 60) -> dict[str, float]:
    """Variance of each effect. ``frame`` has item, model, config, k and n. Effects below an item touch no other item, so
    each item's few equations are solved apart and only those of models and configs are shared: work is linear in items."""
    levels = {f: sorted(frame[f].unique()) for f in ("item", "model", "config")}
    at = {f: frame[f].map({v: i for i, v in enumerate(levels[f])}).to_numpy() for f in levels}
    items, models, configs = (len(levels[f]) for f in levels)
    k, n = np.zeros((items, models * configs)), np.zeros((items, models * configs))
    spot = at["model"] * configs + at["config"]
    np.add.at(k, (at["item"], spot), frame["k"].to_numpy(float))
    np.add.at(n, (at["item"], spot), frame["n"].to_numpy(float))
    one, m = np.ones((models * configs, 1)), np.repeat(np.eye(models), configs, axis=0)
    c = np.tile(np.eye(configs), (models, 1))
    own, shared = np.hstack([one, m, c]), np.hstack([one, m, c, np.eye(models * configs)])
    own_of, shared_of = ["item", *["item_model"] * models, *["item_config"] * configs], [None, *["model"] * models, *["config"] * configs, *["model_config"] * (models * configs)]
    variance = dict.fromkeys(EFFECTS, 0.3)
    below, above = np.zeros((items, own.shape[1])), np.zeros(shared.shape[1])
    above[0] = np.log((k.sum() + 0.5) / ((n - k).sum() + 0.5))
    for _ in range(steps):
        eta = np.clip(below @ own.T + shared @ above, -15, 15)
        p = 1 / (1 + np.exp(-eta))
        weight = np.where(n > 0, np.maximum(n * p * (1 - p), 1e-6), 0.0)
        target = weight * eta + k - n * p
        inner = np.linalg.inv(np.einsum("sa,is,sb->iab", own, weight, own) + np.diag([1 / variance[e] for e in own_of]))
        cross = np.einsum("sa,is,sg->iag", own, weight, shared)
        reach = inner @ cross
        prior = np.diag([1e-9 if e is None else 1 / variance[e] for e in shared_of])
        spread = np.linalg.inv(shared.T @ (weight.sum(axis=0)[:, None] * shared) + prior - np.einsum("iag,iah->gh", cross, reach))
        above = spread @ (shared.T @ target.sum(axis=0) - np.einsum("iag,ia->g", reach, target @ own))
        below = np.einsum("iab,ib->ia", inner, target @ own - cross @ above)
        noise = np.einsum("iaa->ia", inner) + np.einsum("iag,gh,iah->ia", reach, spread, reach)
        moment = {e: [] for e in EFFECTS}
        for j, e in enumerate(own_of):
            moment[e].append(float((below[:, j] ** 2 + noise[:, j]).mean()))
        for j, e in enumerate(shared_of[1:], 1):
            moment[e].append(float(above[j] ** 2 + spread[j, j]))
        variance = {e: max(1e-6, float(np.mean(x))) for e, x in moment.items()}
    return variance


def decompose(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, variance, share) of every group of cells with item, model, config, k and n."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = fit(frame)
        total = sum(found.values())
        first = {c: frame[c].iloc[0] for c in by}
        return pd.DataFrame([{**first, "component": e, "variance": v, "share": v / total} for e, v in found.items()])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in by)
    return cells.select(*by, "item", "model", "config", "k", "n").groupBy(*by).applyInPandas(run, f"{keys}, component string, variance double, share double")
