"""Isolation forest (Liu, Ting, Zhou 2008) over many small windows at once.

Every window gets its own forest, grown on its history alone and from the same seed, so the answer for
a window depends on nothing but the window. The trees of all windows of an Arrow batch grow together,
one depth at a time, as flat numpy arrays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# The usual defaults of the method, which grows a tree on a subsample of that size at most.
TREES = 100
MAX_SAMPLE = 256
SEED = 42
EULER_GAMMA = 0.5772156649015329

WINDOWS_PER_STEP = 64


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    deep = np.maximum(n, 3.0)
    harmonic = 2.0 * (np.log(deep - 1.0) + EULER_GAMMA) - 2.0 * (deep - 1.0) / deep
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, harmonic))


@lru_cache(maxsize=64)
def _draws(n: int, width: int):
    """The random part of a forest over n points: samples, feature preferences and cut positions."""
    sample = min(MAX_SAMPLE, n)
    limit = int(np.ceil(np.log2(max(sample, 2))))
    rng = np.random.RandomState(SEED)
    grows = np.zeros((TREES, n + 1), dtype=bool)
    for tree in grows:
        tree[rng.permutation(n)[:sample]] = True
    # Per depth, tree and node: features in the order to try them, as the first that varies splits the node.
    preferred = rng.random_sample((limit, TREES * 2**limit, width)).argsort(axis=2).astype(np.int32)
    position = rng.random_sample((limit, TREES * 2**limit))
    return sample, limit, grows, preferred, position


def forest_scores(history: np.ndarray, current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (lower is more anomalous) of each window's history (w, n) and current point (w,).

    history: (w, n, features); current: (w, features).
    """
    windows, n, width = history.shape
    sample, limit, grows, preferred, position = _draws(n, width)

    # One row per (window, tree, point): the current point rides along last and never shapes a tree.
    values = np.concatenate([history, current[:, None, :]], axis=1).reshape(-1)
    point = np.tile(np.arange(windows * (n + 1), dtype=np.int32).reshape(windows, 1, n + 1) * width, (1, TREES, 1)).ravel()
    tree = np.repeat(np.arange(windows * TREES, dtype=np.int32), n + 1)
    trains = np.tile(grows, (windows, 1)).ravel()
    node = np.zeros(point.size, dtype=np.int32)
    depth = np.zeros(point.size)
    row = np.arange(point.size, dtype=np.int32)

    for level in range(limit + 1):
        # The rows of a node lie in one run.
        key = tree[row] * 2**limit + node[row]
        order = np.argsort(key, kind="stable")
        row, key = row[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        runs = np.diff(np.r_[first, key.size])
        size = np.add.reduceat(trains[row], first, dtype=np.int32)
        cut, feature, varied = np.zeros(first.size), np.zeros(first.size, dtype=np.int32), np.zeros(first.size, dtype=bool)

        if level < limit:
            slot = key[first] % (TREES * 2**limit)
            undecided = np.flatnonzero(size > 1)
            for choice in range(width):
                if undecided.size == 0:
                    break
                tried = preferred[level, slot[undecided], choice]
                low, high = _extremes(values, point, trains, row, first, runs, undecided, tried)
                cuts = low + position[level, slot[undecided]] * (high - low)
                varies = high > low
                cut[undecided] = np.where(cuts < high, cuts, low)
                feature[undecided] = tried
                varied[undecided] = varies
                undecided = undecided[~varies]

        splits = np.repeat(varied, runs)
        leaf = row[~splits]
        depth[leaf] = level + np.repeat(average_path(size), runs)[~splits]
        row = row[splits]
        if row.size == 0:
            break
        to_right = values[point[row] + np.repeat(feature, runs)[splits]] > np.repeat(cut, runs)[splits]
        node[row] = node[row] * 2 + to_right

    mean_depth = depth.reshape(windows, TREES, n + 1).mean(axis=1)
    score = -np.exp2(-mean_depth / average_path(sample))
    return score[:, :n], score[:, n]


def _extremes(values, point, trains, row, first, runs, nodes, feature):
    """Lowest and highest training value of one feature per chosen node."""
    if nodes.size < first.size:
        chosen = np.zeros(first.size, dtype=bool)
        chosen[nodes] = True
        row, runs = row[np.repeat(chosen, runs)], runs[nodes]
        first = np.r_[0, np.cumsum(runs)[:-1]]
    x = values[point[row] + np.repeat(feature, runs)]
    learn = trains[row]
    return (
        np.minimum.reduceat(np.where(learn, x, np.inf), first),
        np.maximum.reduceat(np.where(learn, x, -np.inf), first),
    )


def flagged_scores(history: np.ndarray, current: np.ndarray, contamination: float) -> np.ndarray:
    """The current point's score where it is below the training cut-off, else NaN."""
    out = np.empty(len(history))
    for at in range(0, len(history), WINDOWS_PER_STEP):
        part = slice(at, at + WINDOWS_PER_STEP)
        trained, score = forest_scores(history[part], current[part])
        offset = np.percentile(trained, 100.0 * contamination, axis=1)
        out[part] = np.where(score < offset, score, np.nan)
    return out


def forest_column(contamination: float, min_history: int):
    """Arrow UDF (flattened history array<double>, current array<double>) -> score, null if not flagged."""

    def score(history: pd.Series, current: pd.Series) -> pd.Series:
        out = np.full(len(current), np.nan)
        width = len(current.iloc[0]) if len(current) else 0
        lengths = history.map(len).to_numpy()
        for length in np.unique(lengths[lengths >= min_history * width]):
            rows = np.flatnonzero(lengths == length)
            past = np.stack(history.iloc[rows].to_list()).reshape(rows.size, -1, width)
            now = np.stack(current.iloc[rows].to_list())
            out[rows] = flagged_scores(past, now, contamination)
        # As objects, so that "not flagged" arrives in Spark as null and not as NaN.
        return pd.Series([None if np.isnan(s) else s for s in out], dtype=object)

    return F.pandas_udf(score, "double")
