"""Gradient boosting by histograms, on cells.

Columns are cut at exact quantiles into few bins, and rows that share all bins share all gradients, so counts of rows and
of positives by cell are all that boosting needs. There are at most ``CELLS`` cells whatever the rows: the bins of a column
are as many as the number of columns allows. Binning and counting are one pass over the data; trees grow on the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import prefix_sums, quantiles_by

CELLS, MOST_BINS = 1 << 16, 64


def bins_for(columns: int) -> int:
    """Bins of a column, one of them for nulls and NaN, so that all columns' make at most CELLS cells."""
    return max(2, min(MOST_BINS, int(CELLS ** (1 / columns) + 1e-9)))


def cuts(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Where each column is cut: its distinct quantiles at equal shares."""
    parts = bins_for(len(columns)) - 1
    out = {}
    for c in columns:
        row = quantiles_by(df, [], c, {f"q{k}": k / parts for k in range(1, parts)}).first() if parts > 1 else None
        out[c] = sorted({float(x) for x in row if x is not None}) if row else []
    return out


def bin_of(column: str, edges: list[float]) -> Column:
    """0 for null and NaN, else 1 and how many edges are below the value."""
    x = F.col(column).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)) if edges else F.lit(0)
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + below).cast("int")


def counted(df: DataFrame, edges: dict[str, list[float]], gold: str) -> DataFrame:
    """n and pos (rows and positives) of each cell, a column for each one's bin; rows without gold do not count."""
    bins = [bin_of(c, e).alias(f"b{k}") for k, (c, e) in enumerate(edges.items())]
    rows = df.where(F.col(gold).isNotNull()).select(*bins, F.col(gold).cast("double").alias("_y"))
    return rows.groupBy(*[f"b{k}" for k in range(len(edges))]).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))


def first_gains(cells: DataFrame, columns: list[str]) -> DataFrame:
    """What each cut of each column gains as the first split: feature, bin (the last on the left), n_left and gain.

    Before it all rows have the share of positives as their probability, so gradients sum to 0 and the gain is
    GL^2 / HL + GR^2 / HR.
    """
    long = cells.select("n", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b{k}").alias("bin")) for k, c in enumerate(columns)])).alias("x"))
    by = long.groupBy("x.feature", "x.bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = cells.agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    upto = prefix_sums(by, ["feature"], ["bin"], {"n_left": F.col("n"), "pos_left": F.col("pos")}).crossJoin(F.broadcast(total))
    p = F.col("_pos") / F.col("_n")
    left = p * F.col("n_left") - F.col("pos_left")
    weight = p * (1 - p)
    gain = left * left / (weight * F.col("n_left")) + left * left / (weight * (F.col("_n") - F.col("n_left")))
    return upto.where("n_left < _n").select("feature", "bin", "n_left", gain.alias("gain"))


@dataclass
class Boosted:
    edges: dict[str, list[float]]
    start: float
    trees: list[list[tuple]]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Log-odds of cells given by their bins, a row each."""
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            at = np.zeros(len(bins), np.int64)
            for _ in range(64):
                inner = np.array([t[0] is not None for t in tree])[at]
                if not inner.any():
                    break
                feature, cut, left, right = (np.array([t[k] if t[k] is not None else 0 for t in tree])[at] for k in range(4))
                goes = bins[np.arange(len(bins)), feature] <= cut
                at = np.where(inner, np.where(goes, left, right), at)
            out += np.array([t[4] for t in tree])[at]
        return out

    def transform(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """df with probabilities: a table of all cells, of which there are CELLS at most, is broadcast."""
        sizes = [len(e) + 2 for e in self.edges.values()]
        grid = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(s) for s in sizes], indexing="ij")], axis=1)
        prob = 1 / (1 + np.exp(-self.scores(grid)))
        keys = [f"_b{k}" for k in range(len(sizes))]
        rows = [(*map(int, b), float(p)) for b, p in zip(grid, prob)]
        table = df.sparkSession.createDataFrame(rows, ", ".join(f"{k} int" for k in keys) + f", {name} double")
        binned = df.withColumns({k: bin_of(c, e) for k, (c, e) in zip(keys, self.edges.items())})
        return binned.join(F.broadcast(table), keys).drop(*keys)


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, rate: float, least: int, l2: float) -> list[tuple]:
    """A tree of (feature, last bin on the left, left, right, value): each node takes the split with the largest gain, the
    first by feature and bin among equals, while both sides have ``least`` rows."""
    tree: list[list] = []

    def node(own: np.ndarray, level: int) -> int:
        at = len(tree)
        total_g, total_h = g[own].sum(), h[own].sum()
        tree.append([None, None, None, None, -rate * total_g / (total_h + l2)])
        best = (1e-9, None)
        for f in range(bins.shape[1]) if level < depth else ():
            sums = [np.bincount(bins[own, f], x[own]).cumsum() for x in (g, h, n)]
            gl, hl, nl = (s[:-1] for s in sums)
            gr, hr, nr = total_g - gl, total_h - hl, n[own].sum() - nl
            ok = (nl >= least) & (nr >= least)
            gain = np.where(ok, gl**2 / (np.maximum(hl, 1e-12) + l2) + gr**2 / (np.maximum(hr, 1e-12) + l2), 0) - np.where(ok, total_g**2 / (total_h + l2), 0)
            k = int(gain.round(9).argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0] + 1e-9:
                best = (gain[k], (f, k))
        if best[1]:
            f, k = best[1]
            side = bins[own, f] <= k
            tree[at][:4] = [f, k, node(own[side], level + 1), node(own[~side], level + 1)]
        return at

    node(np.arange(len(bins)), 0)
    return [tuple(t) for t in tree]


def fit(df: DataFrame, columns: list[str], gold: str, rounds: int = 200, depth: int = 3, rate: float = 0.1, least: int = 20, l2: float = 0.0) -> Boosted:
    """Boosted trees for log loss. Without rows, or with gold of one kind only, the model is a constant."""
    edges = cuts(df, columns)
    cells = counted(df, edges, gold).orderBy(*[f"b{k}" for k in range(len(columns))]).toPandas()  # CELLS rows at most
    d = len(columns)
    bins, n, pos = cells.iloc[:, :d].to_numpy(np.int64), cells["n"].to_numpy(float), cells["pos"].to_numpy(float)
    share = pos.sum() / n.sum() if len(n) else 0.5
    if not len(n) or not 0 < share < 1:
        return Boosted(edges, float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -27, 27)), [])
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(n), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(bins, n * p - pos, n * p * (1 - p), n, depth, rate, least, l2)
        trees.append(tree)
        score += Boosted(edges, 0.0, [tree]).scores(bins)
    return Boosted(edges, start, trees)
