"""Cells of mixed rows: the leaves of a median tree over a bounded sample, each with the ranges of all its rows.

A numeric range and the first and last name of a nominal attribute give, for every query and node, a distance below which none
of the node's rows lies.  The number of leaves grows with the rows, so a leaf stays small, and a query walks down only
nodes that can hold one of its nearest rows.  Any tree gives the same neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEAVES = 16_384  # leaves that a tree has about at most; every task holds it
SAMPLES = 16  # sampled rows a leaf, which place the cuts
WALK = 1_000_000  # (query, node) pairs looked at together


class BoxTree:
    """Cuts from a sample; ranges of the nodes from ``set_boxes``.  Numbers are on [0, 1] as a rule, names are strings."""

    def __init__(self, sample: pd.DataFrame, numeric: Sequence[str], nominal: Sequence[str], leaf_rows: int) -> None:
        self.numeric, self.nominal = list(numeric), list(nominal)
        self.names = {c: np.array(sorted(sample[c].dropna().unique()), dtype=object) for c in nominal}
        z = self.matrix(sample)
        z = np.where(np.isnan(z), np.inf, z)
        self.feature, self.at, self.left, self.right, self.parent = [], [], [], [], []
        wait = [(np.arange(len(z)), -1, 0)]
        while wait:
            rows, parent, side = wait.pop()
            node = len(self.feature)
            for column, value in ((self.feature, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.parent, parent)):
                column.append(value)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            f = self._widest(z[rows]) if len(rows) > leaf_rows else -1
            if f < 0:
                continue
            v = np.sort(z[rows, f])
            gap = f < len(self.numeric) and np.isinf(v[-1])
            cut = v[np.isfinite(v)][-1] if gap else v[(len(v) - 1) // 2]
            if cut == v[-1]:
                cut = v[v < cut][-1]
            self.feature[node], self.at[node] = f, cut
            low = z[rows, f] <= cut
            wait += [(rows[~low], node, 1), (rows[low], node, 0)]
        self.feature, self.at, self.left, self.right, self.parent = map(np.array, (self.feature, self.at, self.left, self.right, self.parent))
        shape = (len(self.feature), z.shape[1])
        self.low, self.high, self.miss, self.weight = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape, bool), np.zeros(shape[0])

    def _widest(self, z: np.ndarray) -> int:
        """The attribute whose rows lie farthest apart, or -1 if all rows are equal; missing is one off everything."""
        if not z.shape[1]:
            return -1
        low, high = z.min(axis=0), z.max(axis=0)
        with np.errstate(invalid="ignore"):
            spread = np.where(low == high, 0.0, high - low)
        spread[np.isinf(spread)] = 1.0
        spread[len(self.numeric) :] = spread[len(self.numeric) :] > 0
        return int(spread.argmax()) if spread.max() > 0 else -1

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Numbers, and the places of names in the order of the sample's names (between two places if not among them)."""
        out = [rows[c].to_numpy(float) for c in self.numeric]
        for c in self.nominal:
            codes, found = pd.factorize(rows[c])
            out.append(np.append(self._places(c, list(found)), np.nan)[codes])
        return np.column_stack(out) if out else np.zeros((len(rows), 0))

    def _places(self, c: str, values: Sequence[str]) -> np.ndarray:
        names, values = self.names[c], np.array([*values], dtype=object)
        at = np.searchsorted(names, values) if len(names) and len(values) else np.zeros(len(values), int)
        same = np.array([i < len(names) and names[i] == v for i, v in zip(at, values)], dtype=bool)
        return np.where(same, at, at - 0.5)

    def leaf(self, z: np.ndarray) -> np.ndarray:
        z = np.where(np.isnan(z), np.inf, z)
        node = np.zeros(len(z), dtype=np.int64)
        while True:
            go = np.flatnonzero(self.feature[node] >= 0)
            if not len(go):
                return node
            at = node[go]
            node[go] = np.where(z[go, self.feature[at]] <= self.at[at], self.left[at], self.right[at])

    def set_boxes(self, stats: pd.DataFrame) -> None:
        """``stats(_cell, w, low_i, high_i, miss_i)`` of all rows of the leaves."""
        cell = stats["_cell"].to_numpy()
        self.weight[cell] = stats["w"]
        for i, c in enumerate([*self.numeric, *self.nominal]):
            self.miss[cell, i] = stats[f"miss_{i}"]
            known = stats[f"low_{i}"].notna().to_numpy()
            for side, name in ((self.low, f"low_{i}"), (self.high, f"high_{i}")):
                v = stats[name][known]
                side[cell[known], i] = v.to_numpy(float) if i < len(self.numeric) else self._places(c, list(v))
        for node in range(len(self.parent) - 1, 0, -1):  # children come after their parents
            up = self.parent[node]
            self.low[up], self.high[up] = np.minimum(self.low[up], self.low[node]), np.maximum(self.high[up], self.high[node])
            self.miss[up] |= self.miss[node]
            self.weight[up] += self.weight[node]

    def least(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """A distance below which no row of ``node[i]`` is from query ``z[i]``."""
        total = np.zeros(len(z))
        for i in range(z.shape[1]):
            a, low, high = z[:, i], self.low[node, i], self.high[node, i]
            gone = np.isnan(a)
            if i < len(self.numeric):
                filled = low <= high
                with np.errstate(invalid="ignore"):
                    gap = np.where(gone, np.maximum(np.maximum(low, 1 - high), 0.5), np.maximum(np.maximum(low - a, a - high), 0.0))
                gap = np.where(filled, np.nan_to_num(gap, nan=0.0, posinf=np.inf), np.inf)
                other = np.where(gone, 1.0, np.maximum(a, 1 - a))
                gap = np.where(self.miss[node, i], np.minimum(gap, other), gap)
                total += gap * gap
            else:
                total += gone | (a < low) | (a > high)
        return np.where(self.weight[node] > 0, np.sqrt(total / max(1, z.shape[1])), np.inf)

    def home(self, z: np.ndarray, least_rows: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): the leaf a query falls into and, while there are fewer than ``least_rows`` rows, near leaves."""
        own = self.leaf(z)
        query, leaf = [np.arange(len(z))], [own]
        for i in np.flatnonzero(self.weight[own] < least_rows):
            node, held = own[i], self.weight[own[i]]
            while held < least_rows and self.parent[node] >= 0:
                up = self.parent[node]
                at = self.right[up] if self.left[up] == node else self.left[up]
                while self.feature[at] >= 0:
                    both = np.array([self.left[at], self.right[at]])
                    near = self.least(z[[i, i]], both)
                    at = both[np.lexsort((-self.weight[both], near))[0]]
                query.append([i])
                leaf.append([at])
                held, node = held + self.weight[at], up
        return np.concatenate(query).astype(np.int64), np.concatenate(leaf).astype(np.int64)

    def reached(self, z: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): all leaves that can hold a row within the query's bound."""
        query, node = np.arange(len(z)), np.zeros(len(z), dtype=np.int64)
        done_q, done_n = [query[:0]], [node[:0]]
        while len(query):
            if len(query) > WALK and len(z) > 1:
                half = len(z) // 2
                (a, b), (c, d) = self.reached(z[:half], bound[:half]), self.reached(z[half:], bound[half:])
                return np.concatenate([a, c + half]), np.concatenate([b, d])
            go = self.least(z[query], node) <= bound[query]
            query, node = query[go], node[go]
            end = self.feature[node] < 0
            done_q.append(query[end])
            done_n.append(node[end])
            query, node = query[~end], node[~end]
            query, node = np.concatenate([query, query]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate(done_q), np.concatenate(done_n)


def box_stats(placed: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """Rows, weight and ranges of every cell: one row a cell."""
    ranges = []
    for i, c in enumerate([*numeric, *nominal]):
        known = F.when(~F.isnan(c), F.col(c)) if c in numeric else F.col(c)
        ranges += [F.min(known).alias(f"low_{i}"), F.max(known).alias(f"high_{i}"), F.max(known.isNull()).alias(f"miss_{i}")]
    return placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *ranges)
