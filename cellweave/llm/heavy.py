"""The most frequent items among billions, in bounded memory.

Majority-vote sketch: each of ``rows`` x ``cols`` hash cells stores the total weight it was given,
a candidate and the candidate's surplus of votes. Sketches of partitions merge cell by cell: votes
for the same candidate add up, votes for different ones cancel each other. A key with more than
half of a cell's weight is always that cell's candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, COLS = 4, 4096
#: Increments that make the hash functions of the rows differ. Fixed values of the mixer.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def cell_of(keys: np.ndarray, row: int, cols: int) -> np.ndarray:
    """The column of each key in a row of the sketch."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((GOLDEN * (row + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(cols)).astype(np.int64)


class VoteSketch:
    """Arrays of total, candidate and surplus; their size depends on rows and cols only."""

    def __init__(self, rows: int = ROWS, cols: int = COLS):
        self.rows, self.cols, self.unkeyed = rows, cols, 0
        self.total = np.zeros((rows, cols), np.int64)
        self.candidate = np.zeros((rows, cols), np.int64)
        self.surplus = np.zeros((rows, cols), np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Take in keys with positive weights."""
        if not len(keys):
            return
        keys, inverse = np.unique(keys, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        weights = np.add.reduceat(weights[order], np.searchsorted(inverse[order], np.arange(len(keys))))
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                cell = cell_of(keys, r, self.cols)
                order = np.lexsort((-weights, cell))
                c, w, k = cell[order], weights[order], keys[order]
                first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                at, total = c[first], np.add.reduceat(w, first)
                self.merge(r, at, total, k[first], np.maximum(0, 2 * w[first] - total))

    def merge(self, r: int, at: np.ndarray, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        """Merge cells ``at`` of row ``r`` with others, by vote cancellation."""
        old_c, old_s = self.candidate[r, at], self.surplus[r, at]
        same, keeps = old_c == candidate, old_s >= surplus
        self.total[r, at] += total
        self.candidate[r, at] = np.where(same | keeps, old_c, candidate)
        self.surplus[r, at] = np.where(same, old_s + surplus, np.abs(old_s - surplus))


def vote_cells(df: DataFrame, key: Column, weight: Column, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(row, col, total, candidate, surplus): the cells of a sketch of each partition.

    Null and non-positive weights count nothing; the weight of null keys is held by the cell (-1, 0).
    The cells of any partitions, days or samples can be kept and merged later.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = VoteSketch(rows, cols)
        for b in batches:
            k, w = b.column(0), pa.compute.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False)
            known = k.is_valid().to_numpy(zero_copy_only=False)
            keys = pa.compute.fill_null(k, 0).to_numpy(zero_copy_only=False)
            s.unkeyed += int(w[~known & (w > 0)].sum())
            use = known & (w > 0)
            s.add(keys[use], w[use])
        r, c = np.nonzero(s.total)
        cols_ = [np.r_[r, -1], np.r_[c, 0], np.r_[s.total[r, c], s.unkeyed], np.r_[s.candidate[r, c], 0], np.r_[s.surplus[r, c], 0]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols_], names=["row", "col", "total", "candidate", "surplus"])

    return df.select(key.cast("bigint").alias("k"), weight.cast("bigint").alias("w")).mapInArrow(sketch, "row bigint, col bigint, total bigint, candidate bigint, surplus bigint")


def merge_cells(cells: DataFrame) -> DataFrame:
    """One cell (row, col, total, candidate, surplus, low) for each of many; ``low`` is a lower bound of the candidate's weight.

    Votes of equal candidates are added up first; what the strongest has beyond all others
    together is the surplus that is left after cancellation.
    """
    votes = cells.groupBy("row", "col", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"))
    best = F.max(F.struct("votes", "candidate")).alias("b")
    merged = votes.groupBy("row", "col").agg(F.sum("total").alias("total"), F.sum("votes").alias("all"), best)
    return merged.select("row", "col", "total", F.col("b.candidate").alias("candidate"), F.greatest(F.lit(0), 2 * F.col("b.votes") - F.col("all")).alias("surplus"), F.col("b.votes").alias("low"))


def heavy_candidates(cells: DataFrame, share: float, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(key, lower, upper, total): every key whose upper bound reaches ``share`` of the total weight.

    ``cells`` are those of one merged sketch, at most rows * cols of them, so one task holds them all.
    """

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, low, empty = VoteSketch(rows, cols), np.zeros((rows, cols), np.int64), True
        for b in batches:
            r, c, total, cand, surplus, lo = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            s.unkeyed += int(total[r < 0].sum())
            k = r >= 0
            s.total[r[k], c[k]], s.candidate[r[k], c[k]], s.surplus[r[k], c[k]], low[r[k], c[k]] = total[k], cand[k], surplus[k], lo[k]
            empty &= not k.any()
        if empty:
            return
        total = int(s.total[0].sum()) + s.unkeyed
        keys = np.unique(s.candidate[s.total > 0])
        upper, lower = np.full(len(keys), total, np.int64), np.zeros(len(keys), np.int64)
        with np.errstate(over="ignore"):
            for r in range(rows):
                at = cell_of(keys, r, cols)
                own = s.candidate[r, at] == keys
                upper = np.minimum(upper, (s.total[r, at] + np.where(own, 1, -1) * s.surplus[r, at]) // 2)
                lower = np.maximum(lower, np.where(own, low[r, at], 0))
        hit = upper >= share * total
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(lower[hit]), pa.array(upper[hit]), pa.array(np.full(int(hit.sum()), total))], names=["key", "lower", "upper", "total"])

    # a shuffle of its own: the merge before it keeps its tasks, and one task gets merged cells only
    return cells.repartition(1).mapInArrow(bounds, "key bigint, lower bigint, upper bigint, total bigint")


def heavy_hitters(df: DataFrame, key: str, weight: str, share: float, exact: bool = True, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(key, lower, upper, total[, weight]): keys that may hold ``share`` of the weight, with bounds.

    With ``exact`` a second pass weighs the candidates, at most rows * cols of them, and only those
    that do hold the share remain. Keys are bigints. Null keys are never heavy but their weight
    counts in the total; null, zero and negative weights count nothing. No rows give no rows.
    """
    k, w = F.col(f"`{key}`"), F.col(f"`{weight}`")
    found = heavy_candidates(merge_cells(vote_cells(df, k, w, rows, cols)), share, rows, cols)
    if not exact:
        return found
    # at most rows * cols candidates of 32 bytes
    own = df.select(k.cast("bigint").alias("key"), w.cast("bigint").alias("w")).where("w > 0").join(F.broadcast(found), "key")
    weighed = own.groupBy("key", "lower", "upper", "total").agg(F.sum("w").alias("weight"))
    return weighed.where(F.col("weight") >= F.lit(share) * F.col("total"))
