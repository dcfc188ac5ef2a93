"""Pairwise co-moments as mergeable blocks: one pass over the rows, for any number of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

#: Groups into which the blocks of tasks are merged first.
MERGES = 1024
#: Share of the raw second moment up to which a variance may be that of a constant.
SMALL = 1e-9

# what a block holds for each ordered pair (i, j), all under the mask of rows that hold both: complete rows, rows finite in both,
# mean and squared deviations of i, co-moment with j, whether i varies, and one value of i
_PARTS = ("n", "finite", "mean", "square", "co", "varied", "value")


class Block:
    """Counts, means and co-moments of each pair of ``p`` columns, each pair under its own mask."""

    def __init__(self, p: int, cells: np.ndarray | None = None):
        self.p = p
        self.cells = np.zeros((len(_PARTS), p, p)) if cells is None else cells.reshape(len(_PARTS), p, p)

    def __getattr__(self, name: str) -> np.ndarray:
        return self.cells[_PARTS.index(name)]

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        """The block of a batch of rows; NaN is a missing value."""
        made = cls(x.shape[1])
        there, finite = ~np.isnan(x), np.isfinite(x)
        made.n[:] = there.T.astype(float) @ there
        mask = finite.astype(float)
        made.finite[:] = n = mask.T @ mask
        if not finite.any():
            return made
        # around values of about the columns' size, so that squares cancel little
        some = np.where(finite, x, 0.0)
        centre = some.sum(0) / np.maximum(mask.sum(0), 1.0)
        y = np.where(finite, x - centre, 0.0)
        total, raw = y.T @ mask, (y * y).T @ mask
        share = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
        made.mean[:] = centre[:, None] + share
        made.square[:] = np.maximum(raw - total * share, 0.0)
        made.co[:] = y.T @ y - total * share.T
        made.varied[:] = made.square > SMALL * raw
        for i, j in zip(*np.nonzero((made.varied == 0) & (n > 0))):  # these may be constant: look at the values
            values = x[finite[:, i] & finite[:, j], i]
            made.value[i, j] = values[0]
            if (values == values[0]).all():
                made.mean[i, j], made.square[i, j], made.co[i, j], made.co[j, i] = values[0], 0.0, 0.0, 0.0
            else:
                made.varied[i, j] = 1.0
        return made

    def add(self, other: Block) -> None:
        """Merge another block into this one."""
        a, b = self.finite, other.finite
        n = a + b
        away = np.where((a > 0) & (b > 0), other.mean - self.mean, 0.0)
        part = np.divide(b, n, out=np.zeros_like(n), where=n > 0)
        both = a * part
        differ = (a > 0) & (b > 0) & (self.value != other.value)
        varied = np.maximum(np.maximum(self.varied, other.varied), differ)
        value, mean = np.where(a > 0, self.value, other.value), np.where(a > 0, self.mean + away * part, other.mean)
        square, co = self.square + other.square + away * away * both, self.co + other.co + away * away.T * both
        self.cells[:] = np.stack([self.n + other.n, n, mean, square, co, varied, value])

    def correlations(self) -> tuple[np.ndarray, np.ndarray]:
        """Complete pairs, and r: NaN where a side is constant or not finite among them."""
        known = (self.varied * self.varied.T > 0) & (self.finite == self.n)
        spread = np.sqrt(self.square) * np.sqrt(self.square.T)
        r = np.divide(self.co, spread, out=np.full_like(spread, np.nan), where=known & (spread > 0))
        return self.n, np.clip(r, -1.0, 1.0)


def _merged(blocks: pa.Table, p: int) -> Block:
    """All blocks of a table, in the order of their tasks."""
    total = Block(p)
    for row in blocks.sort_by("task").column("block"):
        total.add(Block(p, np.frombuffer(row.as_py()).copy()))
    return total


def pairwise(df: DataFrame, columns: list[str], min_pairs: int) -> DataFrame:
    """i, j, n_pairs and r of each pair of ``columns`` (by their places, i before j).

    Each task adds its rows to one block; blocks are merged in groups, and these once more. NULL and NaN
    are missing; a pair with an infinite value has no r.
    """
    p, spark = len(columns), df.sparkSession
    plain = df.select(*(nan_to_null(F.col(c).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)))
    fields = "task long, block binary"

    def packed(task: int, block: Block) -> dict:
        return {"task": pa.array([task], pa.int64()), "block": pa.array([block.cells.tobytes()], pa.binary())}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Block(p)
        for batch in batches:
            total.add(Block.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])))
        yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId(), total))

    def merged(blocks: pa.Table) -> pa.Table:
        return pa.table(packed(blocks["task"][0].as_py(), _merged(blocks, p)))

    def told(blocks: pa.Table) -> pa.Table:
        n, r = _merged(blocks, p).correlations()
        i, j = np.triu_indices(p, 1)
        values = [None if np.isnan(x) or m < min_pairs else float(x) for x, m in zip(r[i, j], n[i, j])]
        return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n_pairs": pa.array(n[i, j].astype(np.int64)), "r": pa.array(values, pa.float64())})

    none = spark.createDataFrame([(-1, bytearray(Block(p).cells.tobytes()))], fields)  # tables without rows have pairs too
    blocks = plain.mapInArrow(gathered, fields).unionByName(none)
    grouped = blocks.groupBy(F.pmod("task", F.lit(MERGES))).applyInArrow(merged, fields)
    return grouped.groupBy().applyInArrow(told, "i int, j int, n_pairs long, r double")
