"""Filling containers of fixed capacity with items of varying length.

Sum-of-squares packing: an item goes where, after it is placed, the sum over all residual gaps of
the squared number of open containers with that gap is smallest. Every partition packs its own
items, in one pass and without a shuffle, and the containers it leaves open are packed once more,
as items, together with those of a fixed number of other partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Partitions of the first pass whose open containers one task packs again, and bits of a number within a partition.
TOGETHER, BITS = 64, 36
_PLACED = pa.schema([("item", pa.int64()), ("row", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("container", pa.int64()), ("open_fill", pa.int64())])


class SquarePacker:
    """Online sum-of-squares packing of sizes 1..capacity into numbered containers."""

    def __init__(self, capacity: int, first: int = 0):
        self.capacity, self.next = capacity, first
        self.open = np.zeros(capacity + 1, np.int64)  # number of open containers by gap
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> int:
        """The container of the item; it is closed once it is full."""
        c, n = self.capacity, self.open
        best, at = (2 * int(n[c - size]) + 1 if size < c else 1), c  # a new container
        if size < c:
            here, there = n[size:c], n[: c - size]
            change = 2 * (there - here) + 2
            change[0] = 1 - 2 * here[0]  # a full container is no longer open
            change[here == 0] = 1 << 40
            k = int(change.argmin())
            if change[k] <= best:
                at = size + k
        if at == c:
            box, self.next = self.next, self.next + 1
        else:
            box = self.stacks[at].pop()
            n[at] -= 1
        if at > size:
            self.stacks[at - size].append(box)
            n[at - size] += 1
        return box

    def left(self) -> Iterator[tuple[int, int]]:
        """(container, fill) of those still open."""
        for gap in np.flatnonzero(self.open):
            for box in self.stacks[gap]:
                yield box, self.capacity - int(gap)


def pack_batches(batches: Iterator[pa.RecordBatch], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """Placements of (item, size) rows, then a row for each container left open."""
    packer, row = SquarePacker(capacity, first), first

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PLACED)], schema=_PLACED)

    for b in batches:
        rows: list[tuple] = []
        for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            size = size or 0
            if size <= 0:
                rows.append((item, row, 0, 0, 0, None, None))
            for piece, start in enumerate(range(0, size, capacity)):
                part = min(capacity, size - start)
                rows.append((item, row, piece, start, part, packer.place(part), None))
            row += 1
        if rows:
            yield out(rows)
    if rows := [(None, None, None, None, None, box, fill) for box, fill in packer.left()]:
        yield out(rows)


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, row, piece, start, size, container): where each item, or each piece of one above capacity, is placed.

    Only items larger than ``capacity`` are split, into full pieces and a rest. Items with a null,
    zero or negative size have one row with size 0 and no container. Repeated items are placed
    each; ``row`` tells them apart. Items are bigints; a null item is placed as any other.
    """
    schema = "item bigint, row bigint, piece bigint, start bigint, size bigint, container bigint, open_fill bigint"

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_batches(batches, capacity, TaskContext.get().partitionId() << BITS)

    rows = items.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{size}`").cast("bigint").alias("size"))
    placed = cut(rows.mapInArrow(once, schema))
    left = placed.where("open_fill is not null").select(F.col("container").alias("item"), F.col("open_fill").alias("size"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs groups that come one after the other; numbers are negative, and of the group."""
        group, held = None, []
        for b in batches:
            for g in np.unique(b.column(0).to_numpy()):
                own = b.filter(pa.compute.equal(b.column(0), int(g)))
                if g != group and held:
                    yield from pack_batches(held, capacity, -(1 + int(group) << BITS))
                    held = []
                group = g
                held.append(pa.RecordBatch.from_arrays([own.column(1), own.column(2)], names=["item", "size"]))
        if held:
            yield from pack_batches(held, capacity, -(1 + int(group) << BITS))

    # the open containers of a group are at most TOGETHER times those of a partition, whatever the number of items
    grouped = left.select(F.expr(f"item div {TOGETHER << BITS}").alias("group"), "item", "size")
    moved = cut(grouped.repartition("group").sortWithinPartitions("group", F.desc("size"), "item").mapInArrow(again, schema))
    moved = moved.where("item is not null").select(F.col("item").alias("container"), F.col("container").alias("shared"))
    # rows without a container stay out of the join: they would be one key
    out = placed.where("container is not null and open_fill is null").join(moved, "container", "left")
    none = placed.where("container is null").select("item", "row", "piece", "start", "size", "container")
    return out.select("item", "row", "piece", "start", "size", F.coalesce("shared", "container").alias("container")).unionByName(none)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, fewest, n_pieces, n_split, size, fullest, fill): how well containers are used; one row.

    ``fewest`` is the least number of containers that can hold the sizes, ``fullest`` the largest fill.
    """
    boxes = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum((F.col("piece") == 1).cast("int")).alias("split"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("size") / capacity).alias("fewest"), F.sum("n").alias("n_pieces"), F.sum("split").alias("n_split"),
        F.sum("size").alias("size"), F.max("size").alias("fullest"), (F.sum("size") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )


def split_items(packed: DataFrame) -> DataFrame:
    """(item) of the items that lie in more than one of the finished containers."""
    own = packed.where("container is not null").groupBy("row").agg(F.first("item").alias("item"), F.min("container").alias("a"), F.max("container").alias("b"))
    return own.where("a <> b").select("item").distinct()
