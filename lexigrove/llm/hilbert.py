"""Sharding along a Hilbert curve over several metadata columns.

Each column is cut into cells that hold about as many rows as one another, from counts of all its values; a row's cells make a
point, whose index on the curve is looked up in the JVM, a bit of every dimension at a time, from a table of the curve's
orientations. Shards are runs of the curve of about equal weight. Sums along values and along the curve are taken range by
range, so no list of values, cells or rows is gathered in a task or the driver; at most 2**CELL_BITS cells are broadcast.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexigrove.llm.common import Shared, fresh

#: Bits per dimension, at most, and of a cell's number, all dimensions together.
BITS, CELL_BITS = 6, 18
#: Dimensions up to which the table of orientations is a literal of the plan.
TABLE_DIMENSIONS = 5
#: Bytes of text in a shard, at most about; half of it at least where cells aren't larger.
SHARD_BYTES = 64 << 20
#: Tasks that write shards; beyond that a task writes a run of them.
MAX_TASKS = 50_000


@functools.cache
def orientations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, next orientation) at orientation << n | digit: a digit has one bit of each of n coordinates, the first highest, its place is that on the curve.

    An orientation is the corner that the curve enters by and the axis that it leaves along (Hamilton's description of the
    curve by Gray codes); 0 is the whole curve's, the others are numbered as they come up.
    """
    full = (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    ones = lambda x: (~x & (x + 1)).bit_length() - 1
    place_of = {i ^ (i >> 1): i for i in range(1 << n)}
    known, todo, places, nexts = {(0, 0): 0}, [(0, 0)], [], []
    while todo:
        corner, axis = todo.pop(0)
        for digit in range(1 << n):
            w = place_of[turn(digit ^ corner, n - (axis + 1) % n)]
            enter = 0 if not w else (e := 2 * ((w - 1) // 2)) ^ (e >> 1)
            along = 0 if not w else ones(w) % n if w & 1 else ones(w - 1) % n
            then = corner ^ turn(enter, axis + 1), (axis + along + 1) % n
            if then not in known:
                known[then] = len(known)
                todo.append(then)
            places.append(w)
            nexts.append(known[then])
    return np.array(places), np.array(nexts)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of coordinates in 0 .. 2**bits - 1."""
    n = points.shape[1]
    places, nexts = orientations(n)
    out, at = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        digit = sum(((points[:, i] >> level) & 1) << (n - 1 - i) for i in range(n))
        out, at = (out << n) | places[(at << n) | digit], nexts[(at << n) | digit]
    return out


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """``hilbert_index`` of columns: looked up in the JVM, or in Arrow batches where the table would have over 2**13 entries."""
    n = len(coordinates)
    if bits * n > 62:
        raise ValueError("the curve's index has more than 62 bits")
    if n > TABLE_DIMENSIONS:

        @F.pandas_udf("bigint")
        def index(*columns: pd.Series) -> pd.Series:
            return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], 1), bits))

        return index(*coordinates)
    places, nexts = (F.lit([int(x) for x in t]).cast("array<int>") for t in orientations(n))
    out, at = F.lit(0).cast("bigint"), F.lit(0)
    for level in range(bits - 1, -1, -1):
        slot = at * F.lit(1 << n)
        for i, c in enumerate(coordinates):
            slot = slot + F.shiftleft(F.shiftright(c, level).bitwiseAND(F.lit(1)), n - 1 - i)
        out, at = out * F.lit(1 << n) + F.get(places, slot), F.get(nexts, slot)
    return out


def cumulated(rows: DataFrame, shared: Shared) -> tuple[DataFrame, int]:
    """The rows (value, w), values being distinct, with ``before``, the sum of w over lesser values, and the total.

    Values are ranged; of each range only its sum goes to the driver.
    """
    ranged, _ = shared.write(rows.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["w"] for r in ranged.groupBy("part").agg(F.sum("w").alias("w")).collect()}
    offsets, total = [], 0
    for part in sorted(sums):
        offsets.append((part, total))
        total += sums[part]
    begins = rows.sparkSession.createDataFrame(offsets, "part int, begins bigint")
    lesser = F.sum("w").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("lesser", F.coalesce(lesser, F.lit(0))).join(F.broadcast(begins), "part")
    return out.select("value", "w", (F.col("begins") + F.col("lesser")).alias("before")), total


def _up_to(column: Column):
    return lambda x: x <= column


def coordinates(df: DataFrame, dimensions: list[str], bits: int, shared: Shared) -> list[Column]:
    """A coordinate in 0 .. 2**bits - 1 of each dimension: the share of rows with a lesser value, in as many steps. Dimensions can be of any type that has an order; nulls have coordinate 0. Tables that ``shared`` has are deleted."""
    out, cells = [], 1 << bits
    for c in dimensions:
        column, kind = F.col(f"`{c}`"), df.schema[c].dataType
        counts, total = cumulated(df.select(column.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("w")), shared)
        steps = counts.select(F.expr(f"cast(before * {cells} div {max(total, 1)} as int)").alias("at"), "value").groupBy("at").agg(F.min("value").alias("least")).orderBy("at").collect()
        if not steps:
            out.append(F.lit(0))
            continue
        least = F.array(*(F.lit(r["least"]).cast(kind) for r in steps))
        reached = F.size(F.filter(least, _up_to(column)))
        out.append(F.coalesce(F.when(column.isNotNull(), F.get(F.lit([r["at"] for r in steps]).cast("array<int>"), reached - 1)), F.lit(0)))
    shared.only()
    return out


def bits_for(dimensions: list[str]) -> int:
    return max(1, min(BITS, CELL_BITS // len(dimensions)))


def cells(df: DataFrame, dimensions: list[str], bits: int | None = None) -> DataFrame:
    """df with the coordinate of each dimension as ``<dimension>_cell``; the names get underscores appended while a column has them."""
    own = coordinates(df, dimensions, bits or bits_for(dimensions), Shared(df.sparkSession))
    return df.withColumns({fresh(df, f"{c}_cell"): x for c, x in zip(dimensions, own)})


def shard(df: DataFrame, dimensions: list[str], weight: Column, bits: int | None = None, shard_bytes: int = SHARD_BYTES, key: str = "doc_id") -> DataFrame:
    """df with ``curve`` and ``shard``: the rows of a shard are a run of the curve, in one partition and in the curve's order.

    Runs are cut so that the weights (bytes) of a shard come to shard_bytes at most. A cell of the curve that weighs more than
    half of that is split by a hash of the key over as many shards as it reaches into, so any number of rows can have equal
    metadata; a single row is never split. A row weighs at least 1, also with a null weight. Null metadata is coordinate 0.
    Dimensions can be of any type that has an order, and as many as 62 // bits. Every row is kept, repeated ones too; an
    empty table stays empty. ``curve`` and ``shard`` get underscores appended while a column has that name.
    """
    bits, shared = bits or bits_for(dimensions), Shared(df.sparkSession)
    curve, number, heft = fresh(df, "curve"), fresh(df, "shard"), max(1, shard_bytes // 2)
    index = curve_index([F.col(f"__at{i}") for i in range(len(dimensions))], bits)
    at = df.select("*", *(x.alias(f"__at{i}") for i, x in enumerate(coordinates(df, dimensions, bits, shared))))
    placed = at.withColumn("__curve", index).drop(*(f"__at{i}" for i in range(len(dimensions))))
    heavy = F.greatest(F.coalesce(weight.cast("bigint"), F.lit(1)), F.lit(1))
    along, total = cumulated(placed.select(F.col("__curve").alias("value"), heavy.alias("w")).groupBy("value").agg(F.sum("w").alias("w")), shared)
    runs = along.select(F.col("value").alias("__curve"), F.expr(f"cast(before div {heft} as int)").alias("__first"), F.when(F.col("w") > heft, F.expr(f"cast((before + w - 1) div {heft} - before div {heft} + 1 as int)")).otherwise(1).alias("__parts"))
    rows = placed.join(F.broadcast(runs) if bits * len(dimensions) <= CELL_BITS else runs, "__curve")
    part = (F.col("__first") + F.pmod(F.xxhash64(F.col(f"`{key}`")), F.col("__parts"))).cast("int")
    out = rows.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__curve").alias(curve), part.alias(number))
    shards = total // heft + 1
    tasks = min(shards, MAX_TASKS)
    return out.repartitionById(tasks, F.expr(f"cast(`{number}` * {tasks}L div {shards} as int)")).sortWithinPartitions(number, curve)


@dataclass(frozen=True)
class ShardFiles:
    """Shards written below a folder: ``data``, whose files and row groups are shards, and ``shards``, a row per shard with its rows and the least and greatest value of each dimension."""

    spark: SparkSession
    path: str
    dimensions: tuple[str, ...]

    @staticmethod
    def write(df: DataFrame, path: str, dimensions: list[str], weight: Column, shard_bytes: int = SHARD_BYTES, **more) -> ShardFiles:
        out = shard(df, dimensions, weight, shard_bytes=shard_bytes, **more)
        curve, number = out.columns[-2:]
        out.withColumnsRenamed({curve: "__curve", number: "__shard"}).write.option("parquet.block.size", shard_bytes).parquet(f"{path}/data")
        files = ShardFiles(df.sparkSession, path, tuple(dimensions))
        bounds = [f(f"`{c}`").alias(f"{name}_{c}") for c in dimensions for f, name in ((F.min, "least"), (F.max, "most"))]
        files.spark.read.parquet(f"{path}/data").groupBy("__shard").agg(F.count("*").alias("rows"), *bounds, *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{c}") for c in dimensions)).write.parquet(f"{path}/shards")
        return files

    def shards(self, dimension: str, low=None, high=None) -> DataFrame:
        """The rows of ``shards`` that can hold a value from low to high, both included."""
        out = self.spark.read.parquet(f"{self.path}/shards")
        out = out if low is None else out.where(F.col(f"`most_{dimension}`") >= F.lit(low))
        return out if high is None else out.where(F.col(f"`least_{dimension}`") <= F.lit(high))

    def read(self, dimension: str, low=None, high=None) -> DataFrame:
        """The rows with a value from low to high. Both bounds reach the scan, which skips the row groups of other shards."""
        out, column = self.spark.read.parquet(f"{self.path}/data"), F.col(f"`{dimension}`")
        out = out if low is None else out.where(column >= F.lit(low))
        out = out if high is None else out.where(column <= F.lit(high))
        return out.drop("__curve", "__shard")
