"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group. Groups enter, largest first, the bin with the least room that still holds
them, found in a balanced tree. Groups of one size are interchangeable, so the driver packs the table of sizes with their
counts, not the groups: a bin that takes a group of a size stays the tightest for that size and takes as many as fit at
once. The table has no more rows than there are different sizes (n different sizes have a sum of n * n / 2 at least, so
their number grows with the root of the corpus). The least of a growing row of capacities with which no more than the
wanted bins are opened is taken.

Nulls: a null text counts as an empty one. Rows without doc_id are placed like others. An empty table gives no rows.
Repeated rows keep one slot each; of rows equal in doc_id and text it is open which has which. Groups of equal size are
told apart by the hash of their text. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import body, broadcast_if_small, settle

SLICE = 20_000


class Rooms:
    """Open bins by (room, bin) in a treap: a search tree that mixed priorities keep balanced."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._cut(self.root, key)
        self.root = self._join(self._join(low, [key, (key[0] * 0x9E3779B1 ^ key[1] * 0x85EBCA77) & 0xFFFFFFFF, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least (room, bin) with room for the size."""
        low, high = self._cut(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _cut(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """The tree in two: keys below, and keys from `key` on."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._cut(node[3], key)
            return node, high
        low, node[2] = self._cut(node[2], key)
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """(size, bin, count) of the runs of equal groups in the order of packing, and the number of bins, for (size, count) of
    the groups. A group above the capacity gets a bin of its own."""
    rooms, runs, opened = Rooms(), [], 0
    for size, count in sorted(sizes, reverse=True):
        while count:
            found = rooms.take_tightest(size)
            if found is None:
                found, opened = (max(capacity, size), opened), opened + 1
            room, place = found
            fit = min(count, room // size)
            runs.append((size, place, fit))
            count -= fit
            rooms.add((room - fit * size, place))
    return runs, opened


def pack(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The runs with the first capacity, of the least possible one and those 1, 3, 7, ... above it, that needs no more bins."""
    total = sum(s * n for s, n in sizes)
    least, extra = max([1, -(-total // bins), *[s for s, _ in sizes]]), 0
    while True:
        runs, opened = best_fit_decreasing(sizes, least + extra)
        if opened <= bins:
            return runs
        extra = 2 * extra + 1


def ranked(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """Adds the place, from 0, of each row among those with equal keys. Each key is cut into slices by hash, and a slice
    starts where the last ended, so no task orders more than a slice."""
    slices = max(1, rows.count() // SLICE)
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*by), F.lit(slices)))
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in by])) - 1
    return cut.withColumn("_place", place).join(offsets, [*keys, "_slice"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_slice", "_before", "_place", "_n")


def packed(docs: DataFrame, bins: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shards have nearly equal sums of sizes."""
    spark, text = docs.sparkSession, body()
    key = ["_h1", "_h2", "text_crc32"]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h1"),
        F.hash(text, F.lit(7)).alias("_h2"),
    )
    groups = settle(rows.groupBy(*key).agg(F.sum("size").alias("_sum")))
    sizes = [(r["_sum"], r["n"]) for r in groups.groupBy("_sum").agg(F.count("*").alias("n")).collect()]
    plan, taken = [], {}
    for size, place, count in pack(sizes, bins):
        start = taken.get(size, 0)
        plan.append((size, start, start + count, place))
        taken[size] = start + count
    split = {s for s, start, _, _ in plan if start}
    whole = spark.createDataFrame([(s, p) for s, _, _, p in plan if s not in split], "_sum long, shard int")
    parts = spark.createDataFrame([x for x in plan if x[0] in split], "_sum long, _from long, _to long, shard int")
    one = groups.join(broadcast_if_small(whole), "_sum").select(*key, "shard")
    several = settle(groups.join(broadcast_if_small(parts.select("_sum").distinct()), "_sum"))
    several = ranked(several, ["_sum"], key, "_rank").join(broadcast_if_small(parts), "_sum").where("_rank >= _from and _rank < _to").select(*key, "shard")
    placed = settle(rows.join(broadcast_if_small(settle(one.unionByName(several)), 300_000), key).select("doc_id", "size", "text_crc32", "shard"))
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def shards(docs: DataFrame, bins: int = 24) -> DataFrame:
    """The contract's row: law is `bytes`, so no grown shard is given."""
    return packed(docs, bins).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
