"""Sequential rules over whole archives: groups of a counted size by the loop itself, on Arrow batches, larger ones as rounds
of joins. What is read again is written to the shared folder, which cuts the lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Conflicts or candidates that one task takes as a whole.
LIMIT = 1_000_000
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares. Only a session of one machine may do without the setting. What is
    written there goes when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/skerry-scratch"
    path = f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows read back from a written table; the shuffle files behind it go at once."""
    spark = df.sparkSession
    path, schema = folder(spark), df.schema
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def by_group(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """What `solve` gives for the rows of all groups `grp` of at most `limit` rows, several groups dealt to one task, and the
    rows of the larger ones, if there are any. rows: a written table."""
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    large = None
    if most > limit:
        heavy = sizes.where(F.col("n") > limit).select("grp")
        # no more heavy groups than rows / limit
        large, rows = rows.join(F.broadcast(heavy), "grp", "left_semi"), rows.join(F.broadcast(heavy), "grp", "left_anti")
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("grp"), F.lit(max(1, 4 * total // limit))))
    return dealt.groupBy("_deal").applyInArrow(solve, schema), large


def _order(t: pa.Table, *names: str) -> np.ndarray:
    """Places of the rows by these columns, nulls first and NaN last, as Spark orders."""
    keys = []
    for name in reversed(names):
        column = t.column(name)
        keys += [pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()]
    return np.lexsort(keys)


def greedy_keep(nodes: DataFrame, conflicts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The ids that a loop in order of strength keeps when each kept one drops the weaker ones in conflict with it.

    nodes: (id). conflicts: (grp, rank, strong, weak), rank being the strong end's (c, i), lower first; conflicts stay inside
    a group. Groups of at most `limit` conflicts are solved by the loop itself: a conflict, in order of its strong end,
    decides its weak end. Larger groups are cut into connected components, and what is still larger goes by rounds."""

    def loop(t: pa.Table) -> pa.Table:
        order = _order(t, "c", "i")
        gone: set[int] = set()
        for strong, weak in zip(t.column("strong").to_numpy()[order].tolist(), t.column("weak").to_numpy()[order].tolist(), strict=True):
            if strong not in gone:
                gone.add(weak)
        return pa.table({"id": pa.array(list(gone), pa.int64())})

    edges = cut(conflicts.select("grp", F.col("rank.c").cast("double").alias("c"), F.col("rank.i").alias("i"), "strong", "weak"))
    dropped, large = by_group(edges, loop, "id long", limit)
    if large is not None:
        comp = components(large.select(F.col("strong").alias("a"), F.col("weak").alias("b"))).select(F.col("id").alias("strong"), F.col("comp").alias("grp"))
        parts, large = by_group(cut(large.drop("grp").join(comp, "strong")), loop, "id long", limit)
        dropped = dropped.union(parts)
        if large is not None:
            dropped = dropped.union(_dropped_by_rounds(large.select("strong", "weak")))
    return nodes.select("id").join(dropped, "id", "left_anti")


def _dropped_by_rounds(conflicts: DataFrame) -> DataFrame:
    """An id is kept once no undecided stronger one is in conflict with it, dropped once a kept one is: the greedy
    independent set in as many rounds as the longest chain asks for, equal to the loop."""
    edges, dropped = cut(conflicts.distinct()), None
    while not edges.isEmpty():
        blocked = edges.select(F.col("weak").alias("strong")).distinct()
        kept = edges.select("strong").distinct().join(blocked, "strong", "left_anti")
        out = cut(edges.join(kept, "strong", "left_semi").select(F.col("weak").alias("id")).distinct())
        dropped = out if dropped is None else dropped.union(out)
        gone = out.select(F.col("id").alias("weak"))
        left = edges.join(gone, "weak", "left_anti").join(gone.select(F.col("weak").alias("strong")), "strong", "left_anti")
        edges = cut(left.join(kept, "strong", "left_anti"))
    return dropped


def greedy_match(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(p, g) of the loop that takes p by rank and gives each its best free g.

    candidates: (grp, p, rank, g, score): rank (c, i) unique for each p, lower first; higher scores first, then lower g. A p
    and a g belong to one group. Groups of at most `limit` candidates are solved by the loop, larger ones by rounds."""

    def loop(t: pa.Table) -> pa.Table:
        t = t.append_column("worse", pc.negate(t.column("score")))
        order = _order(t, "c", "i", "worse", "g")
        found: dict[int, int] = {}
        taken: set[int] = set()
        for p, g in zip(t.column("p").to_numpy()[order].tolist(), t.column("g").to_numpy()[order].tolist(), strict=True):
            if p not in found and g not in taken:
                found[p] = g
                taken.add(g)
        return pa.table({"p": pa.array(list(found), pa.int64()), "g": pa.array(list(found.values()), pa.int64())})

    edges = cut(candidates.select("grp", "p", F.col("rank.c").cast("double").alias("c"), F.col("rank.i").alias("i"), "g", "score"))
    out, large = by_group(edges, loop, "p long, g long", limit)
    return out if large is None else out.union(_matched_by_rounds(large.withColumn("rank", F.struct("c", "i"))))


def _matched_by_rounds(candidates: DataFrame) -> DataFrame:
    """In a round, every p whose best free g no earlier undecided p could take is matched."""
    edges, out = cut(candidates.select("p", "rank", "g", "score")), None
    while not edges.isEmpty():
        first = edges.groupBy("g").agg(F.min("rank").alias("first"))
        best = edges.groupBy("p", "rank").agg(F.max(F.struct(F.col("score"), (-F.col("g")).alias("ng"))).alias("b")).select("p", "rank", (-F.col("b.ng")).alias("g"))
        done = cut(best.join(first, "g").where("rank = first").select("p", "g"))
        out = done if out is None else out.union(done)
        edges = cut(edges.join(done.select("p"), "p", "left_anti").join(done.select("g"), "g", "left_anti"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all ends of the edges (a, b): the least id that each reaches, by labels that move along edges and jump.
    The labels are written small: joins say that they sort, or every round would send them through the driver."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near.hint("merge"), labels["id"] == near["a"]).select("id", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("next"))
        new = cut(moved.join(jump.hint("merge"), moved["comp"] == F.col("to")).select("id", "before", F.least("comp", "next").alias("comp")))
        labels = new.select("id", "comp")
        if new.where("comp <> before").isEmpty():
            return labels


def ranked(confidence: Column, id_: Column) -> Column:
    """A sort key: higher confidence first, then lower id."""
    return F.struct((-confidence).alias("c"), id_.alias("i"))
