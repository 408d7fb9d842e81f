"""Classes of items that links join, found from shared signatures without making a row for each pair that shares one.

Signatures put items into buckets; items that are linked share at least one bucket. First each item is tested against the
pivots of its buckets; the links found give classes. Then items are tested against bucket-mates of other classes, as far as
a bound on the marks of the two items leaves room for a link. Every pair that shares a bucket is in the end in one class,
ruled out by the bound, or tested, so no link between classes is lost, while copies that are linked through one another
cost a few tests each. The bound is compared inside the join; it makes no rows, and Spark splits a bucket that holds many
items over tasks (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small, settle


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of the links (a, b): comp is the least id that links reach.

    Labels move along links and jump to the label of their label; each round is written to the shared folder, so a lost
    executor repeats one round at most. A hub's many links are no hot key while the labels are few enough to broadcast;
    beyond that the skew join splits them."""
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        known = broadcast_if_small(labels)
        own = labels.select(F.col("id").alias("a"), "comp", F.col("comp").alias("before"))
        near = both.join(known, both["b"] == known["id"]).select("a", "comp", F.lit(None).cast("long").alias("before"))
        moved = near.union(own).groupBy("a").agg(F.min("comp").alias("comp"), F.max("before").alias("before"))
        jump = known.select(F.col("id").alias("to"), F.col("comp").alias("next"))
        new = settle(moved.join(jump, moved["comp"] == F.col("to")).select(F.col("a").alias("id"), "before", F.least("comp", "next").alias("comp")))
        labels = new.select("id", "comp")
        if new.where("comp <> before").isEmpty():
            return labels


def stars(members: DataFrame, pivots: list[str]) -> DataFrame:
    """Different pairs (a, b) of each member with the pivots of its bucket, which are columns of its row."""
    ends = members.select("id", F.explode(F.array(*pivots)).alias("pivot")).where("id <> pivot")
    return ends.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def classes(tests: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame], marks: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """(id, comp) of the items that have a link.

    tests: the pairs (a, b), a < b, that are tested first. members: (sig, id, own) of the buckets in which those do not
    cover every pair that may link; of such a pair at least one is an own member. verify: takes pairs (a, b) and returns
    those that are linked. marks: (id, mark); possible(a, b): a condition on the columns of two marks that holds for every
    linked pair."""
    of = lambda end: marks.select(F.col("id").alias(end), F.col("mark").alias(f"_m{end}"))
    tested = settle(tests.join(of("a"), "a").join(of("b"), "b").where(possible("_ma", "_mb")).select("a", "b"))
    comp = components(settle(verify(tested)))
    todo = settle(_across(members, comp, marks, possible).join(tested, ["a", "b"], "left_anti"))
    found = settle(verify(todo))
    if found.isEmpty():
        return comp
    # the new links join classes: only those are labelled again
    fresh = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))
    every = settle(comp.union(fresh))
    named = lambda end: every.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}"))
    between = found.join(named("a"), "a").join(named("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between).select(F.col("id").alias("comp"), F.col("comp").alias("_into"))
    return settle(every.join(broadcast_if_small(joined), "comp", "left").select("id", F.coalesce("_into", "comp").alias("comp")))


def _across(members: DataFrame, comp: DataFrame, marks: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of bucket-mates of different classes that the bound does not rule out."""
    named = settle(members.join(broadcast_if_small(comp), "id", "left").select("sig", "id", "own", F.coalesce("comp", "id").alias("comp")))
    open_ = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    left = settle(named.join(open_, "sig").join(marks, "id"))
    a = left.where("own").select(F.col("sig").alias("sa"), F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("mark").alias("mx"))
    b = left.select("sig", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("mark").alias("my"), F.col("own").alias("oy"))
    able = (F.col("cx") != F.col("cy")) & (~F.col("oy") | (F.col("x") < F.col("y"))) & possible("mx", "my")
    pairs = a.join(b, (F.col("sa") == F.col("sig")) & able)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
