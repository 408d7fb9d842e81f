"""N-gram Jaccard join: a size-aware heavy-light join of documents on their sets of five-word shingles.

Two documents link when 100 * |A and B| >= 80 * |A or B|. Linked sets hold at least 80 % of either set in common, so
candidates come from:

* Light sets, of up to `boundary` elements: if |A and B| = c, both hold a common subset of c elements. All subsets of these
  fixed sizes are enumerated.
* Heavy sets: inverted lists. The elements of a set are put in one order for all sets, rare ones first. A set of n elements
  is listed under the first n - ceil(0.8 n) + 1 of them, and linked sets meet in at least one of these lists. Elements that
  no other set holds need no list, so a text without a near copy costs no row.
* The boundary is the size up to which subsets cost fewer rows than the lists that would be scanned instead, both as
  measured on all sets.

No link is lost: what orders the elements is a count of how many sets hold each, but any order would do, so counts are sent
as 32-bit hashes in a bucket and rounded to steps of a quarter of a power of two.

Lists of one set are dropped. Members of a list are not paired with each other: `linking` tests them by class, first
against the member with the most elements that others hold too, the centre of a group of copies. Pairs are first held
against a bound: each set has 512 parity bits, and sets whose bits differ in k places differ in at least k elements. Every
test compares the two whole sets. Shingles are compared by 64-bit hash.

Texts are dealt to groups of a few megabytes by hash; equal texts are one. Null and empty texts, and texts without words,
have no shingles and link with nothing. A null doc_id can be linked but gives no component_id to others; ids of any type
that has an order will do. Rows with equal doc_id each give a row. Other columns, whatever their names, are ignored, or
kept by `one_of_each`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import body, broadcast_if_small, columns, settle
from .linking import classes, stars
from .text import U64, blocks, lower_ascii, mix, utf8, windows, words

SHINGLE = 5
PERCENT = 80
#: Largest size for which subsets are considered.
LIGHT = 12
#: Bytes of text in a group and shingles in a bucket of counts.
GROUP_BYTES, BUCKET = 4_000_000, 1_000_000
#: Kinds of rows that a group gives: a list that holds a set, a subset of a set, a text with its set.
LIST, SUBSET, TEXT = 0, 1, 2
PARITY = 8


def sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each row."""
    w = words(lower_ascii(data), offsets)
    at, h = windows(w, k)
    edge = np.searchsorted(at, w.first)
    out = []
    for r, n in enumerate(w.count.tolist()):
        if n >= k:
            out.append(np.unique(h[edge[r] : edge[r + 1]]))
        elif n:
            whole = n
            for x in w.hash[w.first[r] : w.first[r + 1]].tolist():
                whole = (whole * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            out.append(mix(np.array([whole], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def needed(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Least number of elements that a set of n elements has in common with any set that it is linked with."""
    return -(-percent * n // 100)


def set_key(s: np.ndarray) -> int:
    return int(np.int64(mix(np.array([mix(s).sum(dtype=U64) + U64(len(s))], U64)).view(np.int64)[0]))


def subsets(s: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the subsets that a set of n elements may have in common with a linked one; s: its elements that are shared."""
    spread, keys = mix(s), [np.zeros(0, U64)]
    for c in range(max(1, needed(n, percent)), len(s) + 1):
        chosen = np.array(list(combinations(range(len(s)), c)), np.int64).reshape(-1, c)
        keys.append(mix(spread[chosen].sum(axis=1, dtype=U64) + U64(c * 0x632BE59BD9B4E019 % (1 << 64))))
    return np.concatenate(keys)


def parity(s: np.ndarray) -> np.ndarray:
    """64 * PARITY bits: bit i tells whether an odd number of elements hash to i."""
    place = (mix(s ^ U64(0x5851F42D4C957F2D)) % U64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def possible(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether the marks of two sets (their sizes and parity bits) leave room for a link."""
    A, B = F.col(a), F.col(b)
    differ = sum((F.bit_count(A[f"w{k}"].bitwiseXOR(B[f"w{k}"])) for k in range(PARITY)), F.lit(0))
    fits = F.least(A["n"], B["n"]) * 100 >= F.greatest(A["n"], B["n"]) * percent
    return fits & (differ * (100 + percent) <= (A["n"] + B["n"]) * (100 - percent))


def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column did not come before in this task (in the last million different ones)."""
    seen: set = set()
    for batch in batches:
        keep = []
        for k, x in enumerate(batch.column(0).to_pylist()):
            if x not in seen:
                seen.add(x)
                keep.append(k)
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))


def _sets_of(texts: pa.ChunkedArray) -> list[np.ndarray]:
    data, offsets = utf8(texts)
    return [s for i, j in blocks(offsets) for s in sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]


def _slots(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a shingle, and 32 bits of its hash below it."""
    return ((h >> U64(32)) % U64(buckets)) << U64(32) | h & U64(0xFFFFFFFF)


def in_order(found: list[np.ndarray], slots: np.ndarray, steps: np.ndarray, buckets: int, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(set number, element, step) of the elements under which sets are listed, and step of every element.

    slots, steps: the shared elements in order, and how common they are."""
    h = np.concatenate(found)
    size = np.array([len(s) for s in found], np.int64)
    row = np.repeat(np.arange(len(found)), size)
    step = np.zeros(len(h), np.uint8)
    if len(slots):
        own = _slots(h, buckets)
        at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
        hit = slots[at] == own
        step[hit] = steps[at[hit]]
    order = np.lexsort((h, step, row))
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    listed = order[(place < (size - needed(size, percent) + 1)[row]) & (step[order] > 0)]
    return row[listed], h[listed], step[listed], step


def grouped_rows(docs: DataFrame, group_bytes: int = GROUP_BYTES, bucket: int = BUCKET) -> DataFrame:
    """(kind, sig, id, n, score, df, w0, w1, ...): the lists and subsets of each different text's set, and the text itself
    (sig: its tid; id: the set's key, null for an empty set). docs: (tid, text)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    n_groups, n_buckets = max(1, -(-size // group_bytes)), max(1, size // (6 * bucket))
    texts = docs.select("tid", "text").mapInArrow(once_a_task, docs.select("tid", "text").schema)
    grouped = texts.withColumn("grp", F.pmod("tid", F.lit(n_groups)).cast("int")).groupBy("grp")

    def sent(key: tuple, t: pa.Table) -> pa.Table:
        slot = np.sort(_slots(np.concatenate(_sets_of(t.column("text"))), n_buckets))
        # a shingle that many texts of the group hold is sent four times at most
        run = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        slot = slot[np.arange(len(slot)) - np.repeat(run, np.diff(np.append(run, len(slot)))) < 4]
        edge = np.searchsorted(slot, np.arange(n_buckets + 1).astype(U64) << U64(32))
        low = slot.astype(np.uint32)
        filled = np.flatnonzero(np.diff(edge))
        blobs = [low[edge[k] : edge[k + 1]].tobytes() for k in filled]
        group = np.full(len(filled), key[0].as_py(), np.int32)
        return pa.table({"grp": pa.array(group), "bucket": pa.array(filled.astype(np.int32)), "low": pa.array(blobs, pa.binary())})

    def counted(key: tuple, t: pa.Table) -> pa.Table:
        blobs = t.column("low").to_pylist()
        low = np.frombuffer(b"".join(blobs), np.uint32)
        owner = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
        order = np.argsort(low, kind="stable")
        low, owner = low[order], owner[order]
        run = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        n = np.diff(np.append(run, len(low)))
        step = np.repeat(np.where(n > 1, np.minimum(255, 4 * np.log2(n)), 0).astype(np.uint8), n)
        first = np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))
        back = np.flatnonzero(first & (step > 0))
        back = back[np.argsort(owner[back], kind="stable")]
        edge = np.searchsorted(owner[back], np.arange(len(blobs) + 1))
        filled = np.flatnonzero(np.diff(edge))
        parts = [back[edge[k] : edge[k + 1]] for k in filled]
        return pa.table({
            "grp": t.column("grp").take(pa.array(filled)), "bucket": t.column("bucket").take(pa.array(filled)),
            "low": pa.array([low[x].tobytes() for x in parts], pa.binary()), "step": pa.array([step[x].tobytes() for x in parts], pa.binary()),
        })

    def listed(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        lows, steps = answers.column("low").to_pylist(), b"".join(answers.column("step").to_pylist())
        above = np.repeat(answers.column("bucket").to_numpy().astype(U64), [len(x) // 4 for x in lows])
        slots = above << U64(32) | np.frombuffer(b"".join(lows), np.uint32).astype(U64)
        order = np.argsort(slots)
        found = _sets_of(t.column("text"))
        row, h, step, every = in_order(found, slots[order], np.frombuffer(steps, np.uint8)[order], n_buckets)
        size = np.array([len(s) for s in found], np.int64)
        ids = np.array([set_key(s) if len(s) else 0 for s in found], np.int64)
        shared = np.concatenate([[0], np.cumsum(every > 0)])
        ends = np.cumsum(size)
        score = (1000 * (shared[ends] - shared[ends - size]) // np.maximum(1, size)).astype(np.int32)
        kind, sig, of, df = [np.full(len(row), LIST, np.int8)], [mix(h + U64(1))], [row], [2.0 ** (step / 4.0)]
        for k in np.flatnonzero((size > 0) & (size <= LIGHT)).tolist():
            keys = subsets(found[k][every[ends[k] - size[k] : ends[k]] > 0], int(size[k]))
            for column, x in ((kind, np.full(len(keys), SUBSET, np.int8)), (sig, keys), (of, np.full(len(keys), k)), (df, np.ones(len(keys)))):
                column.append(x)
        n = len(found)
        kind.append(np.full(n, TEXT, np.int8))
        sig.append(t.column("tid").to_numpy().astype(np.int64).view(U64))
        of.append(np.arange(n))
        df.append(np.ones(n))
        at = np.concatenate(of)
        lists = len(at) - n
        bits = np.stack([parity(s) for s in found])
        own = [pa.array(np.concatenate([np.zeros(lists, np.int64), bits[:, k]]), mask=np.arange(len(at)) < lists) for k in range(PARITY)]
        columns = [np.concatenate(kind), np.concatenate(sig).view(np.int64), None, size[at].astype(np.int32), score[at], np.concatenate(df).astype(np.int64)]
        arrays = [pa.array(ids[at], mask=size[at] == 0) if x is None else pa.array(x) for x in columns]
        return pa.table([*arrays, *own], names=["kind", "sig", "id", "n", "score", "df", *[f"w{k}" for k in range(PARITY)]])

    counts = grouped.applyInArrow(sent, "grp int, bucket int, low binary").groupBy("bucket").applyInArrow(counted, "grp int, bucket int, low binary, step binary")
    marks = "".join(f", w{k} long" for k in range(PARITY))
    return grouped.cogroup(counts.groupBy("grp")).applyInArrow(listed, f"kind byte, sig long, id long, n int, score int, df long{marks}")


def boundary(found: DataFrame) -> int:
    """The size up to which sets are joined by subsets: where these rows and the lists scanned for larger sets are fewest."""
    costs = found.where((F.col("kind") != TEXT) & (F.col("n") <= LIGHT)).groupBy("n").agg(
        F.count(F.when(F.col("kind") == SUBSET, 1)).alias("subsets"), F.sum(F.when(F.col("kind") == LIST, F.col("df")).otherwise(0)).alias("scanned")
    )
    by_size = {r["n"]: (r["subsets"], r["scanned"]) for r in costs.collect()}  # LIGHT rows at most
    total = {light: sum(cost[n > light] for n, cost in by_size.items()) for light in range(LIGHT + 1)}
    return min(total, key=lambda light: (total[light], light))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys whose sets link; texts: (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = utf8(batch.column(2))[1] + utf8(batch.column(3))[1]
            for i, j in blocks(offsets):
                part = batch.slice(i, j - i)
                a, b = sets(*utf8(part.column(2))), sets(*utf8(part.column(3)))
                yield part.filter(pa.array([linked(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def set_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, comp) of the sets that link with another one; rows: (tid, text)."""
    light = boundary(found)
    heavy = (F.col("kind") == LIST) & (F.col("n") * 100 >= PERCENT * (light + 1))
    lists = found.where(heavy | ((F.col("kind") == SUBSET) & (F.col("n") <= light))).select("sig", "id", "score")
    centre = F.max_by("id", F.col("score") * F.lit(1 << 40) + F.pmod("id", F.lit(1 << 40)))
    pivots = lists.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), centre.alias("centre")).where("lo < hi")
    members = settle(lists.join(pivots.drop("hi"), "sig").distinct())
    of_text = found.where((F.col("kind") == TEXT) & F.col("id").isNotNull())
    wanted = settle(members.select("id").distinct())
    each = of_text.groupBy("id").agg(F.first(F.struct("n", *[f"w{k}" for k in range(PARITY)])).alias("mark"), F.min("sig").alias("tid"))
    each = settle(each.join(broadcast_if_small(wanted), "id"))

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        places = settle(each.select("id", "tid").join(ids, "id"))
        texts = rows.join(broadcast_if_small(places), "tid").select("id", "text")
        texts = texts.mapInArrow(once_a_task, texts.schema).groupBy("id").agg(F.first("text").alias("text"))
        return verified(pairs, settle(texts))

    return classes(settle(stars(members, ["lo", "centre"])), members.withColumn("own", F.lit(True)), verify, each.select("id", "mark"), possible)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select("doc_id", F.xxhash64(body()).alias("tid"), body().alias("text"))
    found = settle(grouped_rows(rows))
    comp = set_classes(rows.select("tid", "text"), found)
    texts = found.where(F.col("kind") == TEXT).select(F.col("sig").alias("tid"), "id", F.col("n").cast("long").alias("n_shingles")).distinct()
    named = texts.join(broadcast_if_small(comp), "id", "left").select("tid", "n_shingles", F.coalesce("comp", "id").alias("comp"))
    # the least doc_id of a text first, so that a class is dealt by its different texts
    least = rows.groupBy("tid").agg(F.min("doc_id").alias("least"))
    by_text = settle(named.join(least, "tid"))
    of_class = by_text.where("comp is not null").groupBy("comp").agg(F.min("least").alias("of_class"), F.count("*").alias("n")).where("n > 1").select("comp", "of_class")
    by_text = by_text.join(broadcast_if_small(settle(of_class), 300_000), "comp", "left")
    by_text = settle(by_text.select("tid", "n_shingles", F.when(F.col("comp").isNotNull(), F.coalesce("of_class", "least")).alias("of_class")))
    out = rows.select("doc_id", "tid").join(broadcast_if_small(by_text, 300_000), "tid")
    return out.select("doc_id", "n_shingles", F.coalesce("of_class", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, all columns, of documents that are the smallest of their component."""
    found = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_skerry_copy")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("_skerry_copy"), "left_anti")
