"""Substring dedup by level-wise doubling.

A word goes if a window of 13 words over it also starts in a document with a smaller doc_id. Windows are tried at growing
lengths, each about twice the one before (13 takes 7, 7 takes `seed` or more): all windows of the first length are counted,
and a longer window is a candidate only if its first and its last half both repeat at the length before. Levels end at the
wanted window, or as soon as no candidate survives. What repeats at the last level is given with its smallest doc_id.

Documents are dealt to groups of a few megabytes by a hash of doc_id. A group sends each different hash of a level once, so
a passage that a third of all documents share costs an entry for each group, not for each document; within a group, repeats
are settled on the spot. Hashes travel packed, one row for each group and bucket of hashes; up to the last level 32 bits of
a hash within its bucket, as a chance hit there only adds a candidate, at the last level all 64.

Null and empty texts have no words and lose none. A null doc_id counts as the largest long; doc_id is of an integer type, as
its order decides. Rows without one are counted by text and dealt by it, so a third of all rows may lack it. Rows with equal doc_id are one document: they take nothing from each other. A very long text is processed
whole, in one group. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import settle
from .text import U64, blocks, prefix_hash, span_hash, utf8, words

WINDOW = 13
SEED = 5
#: Bytes of text in a group; words in a bucket.
GROUP_BYTES, BUCKET = 6_000_000, 1_000_000
_LAST = (1 << 63) - 1


def levels(window: int, seed: int) -> list[int]:
    """Lengths from the first to the wanted one: each is the half, rounded up, of the next."""
    out = [window]
    while -(-out[0] // 2) >= seed:
        out.insert(0, -(-out[0] // 2))
    return out


class Group:
    """The documents of one group in order of doc_id, and the hashes of their words."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.take(pc.sort_indices(docs, [("id", "ascending")]))
        self.ids = self.docs.column("id").to_numpy()
        data, offsets = utf8(self.docs.column("text"))
        hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for i, j in blocks(offsets):
            w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes.append(w.hash)
            counts.append(w.count)
        h = np.concatenate(hashes)
        self.n_words = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.row = np.repeat(np.arange(len(self.ids)), self.n_words)
        self.sums = prefix_hash(h)

    def windows(self, length: int) -> np.ndarray:
        """Where windows of that many words start."""
        n = max(0, len(self.row) - length + 1)
        return np.flatnonzero(self.row[:n] == self.row[length - 1 :][:n]) if n else np.zeros(0, np.int64)

    def hash(self, at: np.ndarray, length: int) -> np.ndarray:
        return span_hash(*self.sums, at, at + length)

    def candidates(self, length: int, half: int, slots: np.ndarray, buckets: int) -> np.ndarray:
        """Starts of the windows both halves of which are among the repeated ones; slots: those, in order."""
        alive = np.zeros(len(self.row) + 1, bool)
        at = self.windows(half)
        alive[at] = among(slot(self.hash(at, half), buckets), slots)
        at = self.windows(length)
        return at[alive[at] & alive[at + length - half]]


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are in order."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def slot(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash, and 32 bits of it below."""
    return (h >> U64(32)) % U64(buckets) << U64(32) | h & U64(0xFFFFFFFF)


def packed(group: int, bucket: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.Table:
    """One row for each bucket with entries: its arrays as bytes; bucket ascends."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(edge))
    out = {"grp": pa.array(np.full(len(filled), group, np.int32)), "bucket": pa.array(filled.astype(np.int32))}
    for name, x in columns.items():
        out[name] = pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in filled], pa.binary())
    return pa.table(out)


def unpacked(t: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all rows, and the row of each."""
    blobs = t.column(name).to_pylist()
    out = np.frombuffer(b"".join(blobs), kind)
    return out, np.repeat(np.arange(len(blobs)), [len(x) // out.itemsize for x in blobs])


def returned(t: pa.Table, row: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Entries back to the groups whose rows they came in."""
    order = np.argsort(row, kind="stable")
    edge = np.searchsorted(row[order], np.arange(t.num_rows + 1))
    filled = np.flatnonzero(np.diff(edge))
    out = {k: t.column(k).take(pa.array(filled)) for k in ("grp", "bucket")}
    for name, x in columns.items():
        out[name] = pa.array([x[order[edge[k] : edge[k + 1]]].tobytes() for k in filled], pa.binary())
    return pa.table(out)


def _slots(answers: pa.Table) -> np.ndarray:
    low, row = unpacked(answers, "low", np.uint32)
    return np.sort(answers.column("bucket").to_numpy().astype(U64)[row] << U64(32) | low.astype(U64))


_LOW, _FULL = "grp int, bucket int, low binary", "grp int, bucket int, hash binary, owner binary"


def repeated(docs: DataFrame, lengths: list[int], buckets: int) -> DataFrame | None:
    """(grp, bucket, low): what repeats at the last of these lengths, for each group that holds it; None if nothing does.
    docs: (grp, id, text)."""
    grouped, known = docs.groupBy("grp"), None

    def counted(key: tuple, t: pa.Table) -> pa.Table:
        low, row = unpacked(t, "low", np.uint32)
        order = np.argsort(low, kind="stable")
        low, row = low[order], row[order]
        same = np.append(low[1:] == low[:-1], False)
        same[1:] |= same[:-1]
        # a window that repeats within its group came twice
        own = same & np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))
        return returned(t, row[own], low=low[own])

    def sender(half: int, length: int):
        def of(g: Group, at: np.ndarray, group: int) -> pa.Table:
            slots = np.sort(slot(g.hash(at, length), buckets))
            run = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, np.int64)
            slots = slots[np.arange(len(slots)) - np.repeat(run, np.diff(np.append(run, len(slots)))) < 2]
            return packed(group, slots >> U64(32), buckets, low=slots.astype(np.uint32))

        def every(key: tuple, t: pa.Table) -> pa.Table:
            g = Group(t)
            return of(g, g.windows(length), key[0].as_py())

        def longer(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
            g = Group(t)
            return of(g, g.candidates(length, half, _slots(answers), buckets), key[0].as_py())

        return longer if half else every

    for half, length in zip([0, *lengths], lengths, strict=False):
        if known is None:
            rows = grouped.applyInArrow(sender(half, length), _LOW)
        else:
            rows = grouped.cogroup(known.groupBy("grp")).applyInArrow(sender(half, length), _LOW)
        known = settle(rows.groupBy("bucket").applyInArrow(counted, _LOW))
        if known.isEmpty():
            return None
    return known


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group_bytes: int = GROUP_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with_text adds the kept words joined by a space."""
    kind_of_id = docs.schema["doc_id"].dataType
    if not isinstance(kind_of_id, T.IntegralType):
        raise TypeError(f"doc_id must be of an integer type, not {kind_of_id.simpleString()}")
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    n_groups, buckets = max(1, -(-size // group_bytes)), max(1, size // (6 * BUCKET))
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("nameless"))
    nameless = docs.where("doc_id is null").groupBy("text").agg(F.count("*").alias("copies"))
    nameless = nameless.select(F.lit(_LAST).alias("id"), "text", "copies", F.lit(True).alias("nameless"))
    # rows of one id take nothing from each other wherever they are, so those without an id are dealt by their texts
    key = F.when(F.col("nameless"), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    rows = named.unionByName(nameless).withColumn("grp", F.pmod(key, F.lit(n_groups)).cast("int"))
    grouped = rows.groupBy("grp")
    *before, _ = levels(window, seed)
    half = before[-1] if before else window
    known = repeated(rows.select("grp", "id", "text"), before or [window], buckets)

    def last(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(t)
        at = g.candidates(window, half, _slots(answers), buckets)
        # owners ascend, so the first of equal hashes has the smallest
        h, first = np.unique(g.hash(at, window), return_index=True)
        owner = g.ids[g.row[at[first]]] if len(at) else np.zeros(0, np.int64)
        bucket = (h >> U64(32)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        return packed(key[0].as_py(), bucket[order], buckets, hash=h[order], owner=owner[order].astype(np.int64))

    def judged(key: tuple, t: pa.Table) -> pa.Table:
        (h, row), (owner, _) = unpacked(t, "hash", U64), unpacked(t, "owner", np.int64)
        order = np.lexsort((owner, h))
        h, row, owner = h[order], row[order], owner[order]
        run = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        least = np.repeat(owner[run], np.diff(np.append(run, len(h))))
        later = owner > least
        return returned(t, row[later], hash=h[later], owner=least[later])

    def finish(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(t)
        at = g.windows(window)
        h, owner = g.hash(at, window), g.ids[g.row[at]] if len(at) else np.zeros(0, np.int64)
        gone = among(h, np.sort(unpacked(answers, "hash", U64)[0]))
        if len(at):
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            gone |= owner[first][which] < owner
        edge = np.zeros(int(g.first[-1]) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, np.minimum(at[gone] + window, len(edge) - 1), -1)
        removed = np.cumsum(edge)[:-1] > 0
        per_row = np.concatenate([[0], np.cumsum(removed)])
        n_removed = per_row[g.first[1:]] - per_row[g.first[:-1]]
        kept = []
        for r, text in enumerate(g.docs.column("text")):
            found = (text.as_py() or "").encode().split()
            if n_removed[r]:
                found = [w for w, x in zip(found, removed[g.first[r] : g.first[r + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(found))
        out = {
            "doc_id": pa.array(g.ids, mask=g.docs.column("nameless").to_numpy()),
            "copies": g.docs.column("copies"),
            "n_words": pa.array(g.n_words.astype(np.int64)),
            "n_removed": pa.array(n_removed.astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array([k.decode() for k in kept], pa.string())
        return pa.table(out)

    if known is None:
        later = docs.sparkSession.createDataFrame([], _FULL)
    else:
        later = grouped.cogroup(known.groupBy("grp")).applyInArrow(last, _FULL).groupBy("bucket").applyInArrow(judged, _FULL)
    schema = "doc_id long, copies long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    out = grouped.cogroup(later.groupBy("grp")).applyInArrow(finish, schema)
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind_of_id))
