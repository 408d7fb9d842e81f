"""Suffix-array dedup by blockwise construction with a difference cover.

Every byte goes that a string of 100 bytes covers which also starts earlier (in a document with a smaller doc_id, or earlier
in the same one). Strings are the suffixes of the texts, compared over 100 bytes.

Suffixes are dealt to buckets by content: that of a suffix is the least hash among the substrings of GRAM bytes within its 100
bytes, so equal ones share it, and as neighbours mostly share it too, runs of suffixes travel together as one piece of text
(about 4 bytes for each suffix). A piece that comes again within a batch or a bucket is settled on the spot: what starts
later goes. Of the rest, pieces with a hash of their own have no equals unless they repeat
themselves; all others are sorted.

A bucket's pieces are laid side by side. Its suffixes are sorted one block (some hashes) at a time by their first COVER bytes,
refined word by word. Those still tied are resolved by ranks of the cover sample: of any two places i and j some place less
than COVER further is in the sample for both, and its rank decides. The sample is sorted once before, and only where ties can
reach it. Memory is bounded by the bucket's text and one block's keys. Neighbours in the order that agree in 100 bytes form
classes, and all but the earliest of a class go. Comparisons are of bytes; hashes only deal.

A bucket of more than LIMIT bytes of different pieces is handed back unsorted, as it arrives, and dealt again with other
hashes, until none is left; at the last level a suffix is dealt by its own 100 bytes, so that a bucket holds few different
ones. Packed pieces of a batch and bucket are compressed.

Null and empty texts have no bytes and lose none. doc_id is an integer; null counts as larger than all others. Rows with equal
doc_id are one document: of equal strings the one that starts earlier stays, and at equal starts both stay, so repeated rows
lose nothing to each other. A removed part may split a character. Very long texts are read whole. Other columns, whatever
their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import settle
from .text import _BYTES, U64, blocks, mix, prefix_hash, span_hash, utf8

LENGTH, GRAM, COVER = 100, 24, 31
#: Bytes of text cut at once, packed together, aimed at in a bucket and in a group, and most of different pieces sorted in one.
CUT, PACK, BUCKET, GROUP_BYTES, LIMIT = 1 << 20, 12_000_000, 6_000_000, 6_000_000, 48_000_000
#: Suffixes of a block; times a bucket is dealt before the last level.
BLOCK, LEVELS = 500_000, 3


def difference_cover(v: int) -> list[int]:
    """Places, taken greedily, whose differences are all numbers below v."""
    cover, left = [0], set(range(1, v))
    while left:
        best = max(range(v), key=lambda c: (len(left & {x for y in cover for x in ((c - y) % v, (y - c) % v)}), -c))
        cover.append(best)
        left -= {(x - y) % v for x in cover for y in cover}
    return sorted(cover)


_COVER = difference_cover(COVER)
_IN_COVER = np.isin(np.arange(COVER), _COVER)
#: How far it is from places i and j (by their remainders) to the next one that is in the sample for both.
_AHEAD = np.array([[next(d for d in range(COVER) if _IN_COVER[(i + d) % COVER] and _IN_COVER[(j + d) % COVER]) for j in range(COVER)] for i in range(COVER)])


def least_hashes(data: np.ndarray, length: int, gram: int, seed: int) -> np.ndarray:
    """For each start of `length` bytes, the least seeded hash of the substrings of `gram` bytes inside."""
    n = len(data) - gram + 1
    h = mix(span_hash(*prefix_hash(_BYTES[data]), np.arange(n), np.arange(gram, n + gram)) ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: n - wide + 1], h[wide - span :][: n - wide + 1]) if wide > span else h


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end and hash of the pieces of the rows of a block: runs of suffixes with one hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    h = least_hashes(data, length, min(GRAM, length) if level < LEVELS else length, level)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: len(h)] == row[length - 1 :]
    start = whole.copy()
    start[1:] &= ~whole[:-1] | (h[1:] != h[:-1]) | (row[1 : len(h)] != row[: len(h) - 1])
    end = whole.copy()
    end[:-1] &= ~whole[1:] | start[1:]
    at, last = np.flatnonzero(start), np.flatnonzero(end)
    return row[at], at, last + length, h[at]


class Cutter:
    """Cuts rows (id, rid, at, text), `at` being where the text begins in its row, and packs the pieces by bucket."""

    def __init__(self, length: int, level: int, buckets: int):
        self.length, self.level, self.buckets = length, level, buckets
        self.clear()

    def clear(self) -> None:
        self.seen, self.parts, self.gone, self.bytes = {}, [], [], 0

    def add(self, ids: np.ndarray, rids: np.ndarray, places: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        for i, j in blocks(offsets, CUT):
            part = data[offsets[i] : offsets[j]]
            row, start, end, h = pieces(part, offsets[i : j + 1] - offsets[i], self.length, self.level)
            raw, at = part.tobytes(), places[i:j][row] + start - (offsets[i:j] - offsets[i])[row]
            for one in zip(h.tolist(), ids[i:j][row].tolist(), at.tolist(), rids[i:j][row].tolist(), map(raw.__getitem__, map(slice, start.tolist(), end.tolist())), strict=True):
                self.one(*one)
            self.bytes += len(part)

    def one(self, h: int, doc: int, at: int, rid: int, text: bytes) -> None:
        """Keeps the earliest place of each text; what starts later goes, what starts at the same is kept beside it."""
        known = self.seen.setdefault(text, [h, doc, at, rid])
        if (known[1], known[2]) == (doc, at):
            if known[3] != rid:
                self.parts.append((h, doc, at, rid, text))
        elif (known[1], known[2]) < (doc, at):
            self.gone.append((doc, rid, at, at + len(text)))
        else:
            self.gone.append((known[1], known[3], known[2], known[2] + len(text)))
            known[1:] = doc, at, rid

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        texts = [*self.seen, *(p[4] for p in self.parts)]
        heads = [*self.seen.values(), *(list(p[:4]) for p in self.parts)]
        h = np.fromiter((x[0] for x in heads), U64, len(heads))
        return h, *(np.fromiter((x[k] for x in heads), np.int64, len(heads)) for k in (1, 2, 3)), texts

    def packed(self) -> Iterator[pa.RecordBatch]:
        """Rows of _PACKED: a bucket's pieces, and bucket by bucket what goes already."""
        h, doc, at, rid, texts = self.table()
        bucket = (h >> U64(20)) % U64(self.buckets)
        order = np.lexsort((at, doc, bucket))
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[b] : edge[b + 1]]
            joined = b"".join([texts[k] for k in own.tolist()])
            head = np.concatenate([h[own].view(np.int64), doc[own], at[own], rid[own], np.fromiter((len(texts[k]) for k in own.tolist()), np.int64, len(own))])
            yield _row(b, len(own), head, joined)
        for low in range(0, len(self.gone), 50_000):
            part = np.array(self.gone[low : low + 50_000], np.int64)
            yield _row(int(part[0, 2]) % self.buckets, -len(part), part.T.ravel(), b"")
        self.clear()


_PACKED = "bucket int, n int, size int, head binary, text binary"
_GONE = "id long, rid long, start long, stop long, text binary"


def _row(bucket: int, n: int, head: np.ndarray, text: bytes) -> pa.RecordBatch:
    """One packed row; head: n numbers of each kind. Long ones are compressed, short ones left to the shuffle's codec."""
    squeezed = [pa.compress(x, codec="zstd", asbytes=True) for x in (head.tobytes(), text)]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int32()), pa.array([len(text)], pa.int32()), *[pa.array([x], pa.binary()) for x in squeezed]], ["bucket", "n", "size", "head", "text"])


def _unpacked(head: bytes, text: bytes, n: int, size: int, kinds: int) -> tuple[np.ndarray, bytes]:
    numbers = np.frombuffer(pa.decompress(head, decompressed_size=abs(n) * kinds * 8, codec="zstd", asbytes=True), np.int64).reshape(kinds, abs(n))
    return numbers, pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row begins a run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Suffixes:
    """The suffixes of the pieces of a bucket, sorted block by block."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        pad = np.zeros(COVER + length + 16, np.uint8)
        self.data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), pad])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first, self.count = np.cumsum(sizes) - sizes, sizes - length + 1
        self.rank = None

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as a number that orders like them."""
        out = np.zeros(len(at), U64)
        for k in range(8):
            out = out << U64(8) | self.data[at + k].astype(U64)
        return out

    def refined(self, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of (group, their first `length` bytes), and the number of the run of equal ones of each; group is
        in order. Only places that are still tied are looked at further."""
        tied, at, group = np.arange(len(at)), at.copy(), group.copy()
        for k in range(0, length, 8):
            again = group[tied]
            alone = runs([again])
            tied = tied[~(alone & np.append(alone[1:], True))]
            if not len(tied):
                break
            word = self.word(at[tied] + k)
            if k + 8 > length:
                word &= ~U64((1 << 8 * (k + 8 - length)) - 1)
            order = np.lexsort((word, group[tied]))
            at[tied] = at[tied][order]
            new = runs([group[tied], word[order]])
            # a group's number is the place of its first member, so numbers stay in order
            group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        return at, group

    def sample(self, near: np.ndarray) -> None:
        """Ranks of the sample within reach of these places, over `length` bytes; equal ones share a rank."""
        reach = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(reach, near, 1)
        np.add.at(reach, np.minimum(near + COVER, len(self.data)), -1)
        at = np.flatnonzero((np.cumsum(reach)[:-1] > 0) & _IN_COVER[np.arange(len(self.data)) % COVER])
        at = at[at < len(self.data) - self.length - 8]
        order, group = self.refined(at, np.zeros(len(at), np.int64), self.length)
        self.rank = np.zeros(len(self.data), np.int32)
        self.rank[order] = group

    def later(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the tied places a come after b, by the sample."""
        ahead = _AHEAD[a % COVER, b % COVER]
        return self.rank[a + ahead] > self.rank[b + ahead]

    def resolved(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Places with the members of each run of ties put in order: Batcher's merge exchange, on all runs of like size at once."""
        edge = np.append(np.flatnonzero(runs([group])), len(group))
        size = np.diff(edge)
        depth = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for p in np.unique(depth[size > 1]).tolist():
            first, width = edge[:-1][(depth == p) & (size > 1)], 1 << p
            many = size[(depth == p) & (size > 1)]
            slots = first[:, None] + np.arange(width)
            filled = np.arange(width) < many[:, None]
            m = np.where(filled, at[np.minimum(slots, len(at) - 1)], -1)
            for low, high in _exchanges(width):
                a, b = m[:, low], m[:, high]
                swap = (a < 0) & (b >= 0)
                both = (a >= 0) & (b >= 0)
                swap[both] = self.later(a[both], b[both])
                m[:, low], m[:, high] = np.where(swap, b, a), np.where(swap, a, b)
            at[slots[filled]] = m[filled]
        return at

    def classes(self, group_of_piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, offset, class) of the suffixes that have equals, block by block; pieces stand in order of their group."""
        if not len(self.count):
            return
        ends = np.cumsum(self.count)
        last = np.append(np.flatnonzero(np.diff(group_of_piece)), len(self.count) - 1)
        cuts, low = [], 0
        for k in last.tolist():  # a block ends with a group
            if ends[k] - (ends[low - 1] if low else 0) >= BLOCK or k == len(self.count) - 1:
                cuts.append((low, k + 1))
                low = k + 1
        held = []
        for a, b in cuts:
            piece = np.repeat(np.arange(a, b), self.count[a:b])
            offset = np.arange(len(piece)) - np.repeat(np.cumsum(self.count[a:b]) - self.count[a:b], self.count[a:b])
            at, run = self.refined(self.first[piece] + offset, np.searchsorted(group_of_piece[a:b], group_of_piece[a:b], "left")[piece - a], min(COVER, self.length))
            alone = runs([run])
            tied = ~(alone & np.append(alone[1:], True))
            held.append((at[tied], run[tied]))
        self.sample(np.concatenate([at for at, _ in held]))
        for at, run in held:
            if not len(at):
                continue
            at = self.resolved(at, run)
            new = runs([run])
            for k in range(0, self.length, 8):
                word = self.word(at + min(k, max(0, self.length - 8)))
                new[1:] |= word[1:] != word[:-1]
            piece = np.searchsorted(self.first, at, "right") - 1
            yield piece, at - self.first[piece], np.cumsum(new) - 1


def _exchanges(width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of places to compare that put `width` (a power of two) items in order."""
    p = width // 2
    while p:
        q, r, d = width // 2, 0, p
        while True:
            low = np.arange(width - d)
            low = low[(low & p) == r]
            yield low, low + d
            if q == p:
                break
            d, q, r = q - p, q // 2, p
        p //= 2


def repeats_itself(text: bytes, length: int) -> bool:
    """Whether a piece may hold equal strings itself. All its strings hold its middle bytes, if those are GRAM or more, and so
    two equal ones hold them twice."""
    middle = len(text) - length
    if 2 * length - len(text) < GRAM:
        return middle > 0
    return middle > 0 and text.find(text[middle : middle + GRAM], middle + 1) >= 0


def later_starts(h: np.ndarray, doc: np.ndarray, at: np.ndarray, rid: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """(doc, rid, start, stop) of what is covered by strings that start earlier elsewhere in these different pieces."""
    order = np.argsort(h, kind="stable")
    if len(order):
        new = runs([h[order]])
        alone = new & np.append(new[1:], True)
        alone[alone] = [not repeats_itself(texts[k], length) for k in order[alone].tolist()]
        order = order[~alone]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    _, group = np.unique(h[order], return_inverse=True)
    doc, at, rid, out = doc[order], at[order], rid[order], []
    for piece, offset, same in Suffixes([texts[k] for k in order.tolist()], length).classes(group):
        start = at[piece] + offset
        ranked = np.lexsort((start, doc[piece], same))
        piece, offset, same, start = piece[ranked], offset[ranked], same[ranked], start[ranked]
        lead = np.flatnonzero(runs([same]))
        lead = np.repeat(lead, np.diff(np.append(lead, len(same))))
        late = (doc[piece] != doc[piece[lead]]) | (start != start[lead])
        late = np.flatnonzero(late)
        late = late[np.lexsort((offset[late], piece[late]))]
        if len(late):
            piece, start = piece[late], start[late]
            new = np.append(True, (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1))
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
            out.append(np.stack([doc[piece[first]], rid[piece[first]], start[first], start[last] + length], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _gone(rows: np.ndarray, texts: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()) if texts is not None else pa.nulls(len(rows), pa.binary())], ["id", "rid", "start", "stop", "text"])


def _cut(length: int, level: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length, level, buckets)
        for batch in batches:
            data, offsets = utf8(batch.column("text")) if pa.types.is_string(batch.schema.field("text").type) else _binary(batch.column("text"))
            ids, rids, places = (batch.column(c).to_numpy() for c in ("id", "rid", "start"))
            for i, j in blocks(offsets, PACK // 4):
                cutter.add(ids[i:j], rids[i:j], places[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if cutter.bytes >= PACK:
                    yield from cutter.packed()
        yield from cutter.packed()

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _sort(length: int, limit: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts a bucket; gives its pieces back, with their text, once different ones exceed the limit."""
        bucket, size, over = Cutter(length, 0, 1), 0, False
        for batch in batches:
            for n, long, head, text in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "head", "text")), strict=True):
                if n < 0:
                    yield _gone(_unpacked(head, text, n, long, 4)[0].T)
                    continue
                (h, doc, at, rid, sizes), joined = _unpacked(head, text, n, long, 5)
                ends = np.cumsum(sizes)
                split = [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                if not over:
                    known = len(bucket.seen) + len(bucket.parts)
                    for one in zip(h.view(U64).tolist(), doc.tolist(), at.tolist(), rid.tolist(), split, strict=True):
                        bucket.one(*one)
                    size += long * (len(bucket.seen) + len(bucket.parts) - known) // max(1, n)
                    if size <= limit:
                        continue
                    over = True
                    h, doc, at, rid, split = bucket.table()
                    if bucket.gone:
                        yield _gone(np.array(bucket.gone, np.int64))
                    bucket.clear()
                for low in range(0, len(split), 10_000):
                    cut = slice(low, low + 10_000)
                    yield _gone(np.stack([x[cut].astype(np.int64) for x in (doc, rid, at, at)], axis=1), split[cut])
        if not over:
            if bucket.gone:
                yield _gone(np.array(bucket.gone, np.int64))
            yield _gone(later_starts(*bucket.table(), length))

    return run


def removed(docs: DataFrame, length: int, size: int, limit: int = LIMIT) -> DataFrame:
    """(id, rid, start, stop) of what goes, parts overlapping; docs: (id, rid, text), size: bytes of all texts."""
    rows, found, level = docs.select("id", "rid", F.lit(0).cast("long").alias("start"), "text"), None, 0
    while rows is not None:
        buckets = max(1, size // BUCKET)
        packed = rows.mapInArrow(_cut(length, level, buckets), _PACKED)
        sort = _sort(length, limit if level < LEVELS else 1 << 62)
        out = settle(packed.groupBy("bucket").applyInArrow(sort, _GONE))
        part, again = out.where("text is null").drop("text"), out.where("text is not null").select("id", "rid", "start", "text")
        found = part if found is None else found.unionByName(part)
        rows, level = (None if again.isEmpty() else again), level + 1
    return found


def deduplicated(docs: DataFrame, length: int = LENGTH, with_text: bool = False, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_text adds the kept bytes."""
    kind_of_id = docs.schema["doc_id"].dataType
    if not isinstance(kind_of_id, T.IntegralType):
        raise TypeError(f"doc_id must be of an integer type, not {kind_of_id.simpleString()}")
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("rid"), text.alias("text"), F.col("doc_id").isNull().alias("nameless"))
    gone = removed(rows.drop("nameless"), length, size, limit)
    group = F.pmod(F.xxhash64("id", "rid"), F.lit(max(1, size // GROUP_BYTES))).cast("int").alias("grp")

    def finish(key: tuple, t: pa.Table, cuts: pa.Table) -> pa.Table:
        cuts = cuts.sort_by([("id", "ascending"), ("rid", "ascending"), ("start", "ascending")])
        name = np.stack([cuts.column(c).to_numpy() for c in ("id", "rid")], axis=1)
        start, stop = cuts.column("start").to_numpy(), cuts.column("stop").to_numpy()
        edge = np.append(np.flatnonzero(runs([name[:, 0], name[:, 1]])), len(name)) if len(name) else np.zeros(1, np.int64)
        of = {tuple(name[a].tolist()): (a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
        out = []
        for doc, rid, nameless, body in zip(*(t.column(c).to_pylist() for c in ("id", "rid", "nameless", "text")), strict=True):
            raw = body.encode()
            a, b = of.get((doc, rid), (0, 0))
            spans, kept, n_removed = 0, raw, 0
            if b > a:
                far = np.maximum.accumulate(stop[a:b])
                new = np.append(True, start[a + 1 : b] > far[:-1])
                first, last = start[a:b][new], far[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]
                spans, n_removed = len(first), int((last - first).sum())
                kept = b"".join([raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True)])
            out.append((None if nameless else doc, len(raw), n_removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names[: 5 + with_text], columns, kinds, strict=False)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    grouped = rows.select(group, "id", "rid", "nameless", "text").groupBy("grp")
    out = grouped.cogroup(gone.select(group, "id", "rid", "start", "stop").groupBy("grp")).applyInArrow(finish, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind_of_id))


#: The same over strings of two hexadecimal digits a byte, for another engine.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, lower(hex(encode(coalesce(text, '')))) AS bytes FROM documents),
places AS (SELECT rid, id, bytes, unnest(range(0, length(bytes) // 2 - 99)) AS place FROM docs WHERE length(bytes) >= 200),
strings AS (SELECT rid, id, place, substr(bytes, 2 * place + 1, 200) AS s FROM places),
leads AS (SELECT s, min({'id': id, 'place': place}) AS lead FROM strings GROUP BY s HAVING count(*) > 1),
late AS (SELECT rid, place, lag(place) OVER (PARTITION BY rid ORDER BY place) AS before FROM strings JOIN leads USING (s) WHERE id <> lead.id OR place <> lead.place),
numbered AS (SELECT rid, place, sum(CASE WHEN before IS NULL OR place > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY place) AS span FROM late),
spans AS (SELECT rid, span, min(place) AS first, max(place) + 100 AS last FROM numbered GROUP BY rid, span),
cuts AS (SELECT rid, first, last, coalesce(lag(last) OVER (PARTITION BY rid ORDER BY first), 0) AS kept_from FROM spans),
sums AS (SELECT rid, count(*) AS n_spans, sum(last - first)::BIGINT AS n_removed, max(last) AS tail FROM cuts GROUP BY rid),
heads AS (SELECT c.rid, string_agg(substr(d.bytes, 2 * kept_from + 1, 2 * (first - kept_from)), '' ORDER BY first) AS kept FROM cuts c JOIN docs d USING (rid) GROUP BY c.rid)
SELECT d.doc_id, length(d.bytes) // 2 AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN s.rid IS NULL THEN d.bytes ELSE h.kept || substr(d.bytes, 2 * s.tail + 1) END)) AS kept_sha256
FROM docs d LEFT JOIN sums s USING (rid) LEFT JOIN heads h USING (rid)
"""
