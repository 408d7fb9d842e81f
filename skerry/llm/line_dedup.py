"""Line dedup by a segment-partition edit join.

Lines link if they are equal, or if their edit distance is at most 1 where the shorter has 24 code points or more, at most
2 from 40 on. A line is cut into threshold-plus-one even segments, its rows of the index; a line within the threshold keeps
one of them whole, at a place that its length narrows to a few. The substrings at those places are the probes of a
length-aware index. Candidates that parity bits of their letters and letter pairs do not rule out are verified by banded
bit-parallel edit distance, a whole batch of pairs at a time. Equal lines are one item. Of each class of linked lines the
first stays, by doc_id, then line number; the others go.

Lines without a word always stay. Null and empty texts have one empty line. A null doc_id comes last; ids of any type that
has an order will do. Rows equal in doc_id and text are one document and keep the same lines. Very long lines are read
whole. An empty table gives no rows. Columns of any names go through; a column of docs named n_lines or n_removed is
replaced in `deduplicated` and kept in `without_repeated_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small, columns, numbered, settle, with_fields
from .linking import classes, stars
from .text import U64, blocks, mix, prefix_hash, span_hash, utf8

#: Least code points for a distance of 1 and of 2.
LEAST, LONG = 24, 40


def threshold(length: np.ndarray) -> np.ndarray:
    return (length >= LEAST).astype(np.int64) + (length >= LONG)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block; start, end, row and number of every line in it."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    breaks = np.flatnonzero(points == 10)
    start = np.sort(np.concatenate([heads[:-1], breaks + 1]), kind="stable")
    # one line for each row, one more for each break; a break that ends a row is followed by that row's last, empty line
    row_of_break = np.searchsorted(heads, breaks, "right") - 1
    row = np.sort(np.concatenate([np.arange(len(heads) - 1), row_of_break]), kind="stable")
    first = np.searchsorted(row, np.arange(len(heads) - 1))
    number = np.arange(len(row)) - first[row]
    order = np.lexsort((number, row))
    start = np.concatenate([heads[:-1], breaks + 1])[np.argsort(np.concatenate([np.arange(len(heads) - 1), row_of_break]), kind="stable")]
    end = np.append(start[1:] - 1, heads[-1])
    last = np.append(row[1:] != row[:-1], True)
    end[last] = heads[1:][row[last]]
    return points, start[order], end[order], row, number


def probes(length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, bool]]:
    """For lines of these lengths: (which lines, place, size, segment, length of the indexed line, is a row of the index)."""
    for less in range(3):
        other = length - less
        limit = threshold(other)
        for t in (1, 2):
            chosen = np.flatnonzero((limit == t) & (less <= t))
            if not len(chosen):
                continue
            n, l = length[chosen], other[chosen]
            base, more = l // (t + 1), l % (t + 1)
            for i in range(t + 1):
                # the first t + 1 - more segments have the base length, the rest one more
                short = t + 1 - more
                size = base + (i >= short)
                place = i * base + np.maximum(0, i - short)
                low = np.maximum(0, np.maximum(place - i, place + less - (t - i)))
                high = np.minimum(n - size, np.minimum(place + i, place + less + (t - i)))
                for k in range(-2 * t, 2 * t + 1):
                    at = place + k
                    ok = (at >= low) & (at <= high)
                    if ok.any():
                        yield chosen[ok], at[ok], size[ok], i, l[ok], less == 0 and k == 0


def within(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit.

    Column by column of the shorter string, one machine word for each pair holds the differences down the band around the
    diagonal; all pairs move together."""
    n = len(a)
    a, b = zip(*[(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if n else ((), ())
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    limit = limit.astype(np.int64)
    out = np.zeros(n, bool)
    order = np.argsort(lb, kind="stable")
    i = 0
    while i < n:
        j = i + 1
        while j < n and (j - i + 1) * (la[order[i : j + 1]].max() + 8) < 2_000_000 and j - i < 4096:
            j += 1
        part = order[i:j]
        out[part] = _band([a[k] for k in part], [b[k] for k in part], la[part], lb[part], limit[part])
        i = j
    return out


def _band(a: list[np.ndarray], b: list[np.ndarray], la: np.ndarray, lb: np.ndarray, limit: np.ndarray) -> np.ndarray:
    n, widest = len(a), int(limit.max())
    pad = widest
    # row r of a is at column r + pad; the padding equals nothing
    A = np.full((int(la.max()) + 2 * pad + 1, n), 0xFFFFFFFF, np.uint32)
    B = np.full((int(lb.max()), n), 0xFFFFFFFE, np.uint32)
    for k in range(n):
        A[pad : pad + la[k], k] = a[k]
        B[: lb[k], k] = b[k]
    one = U64(1)
    plus = U64(0xFFFFFFFFFFFFFFFF) << (U64(63) - limit.astype(U64))
    minus = np.zeros(n, U64)
    distance = limit.copy()
    column = np.arange(n)
    top, below = U64(63), U64(62)
    for c in range(int(lb.max()) if n else 0):
        live = c < lb
        equal = np.zeros(n, U64)
        for t in range(2 * widest + 1):
            r = c + limit - t + pad
            hit = (t <= 2 * limit) & (r >= 0) & (A[np.clip(r, 0, len(A) - 1), column] == B[c])
            equal |= hit.astype(U64) << U64(63 - t)
        d = (((equal & plus) + plus) ^ plus) | equal | minus
        h_plus, h_minus = minus | ~(d | plus), d & plus
        diagonal = c < la - limit
        # beyond the last row the band's end climbs one bit a column
        step = np.clip(c - (la - limit), 0, 62).astype(U64)
        bit = below - step
        change = np.where(diagonal, 1 - ((d >> top) & one).astype(np.int64), ((h_plus >> bit) & one).astype(np.int64) - ((h_minus >> bit) & one).astype(np.int64))
        distance += np.where(live, change, 0)
        plus, minus = np.where(live, h_minus | ~((d >> one) | h_plus), plus), np.where(live, (d >> one) & h_plus, minus)
    return (distance <= limit) & (la - lb <= limit)


def _blocks(batch: pa.RecordBatch, place: int) -> Iterator[tuple]:
    data, offsets = utf8(batch.column(place))
    for i, j in blocks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        points, start, end, row, number = lines_of(data[offsets[i] : offsets[j]], at)
        total, down = prefix_hash(mix(points.astype(U64) + U64(1)))
        yield i, points, start, end, row, number, total, down, span_hash(total, down, start, end)


def line_keys(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, line_no, key) of the lines that hold a word; rows: (rid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, points, start, end, row, number, _, _, key in _blocks(batch, 2):
                dark = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
                keep = np.flatnonzero(dark[end] > dark[start])
                which = pa.array(row[keep] + i)
                own = [batch.column(0).take(which), batch.column(1).take(which)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(number[keep].astype(np.int32)), pa.array(key[keep].view(np.int64))], names=["rid", "doc_id", "line_no", "key"])

    return rows.select("rid", "doc_id", "text").mapInArrow(run, with_fields(rows, ["rid", "doc_id"], "line_no int, key long"))


def probe_rows(rows: DataFrame, index_only: bool) -> DataFrame:
    """(sig, id, own): index rows (own), or all probes, of the different lines of each block; id is the line's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, start, end, _, _, total, down, key in _blocks(batch, 0):
                long = np.flatnonzero(end - start >= LEAST)
                _, once = np.unique(key[long], return_index=True)
                long = long[once]
                sigs, ids, owns = [], [], []
                for which, at, size, i, l, own in probes((end - start)[long]):
                    if own or not index_only:
                        head = start[long[which]] + at
                        sigs.append(mix(span_hash(total, down, head, head + size) ^ mix(l.astype(U64) * U64(8) + U64(i))))
                        ids.append(key[long[which]])
                        owns.append(np.full(len(at), own))
                if sigs:
                    sig, id_ = (pa.array(np.concatenate(x).view(np.int64)) for x in (sigs, ids))
                    yield pa.RecordBatch.from_arrays([sig, id_, pa.array(np.concatenate(owns))], names=["sig", "id", "own"])

    return rows.select("text").mapInArrow(run, "sig long, id long, own boolean")


def line_texts(rows: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted lines, each taken from the first place where it stands; wanted: (id)."""
    place = lines.withColumnRenamed("key", "id").join(wanted, "id").groupBy("id").agg(F.min("rid").alias("rid"), F.min_by("line_no", "rid").alias("line_no"))
    picks = settle(place.groupBy("rid").agg(F.collect_list(F.struct("line_no", "id")).alias("picks")))
    once = rows.select("rid", "text").join(broadcast_if_small(picks, 200_000), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for text, picked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = text.split("\n")
                for p in picked:
                    ids.append(p["id"])
                    texts.append(parts[p["line_no"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    found = once.select("text", "picks").mapInArrow(run, "id long, text string")
    return settle(found.groupBy("id").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of line keys that link; texts: (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = utf8(batch.column(2))[1] + utf8(batch.column(3))[1]
            for i, j in blocks(offsets, 1 << 19):
                part = batch.slice(i, j - i)
                a, b = ([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in part.column(c).to_pylist()] for c in (2, 3))
                limit = threshold(np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64))
                yield part.filter(pa.array(within(a, b, limit))).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


#: 64-bit words of the parity bits of a line: one for its letters, the others for pairs of neighbouring letters.
PARITY = 4


def parity(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each line 64 * PARITY bits: bit i of the first word tells whether an odd number of its letters hash to i, the
    other words tell the same of pairs of neighbours. An edit changes one letter and two pairs of either line, so lines
    within k edits differ in at most 2 * k bits of the first word and 4 * k of the others."""
    size = 64 * PARITY
    out = np.zeros((len(start), size), np.uint8)
    letter = mix(points.astype(U64) + U64(1))
    pair = mix(letter[:-1] ^ (letter[1:] * U64(0x9E3779B97F4A7C15))) if len(points) > 1 else letter[:0]
    for k, (place, shorter) in enumerate((((letter % U64(64)).astype(np.int64), 0), ((pair % U64(size - 64)).astype(np.int64) + 64, 1))):
        n = np.maximum(0, end - start - shorter)
        line = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        counts = np.bincount(line * size + place[at], minlength=len(n) * size).reshape(len(n), size)
        out |= (counts & 1).astype(np.uint8)
    return np.packbits(out, axis=1).view(np.int64)


def line_marks(texts: DataFrame) -> DataFrame:
    """(id, mark): length and parity bits of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, 1 << 17):
                points = np.frombuffer(data[offsets[i] : offsets[j]].tobytes().decode().encode("utf-32-le"), np.uint32)
                heads = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[j]] & 0xC0) != 0x80)])[offsets[i : j + 1] - offsets[i]]
                bits = parity(points, heads[:-1], heads[1:])
                words = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITY)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(heads)), *words], names=["id", "n", *[f"w{k}" for k in range(PARITY)]])

    marks = texts.select("id", "text").mapInArrow(run, "id long, n long" + "".join(f", w{k} long" for k in range(PARITY)))
    return marks.select("id", F.struct("n", *[f"w{k}" for k in range(PARITY)]).alias("mark"))


def possible(a: str, b: str) -> Column:
    """Whether the marks of two lines leave room for a link."""
    A, B = F.col(a), F.col(b)
    limit = F.when(F.least(A["n"], B["n"]) < LONG, 1).otherwise(2)
    differ = [F.bit_count(A[f"w{k}"].bitwiseXOR(B[f"w{k}"])) for k in range(PARITY)]
    return (F.abs(A["n"] - B["n"]) <= limit) & (differ[0] <= 2 * limit) & (sum(differ[1:], F.lit(0)) <= 4 * limit)


def line_classes(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, comp) of the lines that link with another text."""
    index = probe_rows(rows, True).groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # a bucket has one row in the index, however many lines fall into it, so its table is built and the probes stream past
    members = settle(probe_rows(rows, False).join(index.hint("shuffle_hash"), "sig").where("lo < hi or id <> lo"))
    tests = settle(stars(members, ["lo", "hi"]))
    # where one line has the segment in the index, all pairs of its bucket are tests already
    open_ = settle(members.where("lo < hi").select("sig", "id", "own").distinct())
    wanted = tests.select(F.explode(F.array("a", "b")).alias("id")).union(open_.select("id")).distinct()
    texts = line_texts(rows, lines, broadcast_if_small(settle(wanted)))
    return classes(tests, open_, lambda pairs: verified(pairs, texts), settle(line_marks(texts)), possible).withColumnRenamed("id", "key")


def removed_lines(rows: DataFrame) -> DataFrame:
    """(rid, gone): the numbers of the lines of each row that go; rows: (rid, doc_id, text)."""
    lines = settle(line_keys(rows))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid", "line_no")
    # a line that many documents hold is one row here, so what follows by class is dealt evenly
    each = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(line_classes(rows, lines), "key", "left")
    each = settle(each.withColumn("comp", F.coalesce("comp", "key")))
    first = each.groupBy("comp").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("comp", "first")
    heads = settle(each.select("key", "comp").join(broadcast_if_small(settle(first), 300_000), "comp").select("key", "first"))
    gone = lines.join(broadcast_if_small(heads, 300_000), "key").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("rid").agg(F.collect_set("line_no").alias("gone"))


def _deduplicated(docs: DataFrame, but: tuple[str, ...], n_lines: str, n_removed: str) -> DataFrame:
    rid = F.xxhash64("doc_id", "text")
    rows = docs.select(rid.alias("rid"), "doc_id", "text")
    names = [c for c in docs.columns if c not in but]
    gone = removed_lines(rows).withColumnsRenamed({"rid": "_skerry_rid", "gone": "_skerry_gone"})
    joined = docs.select(*columns(docs, but), rid.alias("_skerry_rid")).join(gone, "_skerry_rid", "left").drop("_skerry_rid")
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, gone in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                removed.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    text = "\n".join([x for k, x in enumerate(parts) if k not in out])
                texts.append(text)
            out = batch.columns[:-1]
            out[place] = pa.array(texts, out[place].type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_lines, n_removed])

    return numbered(joined).mapInArrow(run, with_fields(docs, names, f"{n_lines} long, {n_removed} long"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without the lines that go, and n_lines and n_removed."""
    return _deduplicated(docs, ("n_lines", "n_removed"), "n_lines", "n_removed")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every row."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs with repeated lines taken out; documents that had text and keep no word of it go. Where there
    is a column n_chars it follows the text."""
    out = _deduplicated(docs, (), "_skerry_lines", "_skerry_removed").where(r"_skerry_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("_skerry_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns(out, ("_skerry_lines", "_skerry_removed")))
