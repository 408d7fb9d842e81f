"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item is cut into one piece more than its error budget. A passage within the budget leaves at least one
piece unharmed, so exact hits of pieces (an Aho-Corasick automaton) find every candidate place; Myers' bit-parallel
distance over a window around the hit then verifies it. Texts and items are compared in lower case with white space
collapsed, so re-wrapped or re-cased copies match too.

Items shorter than `least_chars`, which chance would match within any budget, have a budget of 0 and must stand between
word ends, so they are one piece that is looked up exactly.

The benchmark is written once as normalised items, dealt to blocks of a bounded size by the item's hash, and read from there
block by block. A block is broadcast and is one pass over the documents; its result is written and its broadcast dropped
before the next block is read, so the driver and every task hold one block, however large the benchmark is. A benchmark of
one block stays a lazy pass without a written result.

Null and empty texts and items match nothing. Rows with equal doc_id or item_id count as
one, with the best match, of equal ones the one that ends first. Very long texts are scanned whole. An empty table on
either side gives no matches. Ids are of any type; other columns, whatever their names, are ignored or, in
`clean_documents`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import numbered, settle, shared_dir, with_fields

#: Edits allowed, as a share of the item's length.
ERROR_RATE = 0.08
LEAST_CHARS = 40
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places."""
    n, k = len(item), budget + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of the pattern anywhere in the text within the budget: Myers' algorithm, one word
    of len(pattern) bits a column."""
    n = len(pattern)
    if not n:
        return None
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for at, c in enumerate(text):
        e = equal.get(c, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up, down = minus | ~(h | plus) & full, plus & h
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(v | up) & full, up & v
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[object, str]], error_rate: float, least_chars: int):
        import ahocorasick

        self.items = items
        self.short = [len(t) < least_chars for _, t in items]
        self.budgets = [0 if short else int(len(t) * error_rate) for short, (_, t) in zip(self.short, items, strict=True)]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for at, piece in pieces(text, self.budgets[k]):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Best (edits, end) of each item found in the text."""
        windows: dict[int, list[list[int]]] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, at in where:
                if self.short[k]:
                    before, after = text[end - length : end - length + 1] if end >= length else "", text[end + 1 : end + 2]
                    if not before.isalnum() and not after.isalnum():
                        best.setdefault(k, (0, end + 1))
                    continue
                budget = self.budgets[k]
                start = end + 1 - length - at - budget
                stop = start + len(self.items[k][1]) + 2 * budget
                open_ = windows.setdefault(k, [])
                if open_ and start <= open_[-1][1] and start >= open_[-1][0] - 2 * budget - 1:
                    open_[-1] = [min(start, open_[-1][0]), max(stop, open_[-1][1])]
                else:
                    open_.append([start, stop])
        for k, spans in windows.items():
            for start, stop in spans:
                start = max(0, start)
                m = best_match(self.items[k][1], text[start:stop], self.budgets[k])
                if m and (k not in best or m[0] < best[k][0]):
                    best[k] = (m[0], start + m[1])
        return best


class Blocks:
    """The benchmark's normalised items (item_id, text), in blocks of about `block_bytes`. `shared` gives each as a broadcast;
    a broadcast of several is dropped when the next one is asked for, by when its result must have been written."""

    def __init__(self, benchmark: DataFrame, block_bytes: int):
        items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
        self.spark = benchmark.sparkSession
        size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
        self.n = max(1, -(-size // block_bytes))
        self.items, self.kind = items, items.schema["item_id"].dataType

    def _written(self) -> str:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["item_id", "text"])

        path = shared_dir(self.spark)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)).alias("block")
        every = self.items.mapInArrow(run, self.items.schema).where("text <> ''").select("item_id", "text", block)
        every.repartition("block").write.partitionBy("block").parquet(path)
        return path

    def shared(self) -> Iterator[Broadcast]:
        if self.n == 1:
            rows = sorted({(r["item_id"], t) for r in self.items.collect() if (t := normal(r["text"]))})
            if rows:
                yield self.spark.sparkContext.broadcast(rows)
            return
        schema = T.StructType([self.items.schema["item_id"], self.items.schema["text"], T.StructField("block", T.LongType())])
        every = self.spark.read.schema(schema).parquet(self._written())
        for block in range(self.n):
            rows = sorted({(r["item_id"], r["text"]) for r in every.where(F.col("block") == block).collect()})
            if rows:
                out = self.spark.sparkContext.broadcast(rows)
                yield out
                out.destroy()

    def kept(self, found: DataFrame) -> DataFrame:
        """What one block gave: written when others follow."""
        return found if self.n == 1 else settle(found)


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits and match_end (in the normalised text): one row for each document and item it holds."""
    spark = docs.sparkSession
    schema = with_fields(docs, ["doc_id"], "edits int, match_end long")
    schema = T.StructType([schema[0], benchmark.schema["item_id"], *schema[1:]])
    texts = docs.select("doc_id", "text").where("text is not null")
    out, kind = None, to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = Blocks(benchmark, block_bytes)
    for shared in parts.shared():

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, least_chars)
            for batch in batches:
                ids, hits = batch.column(0).to_pylist(), []
                for i, text in enumerate(batch.column(1)):
                    hits += [(ids[i], matcher.items[k][0], e, at) for k, (e, at) in matcher.find(normal(text.as_py())).items()]
                if hits:
                    a, b, c, d = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, kind), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["doc_id", "item_id", "edits", "match_end"])

        found = parts.kept(texts.mapInArrow(run, schema))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("edits", "match_end")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.edits", "m.match_end")


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose own text holds no benchmark item: a filter without any shuffle. Of several blocks
    each reads what the ones before it left."""
    kept, names = docs, docs.columns
    place = names.index("text")
    parts = Blocks(benchmark, block_bytes)
    for shared in parts.shared():

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, least_chars)
            for batch in batches:
                clean = pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(place)], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.filter(clean).columns, names=names)

        kept = parts.kept(numbered(kept).mapInArrow(run, docs.schema))
    return kept
