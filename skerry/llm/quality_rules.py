"""Quality rules: base counts and compression bands.

zstandard ratios (compressed bytes / bytes) of the whole text and of its chunks of a fixed size (the last one as long as it
is) are held against bands that depend on the length: long texts compress better than short ones. Below its band a text
repeats itself, above it it is noise. The bands come from the corpus: for each class of lengths (a quarter of a power of
two) the median of the ratios of texts that pass the base rule, to either side of it `spread` times the way from there to
the ninth decile, a share `least` of the median at least. Quantiles are read from counts of ratios in thousandths, so they
are exact to that and do not depend on the order of rows. A length with fewer than `enough` texts has a band about a fixed
ratio of prose instead, of the share `wide`. Chunks are judged by the band of their own length; a text fails if its whole
ratio is outside, or if chunks outside hold more than `chunk_share` of its bytes.

Null and empty texts count no words and fail the base rule. Very long texts are read whole, and a text of any length is
judged. Equal texts have equal verdicts, whatever the order of rows, a null doc_id or other columns; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle, with_fields
from .text import U64, blocks, covered, mix, utf8, windows, words

#: Least bytes of each class of lengths.
EDGES = np.unique(np.ceil(2 ** (np.arange(0, 4 * 40) / 4)).astype(np.int64))


@dataclass(frozen=True)
class Bands:
    level: int = 3
    chunk_bytes: int = 4096
    chunk_share: float = 0.34
    spread: float = 3.5
    least: float = 0.1
    enough: int = 50
    wide: float = 0.4
    #: Ratios of prose from a length in bytes on.
    prose: tuple[tuple[int, float], ...] = (
        (1, 3.0), (8, 2.0), (16, 1.4), (32, 1.2), (64, 0.95), (128, 0.71), (256, 0.63), (512, 0.57), (1024, 0.51), (2048, 0.48), (4096, 0.45), (8192, 0.43), (32768, 0.4)
    )

    def fixed(self, length: int) -> tuple[float, float]:
        middle = next(r for n, r in reversed(self.prose) if length >= n)
        return middle * (1 - self.wide), middle * (1 + self.wide)

    def measured(self, counts: dict[int, int]) -> tuple[float, float]:
        """The band of a class; counts: how many texts have a ratio of k thousandths."""
        total, seen, at = sum(counts.values()), 0, []
        for k in sorted(counts):
            seen += counts[k]
            while len(at) < 2 and seen >= (0.5, 0.9)[len(at)] * total:
                at.append((k + 0.5) / 1000)
        half = max(self.spread * (at[1] - at[0]), self.least * at[0])
        return at[0] - half, at[0] + half


def class_of(length: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.searchsorted(EDGES, length, "right") - 1)


_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each row: words, their code points, symbols, and words inside windows that come twice or more."""
    n = len(offsets) - 1
    w = words(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(points[w.end] - points[w.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    at, h = windows(w, window)
    key = mix(h ^ mix(w.row[at].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = np.concatenate([[0], np.cumsum(covered(at[twice], window, len(w.hash)))])
    return {
        "n_words": w.count,
        "word_chars": in_words[w.first[1:]] - in_words[w.first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]],
        "rows": n,
    }


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
PIECE = "struct<class:int,bytes:int,ratio:double>"


def measured(docs: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, the base counts and verdict, the whole text as a piece (null where it is empty) and its chunks (none where
    there is only one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        piece = lambda text: {"class": int(class_of(len(text))), "bytes": len(text), "ratio": len(compress(text)) / len(text)}
        of_piece = pa.struct([("class", pa.int32()), ("bytes", pa.int32()), ("ratio", pa.float64())])
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                lo = offsets[i]
                block, at = data[lo : offsets[j]], offsets[i : j + 1] - lo
                counts = base_counts(block, at)
                raw = block.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                size = bands.chunk_bytes
                chunks = [[piece(t[k : k + size]) for k in range(0, len(t), size)] if len(t) > size else [] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        *[pa.array(counts[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols")],
                        pa.array([duplicate_lines(t) for t in texts], pa.int64()),
                        pa.array(counts["n_repeat_words"].astype(np.int64)),
                        pa.array(failed),
                        pa.array([piece(t) if t else None for t in texts], of_piece),
                        pa.array(chunks, pa.list_(of_piece)),
                    ],
                    names=["doc_id", *[x.split()[0] for x in BASE.split(", ")], "whole", "chunks"],
                )

    schema = with_fields(docs, ["doc_id"], f"{BASE}, whole {PIECE}, chunks array<{PIECE}>")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def band_table(pieces: DataFrame, bands: Bands) -> list[tuple[float, float]]:
    """Least and largest ratio of each class of lengths."""
    counts = pieces.where("not base_failed").groupBy(F.col("whole.class").alias("class"), F.floor(F.col("whole.ratio") * 1000).alias("k")).agg(F.count("*").alias("n"))
    # one row for each class and thousandth, a few thousand at any size of the corpus
    by_class: dict[int, dict[int, int]] = {}
    for r in counts.collect():
        by_class.setdefault(r["class"], {})[r["k"]] = r["n"]
    return [bands.measured(by_class[c]) if sum(by_class.get(c, {}).values()) >= bands.enough else bands.fixed(int(EDGES[c])) for c in range(len(EDGES))]


def quality_rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Counts and verdict of every row."""
    bands = bands or Bands()
    pieces = settle(measured(docs, bands))
    limits = band_table(pieces, bands)
    low, high = (F.array(*[F.lit(float(x[k])) for x in limits]) for k in (0, 1))

    def outside(p: Column) -> Column:
        return ~p["ratio"].between(F.get(low, p["class"]), F.get(high, p["class"]))

    bad = F.aggregate(F.filter("chunks", outside), F.lit(0).cast("long"), lambda a, p: a + p["bytes"])
    share = F.when(F.size("chunks") > 0, bad / F.col("whole.bytes")).otherwise(0.0)
    rows = pieces.withColumn("chunk_share", share)
    inside = F.coalesce(~outside(F.col("whole")), F.lit(False)) & (F.col("chunk_share") <= bands.chunk_share)
    names = [x.split()[0] for x in BASE.split(", ")]
    return rows.select("doc_id", *names, F.col("whole.ratio").alias("ratio"), "chunk_share", (~F.col("base_failed") & inside).alias("kept"))
