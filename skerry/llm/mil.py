"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded from its surface (letter case, symbols, digits,
repetition, line breaks, word lengths) and a hashed word histogram; a gated attention learnt from document labels weighs
the passages, and a logistic layer scores the weighted sum.

The weights are fitted on a bounded sample: the `sample` labelled documents with the smallest hash of doc_id, with every
passage of their texts, as far as `sample_bytes` bytes of text in all allow (see `train`). Scoring reads every passage of
every text.

Null and empty texts have one empty passage and get a score like any other. Labels that are null are left out; a doc_id
labelled more than once takes its mean label, and of several texts under one labelled doc_id the one with the smallest
hash is learnt. Without labels of both kinds every score is the share of ones (1 if there are no labels). Repeated rows get
equal scores; no column but the text enters a score. A null doc_id is scored and never learnt. Other columns, whatever
their names, are ignored, or kept by `accepted`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import body, numbered, with_fields
from .text import U64, blocks, mix, utf8, words

PASSAGE_WORDS = 64
BUCKETS = 32
SURFACE = 16
#: Bytes of text that the driver fits on at most; their passages take up to one and a half times as much.
SAMPLE_BYTES = 128_000_000
#: One class for each byte: 0 upper case, 1 lower case, 2 digits, 3 symbols, 4 shouts, 5 stops, 6 other marks, 7 line breaks, 8 beyond ASCII, 9 blanks, 10 the rest.
CLASSES = 11
_CLASS = np.full(256, 10, np.int64)
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}=_/\\@+-~^`", b"\n", range(128, 256), b"\t ")):
    _CLASS[list(_members)] = _k


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the first passage of each row (with the end); an empty row has one passage of zeros."""
    w = words(data, offsets)
    per_row = np.maximum(1, -(-w.count // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_row)])
    total = int(first[-1])
    of_word = first[w.row] + (np.arange(len(w.hash)) - w.first[w.row]) // PASSAGE_WORDS
    out = np.zeros((total, SURFACE + BUCKETS), np.float32)
    n = np.bincount(of_word, minlength=total).astype(np.float32)
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    filled = of_word[opens] if len(of_word) else np.zeros(0, np.int64)
    if len(filled):
        begin = w.start[opens]
        ends = w.end[np.append(opens[1:] - 1, len(of_word) - 1)]
        last_of_row = np.append(w.row[opens][1:] != w.row[opens][:-1], True)
        stop = np.where(last_of_row, ends, np.append(begin[1:], 0))
        size = stop - begin
        # the bytes between passages (white space around texts) go to a class of their own
        which = np.full(len(data), total, np.int64)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begin] += 1
        inside[stop] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        which[inside] = np.repeat(filled, size)
        counts = np.bincount(which * CLASSES + _CLASS[data], minlength=(total + 1) * CLASSES).reshape(total + 1, CLASSES)[:total]
        out[filled, :10] = counts[filled, :10] / np.maximum(1, size)[:, None]
        words_in = n[filled]
        length = (w.end - w.start).astype(np.float32)
        out[filled, 10] = np.add.reduceat(length, opens) / words_in / 10
        out[filled, 11] = np.add.reduceat((length == 1).astype(np.float32), opens) / words_in
        same = np.zeros(len(w.hash), np.float32)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
        out[filled, 12] = np.add.reduceat(same, opens) / words_in
        # how often a word comes again in its passage: neighbours that are equal once (passage, word) is sorted
        key = np.sort((of_word.astype(U64) << U64(40)) | (w.hash >> U64(24)))
        repeats = np.bincount((key[1:][key[1:] == key[:-1]] >> U64(40)).astype(np.int64), minlength=total)
        out[filled, 13] = repeats[filled] / words_in
        out[filled, 14] = words_in / PASSAGE_WORDS
        out[filled, 15] = np.add.reduceat((_CLASS[data[w.start]] == 0).astype(np.float32), opens) / words_in
        bucket = (mix(w.hash) % U64(BUCKETS)).astype(np.int64)
        out[:, SURFACE:] = np.bincount(of_word * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.maximum(n, 1)[:, None]
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features + 1 -> hidden
    gate_a: np.ndarray  # hidden -> attention, tanh branch
    gate_b: np.ndarray  # hidden -> attention, sigmoid branch
    attend: np.ndarray
    out: np.ndarray  # hidden + 1
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Everything from passages to scores; first[i]:first[i + 1] are the passages of bag i."""
        x = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1), np.float32)], 1)
        h = np.tanh(x @ self.encode)
        a, b = np.tanh(h @ self.gate_a), 1 / (1 + np.exp(-(h @ self.gate_b)))
        e = (a * b) @ self.attend
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.out[:-1] + self.out[-1], -30, 30)))
        return {"x": x, "h": h, "a": a, "b": b, "bag": bag, "weight": weight, "z": z, "score": score}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward(x, first)["score"].astype(np.float64)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 40, batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the mean log loss of the bags."""
    ones = float(labels.mean()) if len(labels) else 1.0
    if ones in (0.0, 1.0):
        return Model(*[np.zeros(0)] * 7, constant=ones)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    f = every.shape[1] + 1
    model = Model(
        mean, scale, rng.normal(0, f**-0.5, (f, hidden)).astype(np.float32), rng.normal(0, hidden**-0.5, (hidden, attention)).astype(np.float32),
        rng.normal(0, hidden**-0.5, (hidden, attention)).astype(np.float32), rng.normal(0, 0.1, attention).astype(np.float32), np.append(np.zeros(hidden), np.log(ones / (1 - ones))).astype(np.float32),
    )
    names = ("encode", "gate_a", "gate_b", "attend", "out")
    moment = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in chosen])])
            s = model.forward(np.concatenate([bags[k] for k in chosen]), first)
            d = ((s["score"] - labels[chosen]) / len(chosen)).astype(np.float32)
            grads = {"out": np.append(d @ s["z"], d.sum())}
            dz = d[:, None] * model.out[:-1]
            along = (s["h"] * dz[s["bag"]]).sum(1)
            centre = np.add.reduceat(along * s["weight"], first[:-1])
            de = s["weight"] * (along - centre[s["bag"]])
            grads["attend"] = (s["a"] * s["b"]).T @ de
            dab = de[:, None] * model.attend
            da, db = dab * s["b"] * (1 - s["a"] ** 2), dab * s["a"] * s["b"] * (1 - s["b"])
            grads["gate_a"], grads["gate_b"] = s["h"].T @ da, s["h"].T @ db
            dh = s["weight"][:, None] * dz[s["bag"]] + da @ model.gate_a.T + db @ model.gate_b.T
            grads["encode"] = s["x"].T @ (dh * (1 - s["h"] ** 2))
            step += 1
            for k in names:
                value, (m, v) = getattr(model, k), moment[k]
                g = grads[k] + decay * value
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
    return model


def crc_part(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, held_out: int = 2, seed: int = 7, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `sample` labelled texts whose crc32(doc_id) mod 4 is not `held_out`, those with the smallest hash of
    doc_id. Should they have more than `sample_bytes` bytes in all, texts above a sixteenth of that are left out, then those
    with the largest hashes until the rest fits: whole texts, none is cut."""
    known = labels.where((crc_part() != held_out) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(sample)
    texts = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows are broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    texts = texts.groupBy("doc_id").agg(F.first("y").alias("y"), one)
    if (texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0) > sample_bytes:
        sizes = texts.select("doc_id", F.octet_length("text").alias("size")).where(F.col("size") <= sample_bytes / 16)  # `sample` rows at most
        upto = F.sum("size").over(Window.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id"))
        within = sizes.select("doc_id", upto.alias("upto")).where(F.col("upto") <= sample_bytes).select("doc_id")
        texts = texts.join(F.broadcast(within), "doc_id", "left_semi")
    texts = texts.select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                x, first = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(bags, pa.binary())], names=["y", "bag"])

    rows = texts.mapInArrow(run, "y double, bag binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, SURFACE + BUCKETS) for r in rows]
    return fit(bags, np.array([float(r["y"] >= 0.5) for r in rows]), seed=seed)


def scored(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], body().alias("_skerry_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            scores = [shared.value.score(*passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in blocks(offsets, 1 << 19)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keep, name])

    return numbered(rows).mapInArrow(run, with_fields(docs, keep, f"{name} double"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, **options) -> DataFrame:
    """The contract's row."""
    model = train(docs, labels, held_out=held_out, **options)
    part = F.coalesce(crc_part() == held_out, F.lit(False))
    return scored(docs, model).select("doc_id", part.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows, all columns, that the classifier accepts."""
    model = train(docs, labels, **options)
    out = scored(docs, model, docs.columns, "_skerry_score")
    return out.where(F.col("_skerry_score") >= threshold).drop("_skerry_score")
