"""BPE encoding and decoding by reuse of content-defined chunks.

A rolling hash of the last four bytes cuts each text into chunks; the same passage is cut the same way in any document. The
whole words inside a chunk are encoded when the chunk is first seen in a task and reused wherever it comes again. A cut may
fall into a word, so each join of two chunks is repaired: what is left of the word on either side is encoded again in one
piece, between the words before and after. The tokens of these neighbours must come out as they did in their chunks; where
they do not, the window is the whole text, which is exact by itself. Joins are kept for reuse, too.

Words of chunks that were not seen before come from a table of words, and the words that it lacks are encoded many at a
time; the tokenizer's offsets say which tokens belong to which word.

Nulls and empty texts give no tokens and the empty decoded text. Very long texts are processed whole; the tables hold a
fixed number of entries and are emptied when full, which costs time only. A null or repeated doc_id changes nothing; equal
texts give equal results. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import with_fields
from .text import blocks, utf8

#: Mean chunk length in bytes, a power of two.
CHUNK = 256
#: Entries kept of chunks, joins and words in one task.
CHUNKS_KEPT, JOINS_KEPT, WORDS_KEPT = 20_000, 20_000, 240_000

#: Ids joined by a space, and tokens joined by a space.
Tokens = tuple[str, str]
#: Part of a word at the head; part of a word at the end (None if there is no blank in the chunk); tokens between; words.
Chunk = tuple[bytes, bytes | None, Tokens, list[bytes]]


class Encoder:
    """Tokens of texts, with tables of chunks, joins and words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.names, self.numbers = [""] * size, [str(i) for i in range(size)]
        for name, i in vocabulary.items():
            self.names[i] = name
        self.lengths = np.array([len(name.removesuffix("</w>")) for name in self.names], np.int64)
        #: Words met since the table was last half full, and those of the half before.
        self.words: dict[bytes, Tokens] = {}
        self.older: dict[bytes, Tokens] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple[bytes, bytes, bytes], Tokens] = {}
        self.reused = self.seen = 0

    def tokens(self, ids: list[int]) -> Tokens:
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def whole(self, texts: list[bytes]) -> list[Tokens]:
        return [self.tokens(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def of_line(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of words in one line, and how many of them there are up to the end of each word."""
        line = b" ".join(words).decode()
        ids = self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids
        # lengths of tokens and of words in bytes, as the normaliser leaves them, tell where words end; else offsets do
        lengths = [len(w) if w.isascii() else len(normalize("NFC", w.decode()).lower().encode()) for w in words]
        reached, wanted = np.cumsum(self.lengths[ids]), np.cumsum(lengths)
        ends = np.searchsorted(reached, wanted) + 1
        if len(ids) == 0 or reached[-1] != wanted[-1] or (reached[ends - 1] != wanted).any():
            e = self.tokenizer.encode(line, add_special_tokens=False)
            ends = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), np.cumsum([len(w.decode()) + 1 for w in words]))
            ids = e.ids
        return ids, ends.tolist()

    def of_words(self, wanted: Iterable[bytes]) -> dict[bytes, Tokens]:
        """Tokens of different words: known ones from the table, the others encoded together, some hundreds in a line."""
        young, older = self.words, self.older
        found = {w: young.get(w) or older.get(w) for w in wanted}
        missing = [w for w, t in found.items() if t is None]
        fresh: dict[bytes, Tokens] = {}
        for k in range(0, len(missing), 512):
            line = missing[k : k + 512]
            ids, ends = self.of_line(line)
            numbers, names, at = [self.numbers[i] for i in ids], [self.names[i] for i in ids], 0
            for w, end in zip(line, ends, strict=True):
                fresh[w] = " ".join(numbers[at:end]), " ".join(names[at:end])
                at = end
        found.update(fresh)
        if len(young) + len(found) > WORDS_KEPT // 2:  # words that come again move on, the others go with their half
            self.older, self.words = young, {}
        if len(found) <= WORDS_KEPT // 2:
            self.words.update(found)
        return found

    def of_chunks(self, pieces: list[bytes]) -> dict[bytes, Chunk]:
        """The chunks of a block: those met before from the table, the words of the others encoded."""
        found = {p: self.chunks.get(p) for p in pieces}
        self.seen += len(pieces)
        split = {p: parts(p) for p, c in found.items() if c is None}
        self.reused += len(pieces) - len(split)
        words = self.of_words(set().union(*[inner for _, _, inner in split.values()]))
        for p, (head, tail, inner) in split.items():
            pairs = [words[w] for w in inner]
            found[p] = head, tail, (spaced([t[0] for t in pairs]), spaced([t[1] for t in pairs])), inner
        if len(self.chunks) + len(split) > CHUNKS_KEPT:
            self.chunks.clear()
        self.chunks.update({p: found[p] for p in list(split)[:CHUNKS_KEPT]})
        return found

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Tokens]:
        """Tokens of each text of a block."""
        raw, edges = data.tobytes(), np.union1d(cuts(data), offsets[(offsets > 0) & (offsets < len(data))])
        bounds = [0, *edges.tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        chunks = self.of_chunks(pieces)
        first = np.searchsorted(np.array(bounds[:-1]), offsets).tolist()
        texts = [pieced([chunks[p] for p in pieces[a:b]] if end > start else []) for a, b, start, end in zip(first, first[1:], offsets[:-1], offsets[1:], strict=False)]
        needed = {j for text in texts for j in text if len(j) == 3}
        known = {j: self.joins.get(j) for j in needed}
        missing = [j for j, t in known.items() if t is None]
        fresh = self.repaired(missing)
        known.update({j: t for j, t in fresh.items() if t is not None})
        if len(self.joins) + len(fresh) > JOINS_KEPT:
            self.joins.clear()
        self.joins.update({j: t for j, t in list(fresh.items())[:JOINS_KEPT] if t is not None})
        for text, start, end in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            tokens = [known[x] if len(x) == 3 else x for x in text]
            if any(t is None for t in tokens):  # a join on which the narrow window does not agree
                yield self.whole([raw[start:end]])[0]
            else:
                yield spaced([t[0] for t in tokens]), spaced([t[1] for t in tokens])

    def repaired(self, joins: list[tuple[bytes, bytes, bytes]]) -> dict[tuple[bytes, bytes, bytes], Tokens | None]:
        """Tokens of the word in the middle of (word before, word, word after), or None where the neighbours came out different."""
        beside = self.of_words({w for j in joins for w in (j[0], j[2]) if w})
        again = self.whole([b" ".join(filter(None, j)) for j in joins])
        return {j: inside(tokens, beside.get(j[0]), beside.get(j[2])) for j, tokens in zip(joins, again, strict=True)}


def spaced(strings: list[str]) -> str:
    return " ".join(filter(None, strings))


def parts(piece: bytes) -> tuple[bytes, bytes | None, list[bytes]]:
    """What a chunk has of a word at its head and at its end, and its whole words between blanks."""
    inner = piece.split()
    blank_first, blank_last = piece[:1].isspace(), piece[-1:].isspace()
    if len(inner) == 1 and not blank_first and not blank_last:
        return piece, None, []
    head = b"" if blank_first or not inner else inner.pop(0)
    tail = b"" if blank_last or not inner else inner.pop()
    return head, tail, inner


def pieced(chunks: list[Chunk]) -> list[Tokens | tuple[bytes, bytes, bytes]]:
    """A text as tokens of chunks and joins (word before, word, word after) in turn."""
    out: list = []
    carry, before = b"", b""
    for head, tail, tokens, inner in chunks:
        carry += head
        if tail is None:
            continue
        if carry:
            out.append((before, carry, inner[0] if inner else b""))
            before = b""
        if inner:
            out.append(tokens)
            before = inner[-1]
        carry = tail
    if carry:
        out.append((before, carry, b""))
    return out


def inside(tokens: Tokens, left: Tokens | None, right: Tokens | None) -> Tokens | None:
    """What is left of the tokens between those of the left and the right word, or None if they do not begin and end so."""
    out = []
    for own, before, after in zip(tokens, left or ("", ""), right or ("", ""), strict=True):
        padded = f" {own} " if own else " "
        head, tail = f" {before} " if before else " ", f" {after} " if after else " "
        if not padded.startswith(head) or not padded.endswith(tail) or len(padded) + 1 < len(head) + len(tail):
            return None
        out.append(padded[len(head) : len(padded) - len(tail)] if len(padded) >= len(head) + len(tail) else "")
    return out[0], out[1]


def cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the rolling hash of the four bytes up to there asks for a cut."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    h = d[3:] * np.uint32(0x9E3779B1) + d[2:-1] * np.uint32(0x85EBCA77) + d[1:-2] * np.uint32(0xC2B2AE3D) + d[:-3] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32(CHUNK - 1)) == 0) + 3
    return at[(data[at] & 0xC0) != 0x80]  # not inside a character


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", full: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row; with `full` also the ids themselves and the decoded text."""
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), docs[f"`{text_column}`"].alias("text"))
    schema = with_fields(rows, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if full else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, 1 << 19):
                lo, hi = offsets[i], offsets[j]
                rows = list(encoder.texts(data[lo:hi], offsets[i : j + 1] - lo))
                counts = [r[0].count(" ") + 1 if r[0] else 0 for r in rows]
                columns = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), *[pa.array([_sha(r[k]) for r in rows], pa.string()) for k in (0, 1)]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
