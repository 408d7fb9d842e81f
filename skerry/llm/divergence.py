"""Source divergence audit by count-cell ranking.

For each language and source: how far its term distribution lies from each other source of the language (part `pair`) and
which terms it overuses against the whole language (part `term`, ranks to 200). A term's share comes only from its count in
the group and its count in the language, so terms are grouped into cells of equal counts and the divergence f is evaluated
once a cell. Cells of equal f are merged, ranked by cumulative multiplicity, and only those that begin within the wanted
ranks are expanded to terms, in UTF-8 order: what a ranking holds at any time is cells, not terms.

For pairs of sources a cell is the vector of a term's shares in the sources of two blocks, and its multiplicity the number of
terms with that vector. Terms are dealt to buckets by hash and sources to blocks, so a task holds a bounded part of both;
terms that neither block has are added by their number. All arithmetic is exact: shares come from decimals, divisions of
integers are floors, and terms are compared as strings.

Null lang, source and text count as ''. Every row is a document of its own, repeated rows and null ids included. Groups
without terms take part, with value 0 where the language keeps no term. Ties are ranked by the UTF-8 order of the item. Very
long texts are read whole. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import settle
from .text import blocks, utf8

MIN_DOCS, RANKS = 3, 200
#: Bytes of text counted at once; counted terms in a bucket; sources in a block; terms in one dense piece of a bucket.
BLOCK_BYTES, BUCKET, SOURCES, PIECE = 8_000_000, 400_000, 64, 4096
#: Groups and cells that are broadcast at most.
SMALL = 200_000

#: Signs that end a term become spaces, A-Z become a-z; all other bytes stay.
_AS = np.full(256, 32, np.uint8)
_AS[128:] = np.arange(128, 256)
_AS[97:123] = _AS[65:91] = np.arange(97, 123)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of blocks of texts."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        data = _AS[data]
        for i, j in blocks(offsets, BLOCK_BYTES):
            part = np.ascontiguousarray(data[offsets[i] : offsets[j]])
            texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer((offsets[i : j + 1] - offsets[i]).astype(np.int64)), pa.py_buffer(part)])
            lists = pc.ascii_split_whitespace(texts)
            row, found = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            filled = pc.not_equal(found, "")
            row, found = row[filled.to_numpy(zero_copy_only=False)], found.filter(filled).dictionary_encode()
            if not len(found):
                continue
            groups = pa.table({k: batch.column(k)[i:j] for k in ("lang", "source")}).append_column("at", pa.array(np.arange(j - i)))
            seen = groups.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
            of = np.empty(j - i, np.int64)
            of[seen.column("at_list").combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(seen.num_rows), pc.list_value_length(seen.column("at_list").combine_chunks()).to_numpy())
            many = len(found.dictionary)
            in_doc, n = np.unique(row.astype(np.int64) * many + found.indices.to_numpy(), return_counts=True)
            key, place = np.unique(of[in_doc // many] * many + in_doc % many, return_inverse=True)
            where = pa.array(key // many)
            yield pa.RecordBatch.from_arrays(
                [
                    seen.column("lang").take(where).combine_chunks(), seen.column("source").take(where).combine_chunks(), found.dictionary.take(pa.array(key % many)).cast(pa.string()),
                    pa.array(np.bincount(place, n).astype(np.int64)), pa.array(np.bincount(place)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kept)), exact; 0 where nothing is kept."""
    over = F.when(kept > 0, total.cast("decimal(19,0)") + kept)
    return F.coalesce(1 + F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), over), F.lit(0)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def counted(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group that has them (lang, source, term, c, of_lang), and all groups with their totals
    (lang, source, total, lang_total, kept). Both are written tables."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = rows.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    per = terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    kept = per.select("lang", "source", "term", "c", F.sum("c").over(same).alias("of_lang"), F.sum("docs").over(same).alias("docs"), F.row_number().over(same.orderBy("source")).alias("nth"))
    kept = settle(kept.where(F.col("docs") >= min_docs).drop("docs"))
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    langs = kept.where("nth = 1").groupBy("lang").agg(F.sum("of_lang").alias("lang_total"), F.count("*").alias("kept"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(_hinted(langs), "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    return kept.drop("nth"), settle(groups)


def overused(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank of the terms whose share in the group is above the language's."""
    cell = ["lang", "source", "c", "of_lang"]
    p, q = share(F.col("c"), F.col("total"), F.col("kept")), share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    cells = kept.groupBy(*cell).agg(F.count("*").alias("many")).join(_hinted(groups), ["lang", "source"])
    cells = settle(cells.select(*cell, "many", p.alias("p"), q.alias("q")).where("p > q").select(*cell, "many", distance(F.col("p"), F.col("q")).alias("value")))
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    # every value has a term at least, so later values begin beyond the last rank
    values = values.withColumn("_nth", F.row_number().over(by_group)).where(F.col("_nth") <= ranks)
    before = F.coalesce(F.sum("many").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.select("lang", "source", "value", before.alias("before")).where(F.col("before") < ranks)
    open_cells = settle(cells.drop("many").join(values, ["lang", "source", "value"]))
    terms = kept.join(_hinted(open_cells), cell).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term")))
    terms = terms.where(F.col("_nth") <= ranks).withColumn("rank", (F.col("before") + F.col("_nth")).cast("int")).where(F.col("rank") <= ranks)
    return terms.select("lang", "source", F.col("term").alias("item"), "value", "rank")


_PARTIAL = "lang string, source string, item string, value long, n_terms long, rest long, kept long"


def _pair_sums(key: tuple, t: pa.Table) -> pa.Table:
    """Sums of f over the terms of one bucket, for the ordered pairs of two blocks of sources. A row without a term states a
    source and its share of an absent term."""
    one, other = key[2].as_py(), key[3].as_py()
    stated = pc.is_null(t.column("term"))
    sources, rows = t.filter(stated).sort_by("nth"), t.filter(pc.invert(stated))
    nth, absent, block = (sources.column(k).to_numpy() for k in ("nth", "p", "block"))
    terms = rows.column("term").combine_chunks().dictionary_encode()
    code, col, p = terms.indices.to_numpy(), np.searchsorted(nth, rows.column("nth").to_numpy()), rows.column("p").to_numpy()
    order = np.argsort(code, kind="stable")
    code, col, p = code[order], col[order], p[order]
    n, total = len(terms.dictionary), np.zeros((len(nth), len(nth)), np.int64)
    for low in range(0, n, PIECE):
        a, b = np.searchsorted(code, [low, low + PIECE])
        dense = np.repeat(absent[None, :], min(PIECE, n - low), 0)
        dense[code[a:b] - low, col[a:b]] = p[a:b]
        cells, many = np.unique(dense, axis=0, return_counts=True)
        for s in range(len(nth)):
            apart = cells[:, [s]] - cells
            total[s] += many @ (apart * apart // cells)
    s, u = np.nonzero((block[:, None] != block[None, :]) if one != other else ~np.eye(len(nth), dtype=bool))
    name, kept = sources.column("source"), sources.column("kept")
    apart, over = absent[s] - absent[u], np.maximum(absent[u], 1)
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(s), pa.string()), "source": name.take(pa.array(s)), "item": name.take(pa.array(u)), "value": pa.array(total[s, u]),
            "n_terms": pa.array(np.full(len(s), n)), "rest": pa.array(apart * apart // over), "kept": kept.take(pa.array(s)),
        }
    )


def between(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of each ordered pair of sources of a language."""
    buckets = max(1, kept.count() // BUCKET)
    named = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    named = named.withColumn("block", ((F.col("nth") - 1) / SOURCES).cast("int"))
    named = settle(named.withColumn("blocks", F.max("block").over(Window.partitionBy("lang"))))
    absent = named.select("lang", "source", "nth", "block", "blocks", "kept", share(F.lit(0), F.col("total"), F.col("kept")).alias("p"), F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    present = kept.join(_hinted(named), ["lang", "source"]).select(
        "lang", "source", "nth", "block", "blocks", "kept", share(F.col("c"), F.col("total"), F.col("kept")).alias("p"), "term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    )
    rows = absent.unionByName(present).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    rows = rows.select("lang", "bucket", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("other"), "nth", "block", F.when(F.col("term").isNull(), F.col("source")).alias("source"), "kept", "p", "term")
    sums = rows.groupBy("lang", "bucket", "one", "other").applyInArrow(_pair_sums, _PARTIAL).groupBy("lang", "source", "item")
    value = F.sum("value") + (F.max("kept") - F.sum("n_terms")) * F.max("rest")
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return sums.agg(F.when(F.max("kept") > 0, value).otherwise(0).cast("long").alias("value")).select("lang", "source", "item", "value", F.row_number().over(by_group).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank."""
    kept, groups = counted(docs, min_docs)
    parts = [(f(kept, groups, *more), name) for f, name, more in ((between, "pair", ()), (overused, "term", (ranks,)))]
    out = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for df, name in parts]
    return out[0].unionByName(out[1])


#: The same by plain grouping, for another engine.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
lang_terms AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN lang_terms USING (lang, term) GROUP BY w.lang, w.source, w.term),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM lang_terms GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
grid AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (t.n + 1) // (l.total + l.v)::HUGEINT AS q
  FROM groups g JOIN lang_terms t USING (lang) JOIN langs l USING (lang) LEFT JOIN totals s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
