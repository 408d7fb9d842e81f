"""The pipeline against plain loops over the small scale, stage by stage."""

import re

import corpus_pipeline
import pyarrow as pa
from tokenizers import Tokenizer

from skerry.llm import decontaminate, mil
from skerry.llm.frames import table
from skerry.llm.queries import tokenizer_path
from skerry.llm.text import utf8

from .test_contracts import SF, WORD, classes_of, near, sha


def deduplicated(rows):
    """The text of each row without the lines that repeat an earlier one, or nearly; None for rows that lose all words."""
    groups, out = [], []
    for i, text in sorted(rows):
        kept = []
        for x in text.split("\n"):
            if not WORD.search(x):
                kept.append(x)
                continue
            mine = [g for g in groups if any(abs(len(x) - len(y)) <= 2 and near_lines(x, y) for y in g)]
            merged = [x] + [y for g in mine for y in g]
            groups[:] = [g for g in groups if g not in mine] + [merged]
            if not mine:
                kept.append(x)
        new = "\n".join(kept)
        if new == text or WORD.search(new):
            out.append((i, new))
    return out


def near_lines(x, y):
    if min(len(x), len(y)) < 24:
        return x == y
    limit = 1 if min(len(x), len(y)) < 40 else 2
    third = len(x) // 3
    pieces = (x[:third], x[third : 2 * third], x[2 * third :])
    return x == y or (any(p in y for p in pieces) or limit > 1) and abs(len(x) - len(y)) <= limit and (sum(a != b for a, b in zip(x, y, strict=False)) <= limit or near(x, y, limit) if any(p[:8] in y for p in pieces) else False)


def test_pipeline_equals_the_loops(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    model = mil.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = [(i, t) for i, t in docs if model.score(*mil.passages(*utf8(pa.array([t]))))[0] >= 0.7]
    assert 0 < len(good) < len(docs)
    lines = deduplicated(good)
    first = [(i, t) for (i, t), (_, _, c) in zip(sorted(lines), sorted(classes_of(sorted(lines))), strict=True) if c == i]
    items = [decontaminate.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = [(i, t) for i, t in first if not any(decontaminate.best_match(b, decontaminate.normal(t), int(len(b) * decontaminate.ERROR_RATE)) for b in items)]
    assert len(clean) < len(first)
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, len(e.ids), sha(" ".join(map(str, e.ids)))) for i, x in clean for e in [t.encode(x, add_special_tokens=False)])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns_and_take_hard_rows(spark):
    columns = table(spark, SF, "documents").columns
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "a line that stands in two documents\nb", None, None, 3), (4, "a line that stands in two documents", "en", None, None), (4, "a line that stands in two documents", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_operators_do_not_hide_import_errors():
    for module in (corpus_pipeline, decontaminate, mil):
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", open(module.__file__).read())
