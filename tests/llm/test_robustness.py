"""Hard rows for every operator and stage: clashing names, ids of other types, ties, repeated rows, empty tables."""

import corpus_pipeline
import pytest

from skerry.llm import bpe, decontaminate, html, jaccard, line_dedup, mil, pii, quality_rules, sharding, substring
from skerry.llm.frames import shared_dir
from skerry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, and one that needs quoting.
CLASHES = ["score", "n_removed", "n_lines", "sig", "id", "key", "comp", "rid", "grp", "tid", "kind", "own", "bucket", "shard", "slot", "size", "ids", "edits", "a.b"]
LINE = "one line of words that stands in several texts"
TEXTS = [(1, LINE), (1, LINE), (2, f"{LINE}\nand another one of its own"), (3, None), (3, ""), (None, LINE), (4, "x@y.zz " * 40), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 400)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", 9, *range(len(CLASHES))) for i, t in TEXTS], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (5, 0), (4, 0), (2, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, LINE), (7, LINE), (8, None), (9, "p q"), (10, "q s")], "item_id long, text string")


def applied(docs, labels, bench):
    return {
        "pii": pii.digest(docs), "jaccard": jaccard.near_duplicates(docs), "rules": quality_rules.quality_rules(docs), "lines": line_dedup.digest(docs),
        "shards": sharding.shards(docs), "bench": decontaminate.contaminated(docs, bench), "mil": mil.quality_scores(docs, labels), "substring": substring.deduplicated(docs), "bpe": bpe.encoded(docs, tokenizer_path()),
    }


def test_operators_take_clashing_names_ties_and_repeated_rows(docs, labels, bench):
    plain = applied(docs.select("doc_id", "text"), labels, bench)
    for name, df in applied(docs, labels, bench).items():
        got = sorted(map(str, df.drop("slot").collect()))
        assert got == sorted(map(str, plain[name].drop("slot").collect())), name
        assert name == "bench" or len(got) == len(TEXTS)


def test_operators_take_ids_of_other_types(spark, docs, labels, bench):
    named = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text")
    of = {name: df for name, df in applied(docs.select("doc_id", "text"), labels, bench).items() if name in ("pii", "jaccard", "rules", "lines", "bench", "bpe")}
    got = {
        "pii": pii.digest(named), "jaccard": jaccard.near_duplicates(named), "rules": quality_rules.quality_rules(named), "lines": line_dedup.digest(named),
        "bench": decontaminate.contaminated(named, bench.selectExpr("cast(item_id as string) item_id", "text")), "bpe": bpe.encoded(named, tokenizer_path()),
    }
    for name, df in got.items():
        assert sorted(str(tuple(map(str, r))) for r in df.collect()) == sorted(str(tuple(map(str, r))) for r in of[name].collect()), name


def test_stages_keep_all_columns_whatever_their_names(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in kept) and len(kept) <= len(TEXTS)
        assert stage(spark, docs.where("false"), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(TEXTS)


def test_short_items_need_word_ends_and_no_edits(docs, bench):
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7, 0), (2, 7, 0), (None, 7, 0), (5, 9, 0)}


def test_all_passages_of_learnt_texts_are_read(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(64 * 200))
    seen = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels, seed: seen.extend(bags))
    mil.train(spark.createDataFrame([(4, long), (4, long), (5, "z")], "doc_id long, text string"), spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int"), held_out=9)
    assert sorted(len(b) for b in seen) == [1, 200]


def test_empty_tables_of_every_operator(spark, labels, bench):
    none = spark.createDataFrame([], "doc_id long, text string")
    for name, df in applied(none, labels.where("false"), bench.where("false")).items():
        assert df.collect() == [], name
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "x", 5), (1, "u", "<p>a<p>b", "x", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html.main_texts(pages).collect()), key=repr) == sorted([(1, "u", "a\nb", 3), (1, "u", "a\nb", 3), (None, None, "", 0)], key=repr)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
