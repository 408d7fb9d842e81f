"""Single rows of very many spans, and many rows without an id."""

import re

from skerry.llm import pii, substring

from .test_contracts import base, sha


def test_spans_of_a_row_with_very_many(spark):
    numbers = ", ".join(str(1000 + 7919 * k % 100_003) for k in range(100_000))
    words = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k % 7]}" for k in range(100_000))
    mails = " ".join(f"é\U0001f600 user{k}@mail{k % 7}.org by Name{'abcdefg'[k % 7] * 4}" for k in range(5_000))
    rows = [(1, numbers), (2, words + " one@two.org " + words), (3, mails), (4, "a@b.cd"), (5, "x" * 5000 + " " + mails[:3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, text in rows:
        want = base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()] and got[i].base_sha256 == sha(joined)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[1] == numbers and clean[4] == "<EMAIL>" and clean[3].count("<EMAIL>") == 5_000
    # what sanitising leaves is the text without what any span covers
    spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in got[3].spans.split(",")))
    kept, at = [], 0
    for a, b in spans:
        kept.append(mails[at : max(a, at)])
        at = max(at, b)
    assert re.sub(r"<[A-Z]+>", "", clean[3]) == "".join(kept) + mails[at:]


def test_terms_that_overlap_an_entity_leave_none_of_it(spark):
    rows = [(k, f"{w} says étéuser@mail.org to {w}") for k, w in enumerate(("apples", "pears", "plums", "figs"))]
    rows += [(100 + k, f"plain words of number{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(400)]
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("user" not in clean[k] and "@" not in clean[k] and "<EMAIL>" in clean[k] for k in range(4))


def test_rows_without_an_id_are_spread_and_take_nothing_from_each_other(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(None, f"own{k % 50} {passage} tail{k % 50}") for k in range(200)] + [(None, None)] * 3 + [(None, "")] * 2
    for named in ([], [(5, f"head {passage}"), (7, f"x {passage} y")]):
        df = spark.createDataFrame(rows + named, "doc_id long, text string").repartition(4)
        got = substring.deduplicated(df, group_bytes=500).collect()
        assert len(got) == len(rows) + len(named)
        without = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is None)
        kept = lambda t: t.replace(f" {passage} ", " ") if named else t
        want = sorted((len((t or "").split()), 20 if named and t else 0, sha(kept(t or ""))) for _, t in rows)
        assert without == want
        assert {r.doc_id: r.n_removed for r in got if r.doc_id} == ({5: 0, 7: 20} if named else {})
