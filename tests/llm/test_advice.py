"""Cases of the review that the operators once left out."""

from skerry.llm import html, line_dedup, pii
from skerry.llm.queries import op4_line_dedup


def test_short_repeats_go_and_lines_of_all_kinds_of_ids_are_taken(spark, tmp_path):
    long = " ".join(f"a{k * 7919 % 9973}z" for k in range(1000))
    rows = [("a", f"the first line of some length\nLes.\n\nown text of the first"), ("b", "the first line of some lengths\nLes.\n\n \nown text of the second one"), ("c", long), ("d", long.replace("5z ", "7z ", 2)), ("e", "Les."), (None, "Les.\nx")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(path)
    got = {r.doc_id: r.n_removed for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 2, "c": 0, "d": 1, "e": 1, None: 1}


def test_lines_among_columns_of_any_name(spark):
    rows = [(1, "one and the same line\nx", 7, 8, 9), (2, "one and the same line", 7, 8, 9), (3, "one and the same line\ny", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, n_lines int, `a.b` int")
    assert sorted(map(tuple, line_dedup.without_repeated_lines(docs).collect())) == [rows[0], (3, "y", 7, 8, 9)]
    assert sorted(tuple(r) for r in line_dedup.deduplicated(docs).collect()) == [(1, rows[0][1], 9, 2, 0), (2, "", 9, 1, 1), (3, "y", 9, 2, 1)]


def test_pages_go_by_ratios_and_marks_can_be_void():
    body = [f"Paragraph {k} of the body, which is long, has commas, and says a good deal more than any card does." for k in range(6)]
    cards = "".join(f"<article><h3>Card {k}</h3><p>Teaser.</p></article>" for k in range(3))
    plain = "".join(f"<p>{x}</p>" for x in body)
    got = html.main_text(f"<body><nav>Menu</nav><div class=text>{plain}</div>{cards}</body>").split("\n")
    assert [x for x in got if x.startswith("Paragraph")] == body and "Menu" not in got
    for inner in (plain, f"<main>{plain}</main>"):
        for open_, close in (("<form id=f>", "</form>"), ("<div class='with-sidebar'>", "</div>")):
            assert html.main_text(f"<body>{open_}<div class=menu>a b c</div><div>{inner}</div>{close}<footer>foot</footer></body>") == "\n".join(body)
    assert html.main_text(f"<body><article><p>{body[0]}</p></article><div class=comments>{plain}</div></body>") == body[0]


def test_terms_of_two_contexts_and_of_classes(spark):
    letters = "abcdefghij"
    filler = [(1000 + k, "plain words without any name " * 100) for k in range(300)]
    two = [(k, f"{w} said that Zebedee has the address zed@one.org since {w}") for k, w in enumerate(("apples", "pears"))]
    domain = [(10 + k, f"{w * 5} from Quillworks at {w}@quill.org with {w * 6}") for k, w in enumerate(letters[:4])]
    once = [(20, "nothing but Solitary beside lone@else.org here")]
    rows = filler + two + domain + once
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: {t[int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if kind == "term"} for i, t in rows}
    assert all("Zebedee" in terms[i] for i, _ in two) and all("Quillworks" in terms[i] for i, _ in domain)
    assert not terms[20] & {"Solitary"} and all(not terms[i] for i, _ in filler)
