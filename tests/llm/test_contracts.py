"""The numbered operators against brute force on whole tables of the small scale, and on hard rows."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from skerry.llm import bpe, decontaminate, html, jaccard, line_dedup, mil, pii, quality_rules, sharding, substring
from skerry.llm.frames import table
from skerry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
#: Null and empty texts, white space only, very long, equal rows, ties, a null id, no word break, characters beyond ASCII.
HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\r\n "), (4, LONG), (5, LONG + " end"), (6, "one two"), (7, "ONE two"), (8, "one two three four five"), (8, "one two three four five"), (None, "one two three four five"), (None, None),
    (9, "x" * 50_000), (10, "漢字 été \U0001f600 é \x1c   z"), (11, f"head of a {PASSAGE} and a tail"), (12, f"another start {PASSAGE} other words"), (13, "same line that is long enough here\nshort\nsame line that is long enough here"), (14, "same line that is long enough hexe\nown words in another long line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    return sorted(rows)


@pytest.fixture(scope="module")
def hard(spark):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in HARD], "doc_id long, text string, id int, sig string, grp int, _rid int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def both(spark, docs, hard):
    return [(table(spark, SF, "documents"), docs), (hard, HARD)]


# --- 1


def luhn(d):
    return sum(n if k % 2 == 0 else n * 2 - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    found = {
        "email": re.finditer(r"(?:(?<![A-Za-z0-9._%+-])|(?<=[A-Za-z0-9-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if len(text) > 9000 else re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": (m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))),
        "card": (m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)),
        "phone": (m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in v] for k, v in found.items()}


TRICKY = ["a@b.c@d.e x@y.zz-q._u@v.w a.b@c.d_x@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.003.4 1.2.3", "4111 1111 1111 1111-5500 0000 0000 0004", "4111111111111111 5 6-7", "+1 (017) 555-7713 +44((((( +1234567890123456 ++49 30 123456", "é\U0001f600 a@b.c \U0001f600 +49 30 1234567 192.168.0.1", "1" * 3000, "1 " * 6000]


def test_personal_data_spans(spark, docs, hard):
    tricky = [(k, t) for k, t in enumerate(TRICKY)]
    for df, rows in [(table(spark, SF, "documents"), docs), (hard.where("doc_id is not null").dropDuplicates(["doc_id"]), dict(r for r in HARD if r[0]).items()), (spark.createDataFrame(tricky, "doc_id long, text string"), tricky)]:
        got = {r.doc_id: r for r in pii.digest(df).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            want = base(text or "")
            assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()], (i, (text or "")[:60])
            joined = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
            assert got[i].base_sha256 == sha(joined) and got[i].spans.startswith(joined)


def test_terms_that_only_stand_beside_an_entity_are_spans(spark):
    filler = [(100 + k, f"plain words of document number{chr(97 + k % 26)}{chr(97 + k // 26)} about nothing") for k in range(400)]
    telling = [(k, f"{w} wrote: Zebedee uses the address zed@mail.org for {w}") for k, w in enumerate(("apples", "pears", "plums", "figs"))]
    df = spark.createDataFrame(filler + telling, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert all("Zebedee" in [telling[k][1][int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[k].spans.split(",")) if kind == "term"] for k in range(4))
    assert all(got[i].n_terms == 0 for i, _ in filler)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Zebedee" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == dict(filler)[100]


def test_personal_data_runs_no_python(spark):
    plan = pii.digest(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 2


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def classes_of(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for k, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if i is not None or least.get(find(k)) is not None else None
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, docs, hard):
    for df, rows in both(spark, docs, hard):
        assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr) == classes_of(rows)


def test_near_duplicates_among_rows_of_one_id_or_none(spark):
    words = [f"w{k}" for k in range(80)]
    a, b, c = " ".join(words), " ".join(words[:-1] + ["x"]), "quite another text that links with nothing here"
    rows = [(5, c), (5, a), (5, a), (None, b), (3, b + " y"), (None, c), (9, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == classes_of(rows)


def sets_about_the_limit(sizes, each=6):
    """Texts of sets of these sizes and variants with similarities about 80 %, all with words from one common pool."""
    import random

    rnd, rows = random.Random(3), []
    for size in sizes:
        for _ in range(each):
            words = [f"v{rnd.randrange(4000)}" for _ in range(size + 4)]
            rows.append(" ".join(words))
            for _ in range(3):
                other = list(words)
                # an edit at the end of a text or of a stretch costs few shingles, one in the middle five
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    other[rnd.randrange(len(other))] = f"u{rnd.randrange(99)}"
                rows.append(" ".join(other[: len(other) - rnd.randint(0, max(1, size // 12))]))
    return list(enumerate(rows))


def test_no_link_is_lost_at_any_size(spark):
    rows = sets_about_the_limit([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 50]) + [(10_000 + i, t) for i, t in sets_about_the_limit([128, 300, 1000, 5000], 3)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = classes_of(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert 0 < sum(i == c for i, _, c in want) < len(want)


def test_linked_sets_share_a_list_or_a_subset_in_any_order_of_elements():
    import random

    import numpy as np

    rnd, n = random.Random(3), 0
    for _ in range(400):
        size = rnd.choice([1, 2, 5, 8, 9, 10, 12, 20, 40, 100, 300, 1500])
        a = np.array(sorted(rnd.sample(range(1, 1 << 62), size)), np.uint64)
        drop = rnd.randint(0, max(1, size // 8))
        b = np.union1d(np.array(sorted(rnd.sample(list(a), size - drop)), np.uint64), np.array(rnd.sample(range(1 << 41, 1 << 42), rnd.randint(0, max(1, size // 9))), np.uint64))
        if jaccard.linked(a, b):
            n += 1
            both = np.sort(jaccard._slots(np.intersect1d(a, b), 7))
            row, h, _, _ = jaccard.in_order([a, b], both, np.array([rnd.randrange(1, 200) for _ in both], np.uint8), 7)
            assert set(h[row == 0].tolist()) & set(h[row == 1].tolist())
            if max(len(a), len(b)) <= jaccard.LIGHT:
                common = [np.intersect1d(x, np.intersect1d(a, b)) for x in (a, b)]
                assert set(jaccard.subsets(common[0], len(a)).tolist()) & set(jaccard.subsets(common[1], len(b)).tolist())
            differ = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(jaccard.parity(a).view(np.uint64), jaccard.parity(b).view(np.uint64), strict=True))
            assert differ <= len(np.setxor1d(a, b))
    assert n > 150


# --- 3


def test_quality_counts(spark, docs, hard):
    for df, rows in both(spark, docs, hard):
        got = sorted((tuple(r)[:7] for r in quality_rules.quality_rules(df).collect()), key=repr)
        want = []
        for i, text in rows:
            text = text or ""
            w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
            counts = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            again = {j for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
            want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
        assert got == sorted(want, key=repr)


def junk_and_prose():
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "in", "ou", "st"]) for _ in range(rnd.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    letters = [chr(k) for k in range(33, 127)]
    noise = lambda n: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(n))
    # no five words come twice, so the base rule passes them, yet they repeat themselves
    drone = lambda n: " ".join(f"always the same {k}" for k in range(n))
    good = [prose(n) for n in (15, 20, 40, 130, 270, 700, 2000) for _ in range(60)]
    bad = [f(n) for f, sizes in ((noise, (20, 120, 600, 900)), (drone, (12, 60, 300, 900))) for n in sizes] + [prose(800) + " " + noise(900)]
    return good, bad


def expected_kept(rows, bands):
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    ratio = lambda b: len(compress(b)) / len(b)
    kind = lambda n: int(quality_rules.class_of(n))
    counts = {}
    for _, text, failed in rows:
        if not failed:
            b = text.encode()
            counts.setdefault(kind(len(b)), Counter())[int(ratio(b) * 1000)] += 1
    limits = {}
    for c in range(len(quality_rules.EDGES)):
        known = sorted(counts.get(c, Counter()).elements())
        if len(known) >= bands.enough:
            middle, high = ((known[-(-len(known) * q // 10) - 1] + 0.5) / 1000 for q in (5, 9))
            half = max(bands.spread * (high - middle), bands.least * middle)
            limits[c] = (middle - half, middle + half)
        else:
            limits[c] = bands.fixed(int(quality_rules.EDGES[c]))
    inside = lambda b: limits[kind(len(b))][0] <= ratio(b) <= limits[kind(len(b))][1]
    out = []
    for i, text, failed in rows:
        b = (text or "").encode()
        chunks = [b[k : k + bands.chunk_bytes] for k in range(0, len(b), bands.chunk_bytes)] if len(b) > bands.chunk_bytes else []
        out.append((i, not failed and inside(b) and sum(len(x) for x in chunks if not inside(x)) <= bands.chunk_share * len(b)))
    return sorted(out, key=repr)


def test_compression_bands_equal_brute_force_and_reject_junk_that_the_base_rule_passes(spark, docs, hard):
    good, bad = junk_and_prose()
    mixed = list(enumerate(good + bad))
    for df, rows in [*both(spark, docs, hard), (spark.createDataFrame(mixed, "doc_id long, text string").repartition(3), mixed)]:
        got = quality_rules.quality_rules(df).collect()
        failed = {(r.doc_id, r.n_words): r.base_failed for r in got}
        base = [(i, t, failed[(i, len(WORD.findall(t or "")))]) for i, t in rows]
        assert sorted(((r.doc_id, r.kept) for r in got), key=repr) == expected_kept(base, quality_rules.Bands())
    by_id = {r.doc_id: r for r in got}
    assert not any(r.base_failed for r in got)
    assert all(by_id[i].kept for i in range(len(good))) and not any(by_id[i].kept for i in range(len(good), len(mixed)))


# --- 4


def near(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= k


def lines_kept(rows):
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= 24 and len(x) < 2000}, key=len)
    parent = {x: x for x in lines}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            limit = 1 if len(a) < 40 else 2
            if len(b) - len(a) > limit:
                break
            if sum((Counter(a) - Counter(b)).values()) <= limit and near(a, b, limit):
                parent[find(a)] = find(b)
    seen, out = set(), []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for x in (text or "").split("\n"):
            if not WORD.search(x) or find(x) not in seen:
                kept.append(x)
            seen.add(find(x))
        n = (text or "").count("\n") + 1
        out.append((i, n, n - len(kept), sha("\n".join(kept))))
    return {r[0]: r[1:] for r in out if r[0] is not None}


def test_line_dedup(spark, docs, hard):
    for df, rows in both(spark, docs, hard):
        got = {r.doc_id: tuple(r)[1:] for r in line_dedup.digest(df).collect() if r.doc_id is not None}
        assert got == lines_kept([r for r in rows])


def test_banded_distance_equals_the_table():
    import random

    import numpy as np

    rnd, a, b = random.Random(2), [], []
    for _ in range(400):
        x = [rnd.choice("abé") for _ in range(rnd.randint(24, 60))]
        y = list(x)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(y))
            y[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["a"], ["é"]])
        if len(y) >= 24:
            a.append("".join(x))
            b.append("".join(y))
    limit = line_dedup.threshold(np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)]))
    points = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    got = line_dedup.within([points(x) for x in a], [points(x) for x in b], limit)
    assert got.tolist() == [near(x, y, k) for x, y, k in zip(a, b, limit.tolist(), strict=True)] and 0 < got.sum() < len(a)
    one = lambda x: line_dedup.parity(points(x), np.array([0]), np.array([len(x)]))[0].view(np.uint64)
    for x, y, k, hit in zip(a, b, limit.tolist(), got, strict=True):
        differ = [bin(int(p) ^ int(q)).count("1") for p, q in zip(one(x), one(y), strict=True)]
        assert not hit or differ[0] <= 2 * k and sum(differ[1:]) <= 4 * k


# --- 5

PAGES = {
    "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One &amp; two<br>three.<p>Four <b>five</b>, six.</article><footer>foot</footer>": "Head\nOne & two\nthree.\nFour five, six.",
    "<body><div class='sidebar'>Menu, of things, with punctuation.</div><main><p>Text\n of   it.</p><div class='comments'><p>nice, one!</p></div><form>mail <input></form></main></body>": "Text of it.",
    "<body><div id=menu><ul><li><a>a</a></li><li><a>b</a></li></ul></div><div><p>A long paragraph, with commas, that is the content of this page.</p><p>Another long paragraph, again with commas, and more of them.</p></div><div class=footer>c</div></body>": "A long paragraph, with commas, that is the content of this page.\nAnother long paragraph, again with commas, and more of them.",
    "": "", "<p>unclosed <b>bold": "unclosed bold", "<!-- only a comment": "", "<article><header><h1>In</h1></header><p>x < y & z</p><aside>no</aside></article>": "In\nx < y & z",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_main_texts_of_the_table(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    rows = html.main_texts(table(spark, SF, "pages")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        import html as entities

        want = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)>", inner)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)
    nulls = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert tuple(html.main_texts(nulls).first()) == (1, "u", "", 0)


# --- 6


def test_shards(spark, docs, hard):
    for df, rows in both(spark, docs, hard):
        got = sharding.shards(df).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        place = {}
        for r in got:
            assert place.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    sums = Counter()
    for r in sharding.shards(table(spark, "/root/testdata/sf0.01", "documents")).collect():
        sums[r.shard] += r.size
    assert len(sums) == 24 and max(sums.values()) < 1.02 * min(sums.values())


def plain_best_fit(sizes, capacity):
    """(size, bin) of every group, one by one, and the number of bins."""
    room, out = [], []
    for size in sorted(sizes, reverse=True):
        able = [(r, k) for k, r in enumerate(room) if r >= size]
        if not able:
            room.append(max(capacity, size))
            able = [(room[-1], len(room) - 1)]
        k = min(able)[1]
        room[k] -= size
        out.append((size, k))
    return sorted(out), len(room)


def test_runs_of_equal_sizes_are_packed_as_one_by_one():
    import random

    rnd = random.Random(4)
    for _ in range(60):
        sizes = [rnd.choice([8, 9, 20, 33, rnd.randint(8, 400)]) for _ in range(rnd.randint(0, 120))]
        capacity = rnd.randint(50, 900)
        runs, opened = sharding.best_fit_decreasing(list(Counter(sizes).items()), capacity)
        want, bins = plain_best_fit(sizes, capacity)
        assert sorted((s, k) for s, k, n in runs for _ in range(n)) == want and opened == bins


def test_shards_are_those_of_plain_best_fit_decreasing(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    n = Counter(t for _, t in rows)
    sizes = [(len(t.encode()) + 8) * k for t, k in n.items()]
    least = max(-(-sum(sizes) // 24), max(sizes))
    extra = next(e for e in (2**k - 1 for k in range(60)) if plain_best_fit(sizes, least + e)[1] <= 24)
    want = plain_best_fit(sizes, least + extra)[0]
    text, seen = dict(rows), {}
    for r in sharding.shards(table(spark, "/root/testdata/sf0.01", "documents")).collect():
        assert seen.setdefault(text[r.doc_id], r.shard) == r.shard
    assert sorted(((len(t.encode()) + 8) * n[t], s) for t, s in seen.items()) == want


# --- 7


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    exact = {(i, k) for i, t in docs for k, b in items if decontaminate.normal(b) in decontaminate.normal(t)}
    assert exact <= got
    brute = {(i, k) for i, t in docs if len(t) < 900 for k, b in items if decontaminate.best_match(decontaminate.normal(b), decontaminate.normal(t), int(len(decontaminate.normal(b)) * decontaminate.ERROR_RATE))}
    assert brute == {p for p in got if len(dict(docs)[p[0]]) < 900}
    clean = decontaminate.clean_documents(table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_edited_passages_match_and_blocks_agree(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the seven sleepy cats tonight"
    edited = item.replace("lazy", "lasy").replace("seven", "sevn").upper()
    docs = spark.createDataFrame([(1, f"x {edited}\n y"), (2, "nothing of the kind"), (3, None), (None, item), (4, item.replace("quick brown fox", "slow red hen"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, "unrelated words that make up an item of some forty characters or more")], "item_id long, text string")
    want = [(None, 7, 0), (1, 7, 2)]
    for size in (1 << 20, 60):
        assert sorted(((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench, block_bytes=size).collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


# --- 8


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in mil.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and sum(s >= 0.7 for s in good) > 0.95 * len(good)


def test_classifier_without_labels_and_on_hard_rows(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil.quality_scores(hard, none).collect()} == {1.0}
    one = spark.createDataFrame([(4, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert mil.quality_scores(hard, one).count() == len(HARD) and mil.quality_scores(empty, one).count() == 0


# --- 9


def removed(rows, k=13):
    first = {}
    rank = lambda i: (i is None, i or 0)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            first[x] = min(first.get(x, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = {b for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < rank(i) for b in range(a, a + k)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for b, x in enumerate(w) if b not in gone))))
    return sorted(out, key=repr)


def test_substring_dedup(spark, docs, hard):
    for df, rows in both(spark, docs, hard):
        for size, seed in ((6_000_000, 5), (60_000, 5), (60_000, 2), (60_000, 13)):
            assert sorted((tuple(r) for r in substring.deduplicated(df, group_bytes=size, seed=seed).collect()), key=repr) == removed(rows)


def test_levels_double_and_end_when_nothing_survives(spark):
    assert substring.levels(13, 5) == [7, 13] and substring.levels(13, 2) == [2, 4, 7, 13] and substring.levels(4, 5) == [4]
    apart = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in substring.deduplicated(apart).collect()} == {0}
    with pytest.raises(TypeError):
        substring.deduplicated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- 10


def test_tokens(spark, docs, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for df, rows in both(spark, docs, hard):
        want = []
        for i, text in rows:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert sorted((tuple(r) for r in bpe.encoded(df, tokenizer_path()).collect()), key=repr) == sorted(want, key=repr)


def test_special_words_and_small_caches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from skerry.llm.text import utf8

    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 3)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    e = bpe.Encoder(tokenizer_path())
    texts = ["Hello  World's don't\n naïve É 12a3 <|endoftext|>x .. !! " * 20, "ΣΣ Σ it's IT'S 'tis d'accord", "a" * 700, " b ", ""]
    data, offsets = utf8(pa.array(texts))
    for text, (ids, decoded) in zip(texts, e.texts(np.asarray(data), offsets), strict=True):
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == e.tokenizer.decode(want, skip_special_tokens=False)


# --- empty tables


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")
    for out in (pii.digest(empty), jaccard.near_duplicates(empty), quality_rules.quality_rules(empty), line_dedup.digest(empty), sharding.shards(empty), decontaminate.contaminated(empty, bench), substring.deduplicated(empty), bpe.encoded(empty, tokenizer_path())):
        assert out.count() == 0
