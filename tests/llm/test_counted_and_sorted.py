"""Prefix trie, divergence audit and suffix-array dedup against plain loops, on whole small tables and on hard rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skerry.llm import divergence, prefix_trie, queries, suffix_array
from skerry.llm.frames import table

SF = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# --- prefix trie


def trie_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * words
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if whole[c] == n).encode()).hexdigest()
    return [(m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], ends(n)) for n, m in members.items()]


def talks():
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} of all") for c in range(100, 190) for t in range(4)]  # copies
    rows += [(c, t, "user", f"turn {t}" if t < c % 7 else f"own {c} words {t}") for c in range(200, 260) for t in range(6)]
    rows += [(c, t, "user", f"deep {t}" if t < 70 else f"end {c}") for c in (300, 301, 320) for t in range(90)]
    rows += [(400, None, None, None), (400, 0, "user", None), (400, 1, None, "a  b\t\x0bc"), (401, 0, "user", ""), (405, None, "", ""), (400, 2, "user", "twice"), (400, 2, "user", "twice")]
    return rows


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 12])
def test_trie_equals_plain_loops(spark, shard):
    hard = talks()
    for df, rows in [
        (table(spark, SF, "conversations"), [tuple(r) for r in table(spark, SF, "conversations").collect()]),
        (spark.createDataFrame(hard, "conv_id int, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as `a.b`").repartition(5), hard),
    ]:
        assert ordered(map(tuple, prefix_trie.nodes(df, shard).collect())) == ordered(trie_of(rows))


def test_trie_of_nothing(spark):
    none = "conv_id long, turn long, role string, text string"
    assert prefix_trie.nodes(spark.createDataFrame([], none)).collect() == []
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "x")], none)).collect() == []
    with pytest.raises(TypeError, match="integer"):
        prefix_trie.nodes(spark.createDataFrame([("a", 1)], "conv_id string, turn long"))


def test_trie_moves_no_texts(spark):
    plan = prefix_trie.conversations(table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    exchanged = plan[: plan.index("Exchange")]
    assert "text" not in exchanged and "xxhash64" in plan


# --- divergence


def audit_of(rows):
    docs = [(x[2] or "", x[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x[1] or ""))) for x in rows]
    df, of_lang, of_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        of_lang[lang].update(words)
        of_group[lang, source].update(words)
    out = []
    for (lang, source), counts in of_group.items():
        kept = sorted((w for w, n in df[lang].items() if n >= 3), key=str.encode)
        share = lambda c, n: [1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept]
        total = lambda c: sum(c[w] for w in kept)
        p, all_ = share(counts, total(counts)), share(of_lang[lang], total(of_lang[lang]))
        f = lambda a, b: (a - b) ** 2 // b
        pair = [(sum(map(f, p, share(c, total(c)))), s) for (x, s), c in of_group.items() if x == lang and s != source]
        term = [(f(a, b), w) for w, a, b in zip(kept, p, all_, strict=True) if counts[w] and a > b]
        for part, found in (("pair", pair), ("term", term)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= 200:
                    out.append((lang, source, part, item, value, rank))
    return out


def hard_docs():
    rows = [(k, f"Common word{k % 9} shared{k % 4} ÄÖ ümlaut 漢字 \U0001f600 x" + f" rare{k}" * (k % 3), "en", f"s{k % 11}") for k in range(60)]
    rows += [(k, " ".join(f"tie{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400)), "tt", "a" if k < 4 else f"b{k}") for k in range(7)]
    return [*rows, (1, None, None, None), (None, "", "en", ""), (None, "one two", "single", "x"), (None, "one two", "single", "y"), (3, "A_B`C@D[E~\x7fF", "en", "s1"), (3, "A_B`C@D[E~\x7fF", "en", "s1")]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_loops(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "SOURCES", 3)
        monkeypatch.setattr(divergence, "BUCKET", 40)
        monkeypatch.setattr(divergence, "SMALL", 0)
    hard = hard_docs()
    df = spark.createDataFrame(hard, "doc_id long, text string, lang string, source string").selectExpr("*", "'c' as term", "1 as n", "2 as `a.b`").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == sorted(audit_of(hard))
    if not small:
        docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()]
        assert sorted(map(tuple, divergence.audit(table(spark, SF, "documents")).collect())) == sorted(audit_of(docs))
    assert divergence.audit(df.where("false")).collect() == []


# --- suffix array


def removed_of(rows, length=100):
    seen, out = {}, []
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for i, _, b in sorted(texts, key=lambda x: x[0]):
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = min(seen.get(b[k : k + length], (i, k)), (i, k))
    for i, name, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < (i, k):
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((name, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(chr(c) for c in rng.integers(97, 110, 5)) for _ in range(n))
    shared = word(60)
    near = [shared[:k] + "#" + shared[k + 1 :] for k in range(50, 350, 30)]
    rows = [(k, f"{word(30)} {shared} {word(10)}") for k in range(8)] + [(20 + k, t) for k, t in enumerate(near)]
    rows += [(40, "a" * 900), (41, "abcdefg" * 90), (42, "b" + "a" * 300), (43, (word(25) + " ") * 4), (44, "é" * 120), (45, "x" + "é" * 90), (46, shared[:99]), (46, shared[:100])]
    return [*rows, (50, None), (51, ""), (None, shared), (None, f"z {shared}"), (None, None), (3, rows[3][1]), (3, rows[5][1]), (60, word(3000)), (61, shared * 3)]


@pytest.mark.parametrize("limit", [suffix_array.LIMIT, 300])
def test_removed_bytes_equal_plain_loops(spark, limit):
    hard = passages()
    df = spark.createDataFrame(hard, "doc_id int, text string").selectExpr("*", "1 as id", "2 as start", "3 as `a.b`").repartition(4)
    got = suffix_array.deduplicated(df, limit=limit, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert ordered(tuple(r)[:5] for r in got) == ordered(removed_of(hard))
    assert suffix_array.deduplicated(df.where("false")).collect() == []


def test_blocks_and_lengths_give_the_same(monkeypatch):
    monkeypatch.setattr(suffix_array, "BLOCK", 40)
    rows = [(i, t) for i, t in passages() if i is not None and i not in (3, 46)]
    for length in (100, 37, 24):
        cutter = suffix_array.Cutter(length, 0, 1)
        texts = [(t or "").encode() for _, t in rows]
        ids = np.array([i for i, _ in rows])
        cutter.add(ids, ids, np.zeros(len(ids), np.int64), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        gone = {i: np.zeros(len(t) + 1, bool) for i, t in zip(ids.tolist(), texts, strict=True)}
        for doc, _, a, b in [*cutter.gone, *suffix_array.later_starts(*cutter.table(), length).tolist()]:
            gone[doc][a:b] = True
        assert {i: int(g.sum()) for i, g in gone.items()} == {r[0]: r[2] for r in removed_of(rows, length)}, length


def test_cover_holds_every_difference():
    for v in (7, 31, 57):
        cover = suffix_array.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) < v / 2 + 1


def test_merge_exchange_sorts():
    for width in (2, 4, 32, 128):
        x = np.random.default_rng(width).permutation(width) // 3
        for low, high in suffix_array._exchanges(width):
            assert len(set(low) | set(high)) == 2 * len(low)
            x[low], x[high] = np.minimum(x[low], x[high]), np.maximum(x[low], x[high])
        assert (np.diff(x) >= 0).all()


# --- SQL


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        want = con.sql(sql)
        assert df.columns == want.columns
        assert ordered(map(tuple, df.collect())) == ordered(want.fetchall()), name
