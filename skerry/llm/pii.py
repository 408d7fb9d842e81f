"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Each different value is a protected
entity. The words around an entity (`reach` code points to either side) are its terms, and the corpus says how much a
term t reveals of an entity e:

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 - log(n(t) / n(t, e)) / log(N / n(e))

where n(e) counts the different contexts of e, n(t, e) those that hold t, n(t) all occurrences of t in the corpus and N
those of all words. It is 1 if t only ever stands beside e. The same is counted for classes of entities (all of a kind, all addresses
of an e-mail domain) over all their contexts. Terms with n(t, e) of at least `support`, or of two where so many contexts
by chance are less likely than `chance` (a Chernoff bound), and a disclosure of at least `generalise` get a span of kind
`term` wherever they stand in a text that holds e: in `sanitised` they are generalised to a label, and from `remove` on
they are taken out. A word is a run of letters, for terms (of four letters or more) and for N alike. Counts cover all rows
of all texts.

Null and empty texts have no spans. Rows equal in doc_id and text have the same spans; a null doc_id changes nothing.
Very long texts are read whole, in time that grows with
n log n for n spans or words. Contexts that are equal count once, so copies of a document are no evidence. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import body, broadcast_if_small, settle

#: Run-start guards and possessive repeats find what the plain patterns find, leftmost and without overlap, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{4,}+"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Code points in a chunk of a text; cuts in a block of those that are put together at once.
CHUNK, BLOCK = 2048, 128


@dataclass(frozen=True)
class Disclosure:
    reach: int = 48
    support: int = 3
    generalise: float = 0.90
    remove: float = 0.97
    chance: float = 1e-6


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: what a function of array elements names twice it would compute twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """Running sums of an array, by doubling distances."""
    distances = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.aggregate(distances, lengths, step)


def found(text: Column, pattern: str) -> Column:
    """All matches with their places in code points: what lies between matches and the matches themselves add up."""

    def places(m: Column) -> Column:
        lengths = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["values"])), m["values"], lambda g, v: F.length(g) + F.length(v))
        ends = _bound(lengths, running)
        return F.zip_with(ends, m["values"], lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return _bound(both, lambda m: F.when(F.size(m["values"]) > 0, places(m)).otherwise(F.array().cast(SPAN)))


def chunks(text: Column) -> Column:
    """The text in chunks of CHUNK code points, so that a place in a long one is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` on (from 0) of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((start + length) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length)


def base_spans(text: Column, kind: str) -> Column:
    may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    if kind == "card":  # thirteen digits, each perhaps with a separator
        may = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    if kind == "ip":
        may = text.rlike(r"[0-9]\.[0-9]")
    return F.when(may, F.filter(found(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else digits(value))


def with_classes(entity: Column) -> Column:
    """The entity and the classes that it belongs to."""
    kind = F.concat(F.substring_index(entity, ":", 1), F.lit(":*"))
    domain = F.when(F.startswith(entity, F.lit("email:")), F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1)))
    return F.array_compact(F.array(entity, kind, domain))


def terms_near(chunks: Column, size: Column, span: Column, reach: int) -> Column:
    """Whole words of the context of a span, with their places in the text of `size` code points."""
    low = F.greatest(F.lit(0), span["start"] - reach)
    before = piece(chunks, low, span["start"] - low)
    after = piece(chunks, span["end"], F.lit(reach))
    left = F.filter(found(before, TERM), lambda t: ((t["start"] > 0) | (low == 0)) & (t["end"] < F.length(before)))
    right = F.filter(found(after, TERM), lambda t: (t["start"] > 0) & (t["end"] < F.least(F.lit(reach), size - span["end"])))

    def placed(shift: Column):
        return lambda t: F.struct((t["start"] + shift).alias("start"), (t["end"] + shift).alias("end"), F.lower(t["value"]).alias("term"))

    return F.concat(F.transform(left, placed(low)), F.transform(right, placed(span["end"])))


def scan(docs: DataFrame, options: Disclosure) -> DataFrame:
    """doc_id, rid, the base spans of each kind, and each entity with its context and terms."""
    text = body()
    rows = docs.select("doc_id", text.alias("text")).withColumns({"chunks": chunks(F.col("text")), "size": F.length("text")})
    for kind in PATTERNS:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))

    def context(kind: str):
        def one(s: Column) -> Column:
            near = piece(F.col("chunks"), F.greatest(F.lit(0), s["start"] - options.reach), F.lit(2 * options.reach) + s["end"] - s["start"])
            return F.struct(entity(kind, s["value"]).alias("entity"), F.xxhash64(near).alias("context"), terms_near(F.col("chunks"), F.col("size"), s, options.reach).alias("terms"))

        return one

    contexts = F.concat(*[F.transform(F.col(kind), context(kind)) for kind in PATTERNS])
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), *PATTERNS, contexts.alias("contexts"))


def disclosing(docs: DataFrame, scanned: DataFrame, options: Disclosure) -> DataFrame:
    """(entity, term, disclosure) of the pairs above the first threshold."""
    seen = scanned.select(F.explode("contexts").alias("c")).select(F.explode(with_classes(F.col("c.entity"))).alias("entity"), "c.context", "c.terms")
    each = seen.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e >= 2")
    pairs = seen.select("entity", "context", F.explode("terms.term").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).where("n_te >= 2")
    pairs = settle(pairs.join(each, "entity"))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    words = docs.where("text is not null").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term <> ''")
    # words that are no candidate only add to the total: they are one group
    wanted = broadcast_if_small(pairs.select("term").distinct().withColumn("wanted", F.lit(True)), 300_000)
    counts = settle(words.join(wanted, "term", "left").groupBy(F.when(F.col("wanted"), F.col("term")).alias("term")).agg(F.count("*").alias("n_t")))
    total = counts.agg(F.sum("n_t").alias("n")).first()["n"] or 0
    share = 1 - F.log(F.greatest(F.col("n_t"), F.col("n_te")) / F.col("n_te")) / F.log(F.lit(float(max(total, 2))) / F.col("n_e"))
    # contexts with the term if its occurrences were dealt to places at random; a context has some reach / 3 words
    mean = F.col("n_t") * F.col("n_e") * F.lit(options.reach / 3 / max(total, 2))
    unlikely = F.col("n_te") * (1 + F.log(mean / F.col("n_te"))) - mean <= F.log(F.lit(options.chance))
    enough = (F.col("n_te") >= options.support) | (unlikely & (mean < F.col("n_te")))
    return pairs.join(counts, "term").where(enough).select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= options.generalise)


def personal_data(docs: DataFrame, options: Disclosure | None = None) -> DataFrame:
    """doc_id, rid, the base spans and `term` (start, end, disclosure) of every row."""
    options = options or Disclosure()
    scanned = settle(scan(docs.select("doc_id", "text"), options))
    telling = settle(disclosing(docs, scanned, options))
    held = scanned.where(F.size("contexts") > 0).select("rid", F.explode("contexts").alias("c"))
    held = held.select("rid", F.explode(with_classes(F.col("c.entity"))).alias("entity"), F.col("c.terms.term").alias("terms"))
    marked = held.select("rid", "entity", F.explode("terms").alias("term")).join(telling, ["entity", "term"])
    by_term = marked.groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"))
    wanted = settle(by_term.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("wanted")))
    # every place of such a term in the whole text
    rows = docs.select(F.xxhash64("doc_id", body()).alias("rid"), body().alias("text")).join(broadcast_if_small(wanted, 100_000), "rid")
    places = F.transform(found(F.col("text"), TERM), lambda t: F.struct(t["start"], t["end"], F.try_element_at("wanted", F.lower(t["value"])).alias("disclosure")))
    terms = rows.select("rid", F.filter(places, lambda t: t["disclosure"].isNotNull()).alias("term")).dropDuplicates(["rid"])
    return scanned.drop("contexts").join(terms, "rid", "left")


def _joined(kind: str) -> Column:
    spans = F.coalesce(F.col(kind), F.array()) if kind != "term" else F.coalesce(F.col(kind), F.array().cast("array<struct<start:int,end:int,disclosure:double>>"))
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digest(docs: DataFrame, options: Disclosure | None = None) -> DataFrame:
    """The contract's row."""
    rows = personal_data(docs, options)
    base = F.concat(*[_joined(kind) for kind in PATTERNS])
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("term")), ",").alias("spans"),
        F.size(_joined("term")).cast("long").alias("n_terms"),
    )


def sanitised(docs: DataFrame, options: Disclosure | None = None) -> DataFrame:
    """The columns of docs with text sanitised: base spans become <KIND>, terms become <TERM> or go.

    A span within another goes with it; where two overlap in part both labels stand. Nothing that a span covers stays."""
    options = options or Disclosure()
    rows = personal_data(docs, options).drop("doc_id").dropDuplicates(["rid"])
    one = lambda kind, label: F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["end"].alias("end"), label(s).alias("label")))
    named = [one(kind, lambda s, k=kind: F.lit(f"<{k.upper()}>")) for kind in PATTERNS]
    terms = F.coalesce(one("term", lambda s: F.when(s["disclosure"] >= options.remove, F.lit("")).otherwise(F.lit("<TERM>"))), F.array().cast("array<struct<start:int,longest:int,end:int,label:string>>"))
    cuts = rows.select(F.col("rid").alias("_skerry_rid"), F.array_sort(F.concat(*named, terms)).alias("_skerry_cuts"))

    def step(acc: Column, s: Column) -> Column:
        more = s["end"] > acc["at"]  # else the span lies within one before
        out = F.concat(acc["out"], piece(F.col("_skerry_chunks"), acc["at"], F.greatest(F.lit(0), s["start"] - acc["at"])), s["label"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(more, out).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.slice("_skerry_cuts", k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step)
        return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["parts"], d["out"]).alias("parts")))

    joined = docs.withColumn("_skerry_rid", F.xxhash64("doc_id", body())).join(cuts, "_skerry_rid", "left").withColumn("_skerry_chunks", chunks(body()))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("_skerry_cuts") - 1) / BLOCK).cast("int")), start, block)
    whole = _bound(folded, lambda f: F.concat(F.array_join(f["parts"], ""), piece(F.col("_skerry_chunks"), f["at"], F.greatest(F.lit(0), F.length("text") - f["at"]))))
    return joined.withColumn("text", F.when(F.size("_skerry_cuts") > 0, whole).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
