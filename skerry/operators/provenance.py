"""Content hashes, registries, bundles and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import same, small

def canonical(*columns: str) -> Column:
    """A row as text that does not depend on types' printing: null is a word of its own."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def result_hash(dets: DataFrame, by: str, *columns: str, most: int = 5_000) -> DataFrame:
    """One hash for each group, the same for any order of its rows: a tree over the rows' hashes by their leading digits.

    Rows are hashed; hashes that share their leading digits are sorted and hashed together, and so on up by two digits a level
    until one is left. A group has two digits at the bottom, and two more each time that `most` rows a bucket would be
    exceeded, by its own count; so no task gathers more than about `most` hashes of a bucket or the 256 below a node."""
    rows = dets.select(by, sha(canonical(*columns)).alias("_h"))
    largest = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = lambda n: 2 + 2 * sum((n > most * 256**k).cast("int") for k in range(1, 7))
    joined = lambda x: sha(F.array_join(F.array_sort(F.collect_list(x)), ",")).alias("_h")
    if largest <= most * 256:
        level = rows.groupBy(by, F.substring("_h", 1, 2).alias("_b")).agg(joined("_h"))
        return level.groupBy(by).agg(joined(F.concat("_b", "_h")).alias("output_hash"))
    sizes = small(rows.groupBy(by).agg(digits(F.count("*")).alias("_d")))
    deep = same(rows, sizes, [by])
    level = deep.groupBy(by, "_d", F.expr("substring(_h, 1, _d)").alias("_b")).agg(joined("_h"))
    depth = 2
    while most * 256 ** (depth // 2) < largest:
        depth += 2
    for d in range(depth, 2, -2):
        # groups that are not so deep pass unchanged
        up = level.where(F.length("_b") == d).groupBy(by, "_d", F.substring("_b", 1, d - 2).alias("_p")).agg(joined(F.concat("_b", "_h"))).withColumnRenamed("_p", "_b")
        level = level.where(F.length("_b") < d).unionByName(up)
    return level.groupBy(by).agg(joined(F.concat("_b", "_h")).alias("output_hash"))


def params_hash(params: Column) -> Column:
    """Of a map: the order of its keys does not matter."""
    return sha(F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def array_hash(values: Column, *shape: Column) -> Column:
    return sha(F.concat_ws("|", F.array_join(F.transform(values, lambda v: v.cast("string")), ","), *[s.cast("string") for s in shape]))


def compared(declared: DataFrame, found: DataFrame) -> DataFrame:
    """OK, MISMATCH, MISSING or EXTRA for each path of two tables (path, sha256)."""
    a, b = declared.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("have"))
    verdict = F.when(F.col("want").isNull(), "EXTRA").when(F.col("have").isNull(), "MISSING").when(F.col("want") == F.col("have"), "OK").otherwise("MISMATCH")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def bundle_verdict(files: DataFrame) -> DataFrame:
    """Counts and PASS or FAIL; extra files are allowed."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return files.agg(n("OK"), n("MISMATCH"), n("MISSING"), n("EXTRA")).withColumn("verdict", F.when(F.col("n_mismatch") + F.col("n_missing") == 0, "PASS").otherwise("FAIL"))


def cards_for_models(models: DataFrame, cards: DataFrame) -> DataFrame:
    """(model_id, card): by name, or because the card quotes the model's hash. A hash is looked up among the 64-digit words
    of the cards, so no card is searched for every model."""
    by_name = models.join(cards, models["name"] == cards["card_name"]).select("model_id", "card_name")
    quoted = cards.select("card_name", F.explode(F.regexp_extract_all("card_text", F.lit("[0-9a-f]{64}"), F.lit(0))).alias("file_hash"))
    return by_name.union(models.join(quoted, "file_hash").select("model_id", "card_name")).distinct()


def hash_completeness(runs: DataFrame, *hashes: str) -> DataFrame:
    full = F.lit(True)
    for h in hashes:
        full = full & F.col(h).isNotNull()
    return runs.agg(F.avg(F.when(full, 1.0).otherwise(0.0)).alias("complete"))


def provenance_chain(runs: DataFrame, dets: DataFrame, cues: DataFrame, k: int = 3) -> DataFrame:
    """A row for each run with its best k detections and the cues above and below it."""
    from .relations import lineage
    from .runs import top_per_group

    best = top_per_group(dets.select("execution_id", "det_id", "confidence"), "execution_id", k, F.desc("confidence"), F.col("det_id"))
    held = best.groupBy(F.col("execution_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "det_id"))), lambda s: s["det_id"].cast("string")), ",").alias("best"))
    return lineage(runs, cues).join(held, "id", "left")


def detection_provenance(dets: DataFrame, runs: DataFrame, det_id: int | None = None) -> DataFrame:
    """Each detection (or the one asked for) with all that is known of the run that made it; the run's columns get the prefix
    run_ where names clash."""
    own = dets if det_id is None else dets.where(F.col("det_id") == det_id)
    taken = set(dets.columns)
    of_run = [F.col("id").alias("execution_id"), *[F.col(c).alias(f"run_{c}" if c in taken else c) for c in runs.columns if c != "id"]]
    return own.join(runs.select(*of_run), "execution_id")


def upsert_models(registry: DataFrame, new: DataFrame) -> DataFrame:
    """A new snapshot of the registry: (name, version) is the key; hash and size come from the new rows where there are any."""
    n = new.select("name", "version", F.col("file_hash").alias("_h"), F.col("size_mb").alias("_s"), F.lit(True).alias("_new"))
    out = registry.join(n, ["name", "version"], "full_outer")
    return out.select("name", "version", F.when(F.col("_new"), F.col("_h")).otherwise(F.col("file_hash")).alias("file_hash"), F.when(F.col("_new"), F.col("_s")).otherwise(F.col("size_mb")).alias("size_mb"))


def parse_model_name(name: Column) -> Column:
    """struct(base, technique, format) of a model's file name."""
    stem, suffix = F.regexp_replace(name, r"\.[^.]+$", ""), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    technique = F.when(stem.rlike("int8[-_]static"), "static_int8").when(stem.rlike("int8"), "dynamic_int8").when(stem.rlike("fp16|half"), "fp16").when(stem.rlike("pruned|structured"), "pruned").when(stem.rlike("distill"), "distilled").otherwise("none")
    kind = F.when(suffix == "pt", "pytorch").when(suffix == "onnx", "onnx").when(suffix == "tflite", "tflite").otherwise("unknown")
    base = F.regexp_replace(stem, r"[-_](?:int8(?:[-_](?:static|dynamic))?|fp16|half|pruned(?:[-_]?\d+)?|structured|distill(?:ed)?)$", "")
    return F.struct(base.alias("base"), technique.alias("technique"), kind.alias("format"))


def partial_update(runs: DataFrame, patch: DataFrame) -> DataFrame:
    """What a patch sets replaces; a run that succeeds loses its error."""
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in patch.columns if c != "id"])
    out = runs.join(p, "id", "left")
    for c in patch.columns:
        if c != "id":
            out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    if "error_message" in out.columns:
        out = out.withColumn("error_message", F.when(F.col("status") != "success", F.col("error_message")))
    return out.select(*runs.columns)
