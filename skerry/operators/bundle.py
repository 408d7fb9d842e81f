"""Evidence bundles: what filtered runs produced, with a manifest of every file and one root hash for all of them.

A bundle is a folder of `executions`, `detections` (CSV), `features` (GeoJSON lines), `models` (the cards of the models used),
`settings` (secrets masked), then `manifest` (path, length and SHA-256 of each file) and last `root` (the manifest's hash,
counts and filters). An auditor needs to quote the root alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import exprs as X
from skerry.sources import files

from .fixpoint import cut
from .provenance import cards_for_models, compared, result_hash
from .relations import bundle_detections, bundle_executions

#: Parts of a bundle that the manifest does not list.
OWN = ("manifest/", "root/")
_MANIFEST, _ROOT = "path string, length long, sha256 string", "root string, counts map<string,long>, filters map<string,string>, made_at string"


def manifest_root(listed: DataFrame) -> DataFrame:
    """One hash (root) of a manifest, the same for any order of its rows: leaves are the hashes of (path, length, sha256), and
    each level hashes its sorted children, so no task holds all leaves."""
    return result_hash(listed.withColumn("_all", F.lit("bundle")), "_all", "path", "length", "sha256").select(F.col("output_hash").alias("root"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a bundle but for its manifest and root."""
    inside = files.file_inventory(spark, folder)
    return inside.where(~F.col("path").startswith(OWN[0]) & ~F.col("path").startswith(OWN[1]))


def write_bundle(spark: SparkSession, runs: DataFrame, dets: DataFrame, settings: DataFrame, cards: DataFrame, folder: str, made_at: str, **filters: str) -> DataFrame:
    """Writes the bundle of the runs that pass the filters (since, until, zone, model, profile) and returns its root row.

    settings: (key, value); cards: (card_name, card_text), matched to the runs' models by name or by a hash (`model_hash`,
    where runs have one) that the card quotes."""
    wanted = cut(bundle_executions(runs, **filters))
    found = cut(bundle_detections(dets, wanted))
    hashes = F.col("model_hash") if "model_hash" in runs.columns else F.lit(None).cast("string")
    models = wanted.select(F.col("model_name").alias("model_id"), F.col("model_name").alias("name"), hashes.alias("file_hash")).distinct()
    used = cut(cards.join(cards_for_models(models, cards).select("card_name").distinct(), "card_name", "left_semi"))
    files.write_csv(wanted, f"{folder}/executions")
    files.write_csv(found, f"{folder}/detections")
    files.write_features(found, f"{folder}/features")
    used.write.mode("overwrite").json(f"{folder}/models")
    settings.select("key", X.masked("key", "value").alias("value")).write.mode("overwrite").json(f"{folder}/settings")
    listing(spark, folder).write.mode("overwrite").json(f"{folder}/manifest")
    declared = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    counts = {"executions": wanted.count(), "detections": found.count(), "models": used.count(), "files": declared.count()}
    named = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.lit(None)
    given = {k: str(v) for k, v in filters.items() if v is not None}
    root = manifest_root(declared).select("root", named(counts).cast("map<string,bigint>").alias("counts"), named(given).cast("map<string,string>").alias("filters"), F.lit(made_at).alias("made_at"))
    root.coalesce(1).write.mode("overwrite").json(f"{folder}/root")
    return spark.read.schema(_ROOT).json(f"{folder}/root")


def verify_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read from the folder alone: (path, verdict) of each file, OK, MISMATCH, MISSING or EXTRA; and one row with their numbers,
    whether the manifest has the stated root, and PASS or FAIL. Extra files are allowed."""
    declared = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    verdicts = cut(compared(declared, listing(spark, folder)))
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    # of an empty manifest there is no root to state
    have, want = manifest_root(declared).agg(F.max("root").alias("have")), spark.read.schema(_ROOT).json(f"{folder}/root").agg(F.max("root").alias("want"))
    counts = verdicts.agg(n("OK"), n("MISMATCH"), n("MISSING"), n("EXTRA")).crossJoin(F.broadcast(have)).crossJoin(F.broadcast(want))
    root_ok = F.col("have").eqNullSafe(F.col("want"))
    passed = (F.col("n_mismatch") + F.col("n_missing") == 0) & root_ok
    return verdicts, counts.select("n_ok", "n_mismatch", "n_missing", "n_extra", root_ok.alias("root_ok"), F.when(passed, "PASS").otherwise("FAIL").alias("verdict"))
