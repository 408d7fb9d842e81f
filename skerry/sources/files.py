"""Readers and writers of the files around an archive. Folders are read and written by Spark, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of an exported run.
EXECUTIONS = (
    "id string, created_at timestamp_ntz, image_id string, image_title string, image_hash string, image_bbox_geojson string, image_sensing_date timestamp_ntz, "
    "image_size_mb double, search_zone string, model_name string, model_version string, model_hash string, model_size_mb double, model_format string, "
    "compression_technique string, confidence_threshold double, iou_threshold double, constraint_profile string, tile_size int, tile_overlap int, "
    "num_detections int, avg_confidence double, total_duration_ms double, peak_ram_mb double, output_hash string, input_params_hash string, commit_sha string, "
    "status string, trigger_type string, pipeline_version string, hostname string"
)
#: The properties of a detection's feature.
PROPERTIES = (
    "detection_id", "execution_id", "scene_id", "scene_title", "acquisition_time_utc", "model_name", "model_version", "model_hash", "pipeline_version", "commit_sha",
    "constraint_profile", "confidence", "source", "class_name", "cfar_snr", "yolo_score", "incidence_angle", "on_land", "cluster_anomaly", "quality_verdict", "bbox_pixel",
)
SCENE = "image_path string, scene_area_km2 double, ground_truth array<struct<bbox:array<double>,is_vessel:boolean,confidence:string>>"


def read_executions_csv(spark: SparkSession, path: str, schema: str = EXECUTIONS) -> DataFrame:
    """Runs with quoted GeoJSON cells; an empty cell is null."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', nullValue="").csv(path)


def read_labels_csv(spark: SparkSession, path: str, confidences: tuple[str, ...] = ("HIGH", "MEDIUM"), vessels_only: bool = True) -> DataFrame:
    df = spark.read.schema("scene_id string, lat double, lon double, row int, col int, is_vessel string, confidence string").options(header=True).csv(path)
    df = df.where(F.upper("confidence").isin(*confidences))
    return df.where("lower(is_vessel) = 'true'") if vessels_only else df


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ground-truth boxes, faulty scenes) of manifest files, each a JSON list of scenes. A scene without a path, an area or
    a list of boxes is faulty; a manifest without scenes is refused."""
    scenes = spark.read.schema(SCENE).options(multiLine=True, recursiveFileLookup=True).json(path)
    if scenes.isEmpty():
        raise ValueError(f"no scenes in {path}")
    faulty = F.col("image_path").isNull() | F.col("scene_area_km2").isNull() | F.col("ground_truth").isNull()
    boxes = scenes.where(~faulty).select("image_path", "scene_area_km2", F.posexplode_outer("ground_truth").alias("gt_id", "g"))
    corners = [F.get("g.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return boxes.select("image_path", "scene_area_km2", "gt_id", *corners, "g.is_vessel", "g.confidence"), scenes.where(faulty)


def write_manifest(labels: DataFrame, scenes: DataFrame, path: str, scenes_each: int = 1000) -> None:
    """Files that each hold a JSON list of some `scenes_each` scenes. labels: (scene_id, box, is_vessel, confidence);
    scenes: (scene_id, image_path, scene_area_km2). Scenes without a label are left out."""
    box = F.struct(F.array("x_min", "y_min", "x_max", "y_max").alias("bbox"), "is_vessel", "confidence")
    nested = labels.groupBy("scene_id").agg(F.collect_list(box).alias("ground_truth")).join(scenes, "scene_id")
    record = F.to_json(F.struct("image_path", "scene_area_km2", "ground_truth"))
    n_files = max(1, -(-scenes.count() // scenes_each))
    part = nested.select(F.pmod(F.xxhash64("scene_id"), F.lit(n_files)).alias("part"), record.alias("record"))
    lists = part.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    lists.write.mode("overwrite").partitionBy("part").text(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, times in ISO form."""
    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").options(header=True, escape='"').csv(path)


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def box_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def features(df: DataFrame) -> DataFrame:
    """A GeoJSON feature for each detection: its `geometry` (GeoJSON text, if the table has this column) if it is not empty,
    else its point if it has one, else its box; the rest are properties."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c not in ("longitude", "latitude", "geometry")]))
    geometry = F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), F.to_json(point_geometry(F.col("longitude"), F.col("latitude")))).otherwise(F.to_json(box_geometry(*map(F.col, ("x_min", "y_min", "x_max", "y_max")))))
    if "geometry" in df.columns:
        geometry = F.coalesce(F.nullif(F.trim("geometry"), F.lit("")), geometry)
    return df.select(F.col("det_id"), F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), rest, F.lit("}")).alias("feature"))


def provenance_properties(dets: DataFrame, runs: DataFrame) -> DataFrame:
    """Detections joined with their runs as the columns PROPERTIES, a null where an archive does not have one; with det_id,
    longitude, latitude and the box."""
    run = runs.select(F.col("id").alias("execution_id"), *[F.col(c).alias(f"_r_{c}") for c in runs.columns if c != "id"])
    both = dets.join(run, "execution_id")
    renamed = {"detection_id": "det_id", "scene_id": "_r_image_id", "scene_title": "_r_image_title", "acquisition_time_utc": "_r_image_sensing_date", "cfar_snr": "snr"}

    def value(name: str) -> Column:
        for c in (renamed.get(name), f"_r_{name}" if name.startswith(("model", "pipeline", "commit", "constraint")) else name, name):
            if c in both.columns:
                return F.col(c).alias(name)
        return (F.array("x_min", "y_min", "x_max", "y_max") if name == "bbox_pixel" else F.lit(None).cast("string")).alias(name)

    geometry = ("det_id", "longitude", "latitude", "x_min", "y_min", "x_max", "y_max")
    return both.select(*[F.col(c).alias(f"_{c}") for c in geometry], *[value(n) for n in PROPERTIES]).withColumnsRenamed({f"_{c}": c for c in geometry})


def ogc_features(df: DataFrame, properties: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """As `features`, but the box comes first and only the named properties are given."""
    box = F.when(F.col("x_min").isNotNull(), F.to_json(box_geometry(*map(F.col, ("x_min", "y_min", "x_max", "y_max"))))).otherwise(F.to_json(point_geometry(F.col("longitude"), F.col("latitude"))))
    return df.select("det_id", F.concat(F.lit('{"type":"Feature","id":'), F.col("det_id").cast("string"), F.lit(',"geometry":'), box, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("feature"))


def stac_items(scenes: DataFrame) -> DataFrame:
    """Columns of catalogue items from (scene_id, ring, polarisation, orbit_state, sensed, created_at)."""
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return scenes.select(
        F.col("scene_id").alias("item_id"), F.array(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)).alias("bbox"),
        F.split("polarisation", r"\+").alias("polarizations"), F.lower("orbit_state").alias("orbit_state"), F.coalesce("sensed", "created_at").alias("datetime"),
    )


def write_features(df: DataFrame, path: str) -> None:
    features(df).select("feature").write.mode("overwrite").text(path)


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Path below the folder, length and SHA-256 of every file (each under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def expired_files(spark: SparkSession, folder: str, before: str) -> DataFrame:
    """Files last written before a time, with the MB that removing them would free; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.where(F.col("modificationTime") < F.lit(before).cast("timestamp")).select("path", (F.col("length") / 1e6).alias("mb"))


def write_snapshot(table: DataFrame, changed: DataFrame, key: list[str], path: str) -> DataFrame:
    """A new version of a table with the changed rows in place of those of the same key; older versions stay as they are."""
    table.join(changed.select(*key), key, "left_anti").unionByName(changed).write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)
