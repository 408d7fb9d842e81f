"""Column expressions: boxes, geography, verdicts, texts and parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes of the sides `a` and `b` of a join; 0 where they don't meet."""
    A, B = ([F.col(f"{s}.{k}") for k in ("x_min", "y_min", "x_max", "y_max")] for s in (a, b))
    both = area(F.greatest(A[0], B[0]), F.greatest(A[1], B[1]), F.least(A[2], B[2]), F.least(A[3], B[3]))
    either = area(*A) + area(*B) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def center_distance(a: str, b: str) -> Column:
    mid = lambda s, k: (F.col(f"{s}.{k}_min") + F.col(f"{s}.{k}_max")) / 2
    return F.sqrt(F.pow(mid(a, "x") - mid(b, "x"), F.lit(2)) + F.pow(mid(a, "y") - mid(b, "y"), F.lit(2)))


def point_in_bbox(lon: Column | str, lat: Column | str, box: Sequence) -> Column:
    """Closed: a point on the edge is inside."""
    lo_x, lo_y, hi_x, hi_y = (x if isinstance(x, Column) else F.lit(float(x)) for x in box)
    return c(lon).between(lo_x, hi_x) & c(lat).between(lo_y, hi_y)


def point_in_convex_polygon(lon: Column | str, lat: Column | str, ring: Sequence[tuple[float, float]], margin: float | None = None) -> Column:
    """Ring counter-clockwise. Without a margin closed; with one, strictly further inside than it."""
    test = F.lit(True)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        if not length:
            continue
        inward = (F.lit(x1 - x0) * (c(lat) - y0) - F.lit(y1 - y0) * (c(lon) - x0)) / length
        test = test & (inward >= 0 if margin is None else inward > margin)
    return test


def polygon_meets_envelope(ring: Sequence[tuple[Column, Column]], box: Sequence[float]) -> Column:
    """Separating-axis test of a convex ring of columns against a box."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    lo_x, lo_y, hi_x, hi_y = map(float, box)
    meets = (F.greatest(*xs) >= lo_x) & (F.least(*xs) <= hi_x) & (F.greatest(*ys) >= lo_y) & (F.least(*ys) <= hi_y)
    corners = [(lo_x, lo_y), (hi_x, lo_y), (hi_x, hi_y), (lo_x, hi_y)]
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        side = lambda x, y, x0=x0, y0=y0, x1=x1, y1=y1: (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        # counter-clockwise: some corner is on the inner side of every edge
        meets = meets & (F.greatest(*[side(F.lit(x), F.lit(y)) for x, y in corners]) >= 0)
    return meets


def finite_or_null(x: Column | str) -> Column:
    return F.when(~F.isnan(c(x)) & (F.abs(c(x)) != float("inf")), c(x))


def quality_verdict(outside: Column, on_land: Column | str = "on_land", anomaly: Column | str = "cluster_anomaly", source: Column | str = "source") -> Column:
    # fixed values: the words of stored verdicts
    return (
        F.when(outside, "outside_footprint")
        .when(F.coalesce(c(on_land), F.lit(False)), "land_artifact")
        .when(F.coalesce(c(anomaly), F.lit(False)), "cluster_artifact")
        .when(c(source).isin("yolo", "fused"), "valid_sea_target")
        .otherwise("candidate")
    )


def approved_for_sar(name: Column | str, classes: Column) -> Column:
    """A signal-processing model, or one that was taught ships."""
    return F.lower(c(name)).startswith("cfar") | F.arrays_overlap(F.transform(classes, lambda x: F.trim(F.lower(x))), F.array(F.lit("ship"), F.lit("vessel")))


def snr_to_confidence(snr: Column | str) -> Column:
    return 1 - F.exp(-c(snr) / 10)


def human_gap(seconds: Column | str) -> Column:
    s = c(seconds)
    return F.when(s < 60, F.format_string("%d s", s.cast("int"))).when(s < 3600, F.format_string("%d min", F.floor(s / 60).cast("int"))).otherwise(F.format_string("%d h", F.floor(s / 3600).cast("int")))


def error_class(message: Column | str) -> Column:
    return F.when(c(message).rlike("MemoryError|OutOfMemory"), "oom").when(c(message).rlike("Timeout"), "timeout").when(c(message).isNotNull(), "error")


def parse_bbox(text: Column | str) -> Column:
    """struct of four numbers and `valid`: four parts, all finite, minima not above maxima."""
    parts = F.transform(F.split(c(text), ","), lambda p: F.trim(p).try_cast("double"))
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    at = [F.get(parts, F.lit(k)) for k in range(4)]
    valid = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (at[0] <= at[2]) & (at[1] <= at[3])
    return F.struct(*[v.alias(n) for n, v in zip(names, at, strict=True)], F.coalesce(valid, F.lit(False)).alias("valid"))


def parse_interval(text: Column | str) -> Column:
    """struct(begin, finish) of `instant`, `a/b`, `../b` and `a/..`; an open or unreadable end is null."""
    parts = F.split(c(text), "/")
    end = lambda k: F.try_to_timestamp(F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("..")))
    return F.struct(end(0).alias("begin"), F.when(F.size(parts) > 1, end(1)).otherwise(end(0)).alias("finish"))


def bbox_to_ring(box: Sequence[Column]) -> Column:
    x0, y0, x1, y1 = box
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def ring_to_bbox(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("lon_min"), F.array_min(lats).alias("lat_min"), F.array_max(lons).alias("lon_max"), F.array_max(lats).alias("lat_max"))


def ring_to_geojson(ring: Column) -> Column:
    """A ring of (lon, lat) as the text of a GeoJSON polygon; a null ring gives null."""
    points = F.transform(ring, lambda p: F.array(p["lon"].cast("double"), p["lat"].cast("double")))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a column that is worked out once for each row, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def geojson_to_ring(text: Column | str) -> Column:
    """struct(ring, problem) of the text of a GeoJSON polygon: its outer ring, and why there is none (`not JSON`, `not a
    polygon`, `empty`, `point without two numbers`) or `open` if its last point is not its first. Null text gives nulls. A
    text is read once."""

    def parts(given: Column) -> Column:
        read = F.from_json(given["text"], "type string, coordinates array<array<array<double>>>, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        return once(F.struct(given["text"].isNull().alias("none"), read.alias("read")), found)

    def found(x: Column) -> Column:
        read, outer = x["read"], F.get(x["read"]["coordinates"], F.lit(0))
        bad = F.exists(outer, lambda p: (F.size(p) < 2) | F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull() | p.isNull())
        first, last = F.get(outer, F.lit(0)), F.try_element_at(outer, F.lit(-1))
        problem = (
            F.when(x["none"], None)
            .when(read.isNull() | read["_broken"].isNotNull(), "not JSON")
            .when(~read["type"].eqNullSafe(F.lit("Polygon")), "not a polygon")
            .when(outer.isNull() | (F.size(outer) == 0), "empty")
            .when(bad, "point without two numbers")
            .when(F.slice(first, 1, 2) != F.slice(last, 1, 2), "open")
        )
        points = F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
        return once(F.struct(problem.alias("problem"), points.alias("points")), lambda y: F.struct(F.when(y["problem"].isNull() | (y["problem"] == "open"), y["points"]).alias("ring"), y["problem"].alias("problem")))

    return once(F.struct(c(text).alias("text")), parts)


def labelled_box(lon: Column | str, lat: Column | str, boxes: Sequence[tuple[str, Sequence[float]]], default: str = "other") -> Column:
    """The label of the first box that holds the point."""
    out = F
    for label, box in boxes:
        out = out.when(point_in_bbox(lon, lat, box), label)
    return out.otherwise(default)


def masked(key: Column | str, value: Column | str) -> Column:
    """Secrets by the name of their key are replaced, and passwords inside URLs are blotted out."""
    return F.when(F.lower(c(key)).rlike("password|secret|token|api_key|credential"), "***").otherwise(F.regexp_replace(c(value), "://([^:/@]+):[^@/]+@", "://$1:***@"))
