"""Files in and out: images as pixels, vector documents as elements, reports of several versions, published
results."""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.runtime import bounded_batches, small_enough, united

SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")
#: Attributes that an element takes from its groups.
INHERITED = ("fill", "stroke", "stroke-width", "stroke-linejoin", "stroke-miterlimit")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of the known kinds (whatever the case of the suffix), by name; a kind that Spark
    cannot decode has status ``unsupported``."""
    rows = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    known = rows.withColumn("name", name).filter(F.lower("name").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))
    status = F.when((F.col("height") > 0) & F.col("nChannels").isin(1, 3, 4), "ok").otherwise("unsupported")
    return known.select(F.xxhash64("origin").alias("doc_id"), "name", "height", "width", F.col("nChannels").alias("channels"), "data", status.alias("status")).orderBy("name")


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, h, w, c, data in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "height", "width", "channels", "data"))):
            px = np.frombuffer(data, np.uint8).reshape(h * w, c).astype(np.int32)
            b, g, r = (px[:, 0], px[:, 0], px[:, 0]) if c == 1 else (px[:, 0], px[:, 1], px[:, 2])
            a = px[:, 3] if c == 4 else np.full(h * w, 255, np.int32)
            at = np.arange(h * w)
            for i in range(0, h * w, 65536):  # a large image leaves in pieces
                part = slice(i, i + 65536)
                cols = [np.full(len(at[part]), doc_id, np.int64), (at[part] // w).astype(np.int32), (at[part] % w).astype(np.int32), *(v[part] for v in (r, g, b, a))]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["doc_id", "y", "x", "r", "g", "b", "a"])


def to_pixels(images: DataFrame) -> DataFrame:
    """One row a pixel of every decoded image; Spark's BGR(A) bytes become r, g, b, a."""
    return images.filter("status = 'ok'").select("doc_id", "height", "width", "channels", "data").mapInArrow(_pixels, "doc_id long, y int, x int, r int, g int, b int, a int")


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inherited = INHERITED
    names = ["doc_id", "idx", "parent_idx", "depth", "tag", "attrs", "in_defs", "is_valid"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.bool_()]
    for batch in batches:
        rows = []
        for doc_id, svg in zip(batch.column("doc_id").to_pylist(), batch.column("svg").to_pylist()):
            try:
                root = ET.fromstring(svg or "")
            except ET.ParseError:
                rows.append((doc_id, 0, None, 0, None, [], False, False))
                continue
            todo, n = [(root, None, 0, {}, False)], 0
            while todo:
                el, parent, depth, above, in_defs = todo.pop()
                tag = el.tag.rpartition("}")[2]
                own = above | {k.rpartition("}")[2]: v for k, v in el.attrib.items()}
                in_defs = in_defs or tag == "defs"
                rows.append((doc_id, n, parent, depth, tag, list(own.items()), in_defs, True))
                down = {k: own[k] for k in inherited if k in own}
                todo += [(child, n, depth + 1, down, in_defs) for child in reversed(el)]
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def scan_svg(docs: DataFrame) -> DataFrame:
    """Elements of vector documents (doc_id, svg) in document order, with their inherited paints and
    stroke shape among their attributes. A document that is no XML has one row with ``is_valid`` false."""
    return bounded_batches(docs.select("doc_id", "svg")).mapInArrow(_shred, "doc_id long, idx int, parent_idx int, depth int, tag string, attrs map<string,string>, in_defs boolean, is_valid boolean")


def _metadata(batches: Iterator[pa.RecordBatch], node_id: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for svg in batch.column("svg").to_pylist():
            try:
                root = ET.fromstring(svg or "")
            except ET.ParseError:
                texts.append(None)
                continue
            node = next((el for el in root.iter() if el.tag.rpartition("}")[2] == "metadata" and el.get("id") == node_id), None)
            texts.append(None if node is None else "".join(node.itertext()) or None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def embedded_json(docs: DataFrame, node_id: str, schema: str) -> DataFrame:
    """The JSON of ``<metadata id=...>`` of every document (doc_id, svg); a null struct where it is
    missing or the document is no XML, null fields where the JSON is broken."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "svg").mapInArrow(lambda it: _metadata(it, node_id), "doc_id long, text string")
    return texts.select("doc_id", F.from_json("text", schema).alias("value"))


REPORT = "native_circles int, native_rectangles int, native_primitives int, circles int, native_lines int, native_ellipses int, native_polylines int, native_polygons int, stroke_details array<struct<primitive:string>>, _corrupt_record string"


def report_versions(reports: DataFrame) -> DataFrame:
    """Reports (doc_id, json) of all layouts in one shape; broken ones are left out. Circles come
    from their own field, else from the primitives less the rectangles, else from the oldest name."""
    r = reports.select("doc_id", F.from_json("json", REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).filter("r._corrupt_record IS NULL").select("doc_id", "r.*")
    listed = F.size(F.filter(F.coalesce("stroke_details", F.array().cast("array<struct<primitive:string>>")), lambda d: d["primitive"] == "rect"))
    rect = F.coalesce("native_rectangles", listed)
    circles = F.coalesce("native_circles", F.greatest(F.lit(0), F.col("native_primitives") - rect), "circles", F.lit(0))
    others = {n: F.coalesce(f"native_{n}", F.lit(0)) for n in ("lines", "ellipses", "polylines", "polygons")}
    total = circles + rect + sum(others.values(), F.lit(0))
    return r.select("doc_id", circles.alias("circles"), rect.alias("rectangles"), *(c.alias(n) for n, c in others.items()), total.alias("primitives"))


def scan_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All ``report.json`` files below a folder with their time, newest first; broken ones stay out
    of ``report_versions``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").text(folder)
    return files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("json")).orderBy(F.desc("modified"))


def _at(v: Column, *path: str) -> Column:
    """A field of a variant as a variant; null where it is missing or something above is no object."""
    return F.try_variant_get(v, "$" + "".join(f".{p}" for p in path), "variant")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]*", 0)


def _object(*options: Column) -> Column:
    """The first of the values that is an object with fields."""
    return F.coalesce(*(F.when(F.size(F.try_variant_get(o, "$", "map<string,variant>")) > 0, o) for o in options))


def _count(v: Column) -> Column:
    """A count that is a number, or the list or object of what was counted; no count for anything else."""
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(~F.isnan(number) & (F.abs(number) < float(1 << 53)), number).cast("long")
    text = F.try_variant_get(v, "$", "string")
    kind = _kind(v)
    return (
        F.when(kind == "ARRAY", F.size(F.try_variant_get(v, "$", "array<variant>")).cast("long")).when(kind == "OBJECT", F.size(F.try_variant_get(v, "$", "map<string,variant>")).cast("long"))
        .when(kind == "BOOLEAN", None).when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))).otherwise(whole)
    )


def report_summary(reports: DataFrame) -> DataFrame:
    """Editability data of reports (doc_id, json) of all layouts: ``doc_id, scene_status, dom_groups,
    manifest_groups, paint_status, role_controls, paint_resources, operation_status, total, passed, partial, failed,
    manual_review, automatable``.

    Fields are read by what they hold, since a count may be a number, a list or an object. Scene and paint
    are taken from their present or earlier place, counts of operations from the summary or beside it. The
    status follows from the counts: anything failed or to be reviewed, then partial, then all passed;
    otherwise the report's own. Reports that are no JSON object are left out.
    """
    r = reports.select("doc_id", F.try_parse_json("json").alias("r")).filter(F.try_variant_get("r", "$", "map<string,variant>").isNotNull())
    v = F.col("r")
    scene = _object(_at(v, "scene"), _at(v, "editability_enhancements", "stages", "scene_graph"))
    paint = _object(_at(v, "paint"), _at(v, "paint_roles"))
    rows = r.select("doc_id", scene.alias("scene"), paint.alias("paint"), _object(_at(v, "designer_operations")).alias("ops"))
    names = ("passed", "partial", "failed", "manual_review", "automatable")
    summary = _object(_at(F.col("ops"), "summary"))
    rows = rows.withColumn("resources", _object(_at(F.col("paint"), "resource_counts"))).withColumn("summary", summary)
    # A field of the summary counts even where it is null.
    inside = lambda n: F.coalesce(F.map_contains_key(F.try_variant_get("summary", "$", "map<string,variant>"), n), F.lit(False))
    counts = {n: F.when(inside(n), _count(_at(F.col("summary"), n))).otherwise(_count(_at(F.col("ops"), n))) for n in names}
    listed = F.when(_kind(_at(F.col("paint"), "roles")) == "ARRAY", _count(_at(F.col("paint"), "roles")))
    status = lambda c: F.coalesce(F.nullif(F.try_variant_get(c, "$.status", "string"), F.lit("")), F.lit("not_audited"))
    found = rows.select(
        "doc_id", "ops", status("scene").alias("scene_status"), _count(_at(F.col("scene"), "actual_dom_group_count")).alias("dom_groups"), _count(_at(F.col("scene"), "manifest_only_group_count")).alias("manifest_groups"),
        status("paint").alias("paint_status"), F.coalesce(_count(_at(F.col("resources"), "role_controls")), listed).alias("role_controls"), _count(_at(F.col("resources"), "paint_resources_total")).alias("paint_resources"),
        _count(_at(F.col("summary"), "total_operations")).alias("told"), *(c.alias(n) for n, c in counts.items()),
    )
    known = [F.col(n) for n in names[:4]]
    total = F.coalesce("told", F.when(F.coalesce(*known).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in known), F.lit(0).cast("long"))))
    some = lambda n: F.coalesce(F.col(n), F.lit(0)) != 0
    own = F.coalesce(F.nullif(F.try_variant_get("ops", "$.status", "string"), F.lit("")), F.lit("manual_review"))
    state = (
        F.when(F.col("ops").isNull(), "not_audited").when(some("failed") | some("manual_review"), "manual_review").when(some("partial"), "partial")
        .when(some("total") & (F.col("passed") == F.col("total")), "passed").otherwise(own)
    )
    return found.withColumn("total", total).select("doc_id", "scene_status", "dom_groups", "manifest_groups", "paint_status", "role_controls", "paint_resources", state.alias("operation_status"), "total", *names)


# ---- published results -------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished manifests; their commit marks are listed, of which there is one a publication."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def stage_results(df: DataFrame, path: str, *keys: str) -> str:
    """First phase: the rows of ``df`` under the name of a new attempt, which is returned. Rows whose ``status``
    (where there is such a column) is not ``ok`` are put beside the data, as a record of what failed."""
    attempt = uuid.uuid4().hex
    named = df.withColumn("_attempt", F.lit(attempt))
    good = F.coalesce(F.col("status") == "ok", F.lit(False)) if "status" in df.columns else F.lit(True)
    named.filter(good).write.mode("append").partitionBy("_attempt", *keys).parquet(f"{path}/data")
    named.filter(~good).write.mode("append").partitionBy("_attempt").parquet(f"{path}/failed")
    return attempt


def commit_results(spark: SparkSession, path: str, attempt: str, schema: str, *keys: str) -> int:
    """Second phase: a new manifest, which points the keys that the attempt has rows of to it and leaves all
    others where they were. ``schema``: names and types of the keys. Two publications at a time cannot both
    have one number: the later one fails and may commit again."""
    done = _manifests(spark, path)
    fields = f"_attempt string, {schema}"
    parts = spark.read.schema(fields).parquet(f"{path}/data").filter(F.col("_attempt") == attempt).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    new = parts.select(F.lit(attempt).alias("_attempt"), *keys, "rows")
    if done:
        old = spark.read.parquet(f"{path}/manifest/{done[-1]}")
        same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(parts[k]) for k in keys))
        new = old.join(parts, same, "left_anti").select("_attempt", *keys, "rows").transform(united, new)
    number = done[-1] + 1 if done else 1
    new.write.parquet(f"{path}/manifest/{number}")
    return number


def publish_results(df: DataFrame, path: str, *keys: str) -> int:
    """Publish rows by ``keys`` in two phases and return the number of the manifest.

    Readers (``read_results``) follow the last finished manifest, so they see all of a publication or nothing of
    it, and a job that dies between the phases leaves the version before as it was. Keys without good rows
    keep their last good ones. ``failed_results`` has the rows that were refused, by attempt.
    """
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return commit_results(df.sparkSession, path, stage_results(df, path, *keys), kinds, *keys)


def read_results(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that a manifest points to, the last one by default; only their partitions are read."""
    done = _manifests(spark, path)
    if not done or (version is not None and version not in done):
        raise FileNotFoundError(f"no finished manifest in {path}")
    manifest = spark.read.parquet(f"{path}/manifest/{version or done[-1]}").drop("rows")
    kinds = dict(manifest.dtypes)
    data = spark.read.parquet(f"{path}/data")
    data = data.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in data.columns))
    side = F.broadcast(manifest) if small_enough(manifest.count(), 256) else manifest
    same = reduce(lambda a, b: a & b, (data[c].eqNullSafe(side[c]) for c in kinds))
    return data.join(side, same, "left_semi").drop("_attempt")


def failed_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were refused, with their attempt."""
    return spark.read.parquet(f"{path}/failed")


def write_results(df: DataFrame, path: str, *keys: str) -> None:
    """Rows by partition without a manifest; only the partitions that have rows are replaced, each at once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
