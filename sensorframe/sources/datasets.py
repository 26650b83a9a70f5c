"""Image sequences, native annotations, COCO documents and vector packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import xywh_to_xyxy
from ..functions.ontology import NATIVE_CATEGORIES
from ..functions.text import IMAGE_SUFFIXES, SEQUENCE_SUFFIXES, natural_key, suffix
from ..operators.contracts import ContractError, require_columns
from ..operators.sampling import order_frames, timestamp_of
from ..schemas import DETECTIONS, FRAMES, GROUND_TRUTH, NATIVE_ANNOTATIONS, conform
from .packs import read_vectors


def list_files(spark: SparkSession, root: str, *, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``path`` and ``length`` of the files below ``root``; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length")


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _frames(listing: DataFrame, fps: float, number: Column, sensor: Column, modality: str) -> DataFrame:
    return conform(
        listing.select(
            "run_id",
            "frame_ordinal",
            number.alias("frame_number"),
            F.concat_ws("_", F.col("run_id"), F.format_string("%06d", number)).alias("frame_id"),
            timestamp_of(F.col("frame_ordinal"), fps).alias("timestamp_s"),
            F.col("path").alias("image_path"),
            F.col("path").alias("source_path"),
            sensor.alias("sensor_id"),
            F.lit(modality).alias("modality"),
        ),
        FRAMES,
    )


def frames_of_folder(paths: DataFrame, *, fps: float = 30.0, sensor_id: str = "VIDEO_01", modality: str = "EO"):
    """Frames of plain image folders (S2) from a ``path`` listing: one run per folder.

    Natural name order gives the ordinal, which is also the frame number.
    """
    images = paths.filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(
        "path",
        _file_name(F.col("path")).alias("name"),
        F.element_at(F.split("path", "/"), -2).alias("run_id"),
    )
    return _frames(order_frames(images), fps, F.col("frame_ordinal"), F.lit(sensor_id), modality)


def index_image_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    frames = frames_of_folder(list_files(spark, root, recursive=False), **options)
    if frames.isEmpty():
        raise ValueError(f"no supported image files in {root}")
    return frames


def frames_of_visdrone(paths: DataFrame, *, fps: float = 30.0) -> DataFrame:
    """Frames of ``sequences/<id>/NNNNNNN.jpg`` (S3): numeric stem is the frame number."""
    stem = F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1)
    images = paths.filter(suffix(F.col("path")).isin(*SEQUENCE_SUFFIXES)).select(
        "path",
        F.regexp_extract("path", r"sequences/([^/]+)/", 1).alias("run_id"),
        stem.alias("name"),
    ).filter(F.col("run_id") != "")
    bad = F.raise_error(F.concat(F.lit("frame name must have a numeric stem: "), F.col("path"))).cast("long")
    number = F.when(F.col("name").rlike(r"^\d+$"), F.col("name").cast("long")).otherwise(bad)
    return _frames(order_frames(images), fps, number, F.concat(F.lit("VISDRONE:"), F.col("run_id")), "EO")


def index_visdrone(spark: SparkSession, root: str, **options) -> DataFrame:
    return frames_of_visdrone(list_files(spark, f"{root}/sequences"), **options)


def uavdt_bad_names(paths: DataFrame) -> DataFrame:
    """Frame files whose name is not ``img<number>``."""
    return _uavdt_images(paths).filter(~F.lower(F.col("name")).rlike(r"^img\d+$"))


def _uavdt_images(paths: DataFrame) -> DataFrame:
    return paths.filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(
        "path",
        F.regexp_extract("path", r"UAV-benchmark-M/([^/]+)/", 1).alias("run_id"),
        F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1).alias("name"),
    ).filter(F.col("run_id") != "")


def frames_of_uavdt(paths: DataFrame, *, fps: float = 30.0, sensor_id: str | None = None, modality: str = "EO"):
    """Frames of ``UAV-benchmark-M/<seq>/img000001.jpg``."""
    bad = uavdt_bad_names(paths).limit(3).collect()
    if bad:
        raise ContractError(f"frame names must look like img000001.jpg: {[b.path for b in bad]}")
    images = _uavdt_images(paths)
    number = F.regexp_extract(F.lower(F.col("name")), r"^img(\d+)$", 1).cast("long")
    sensor = F.lit(sensor_id) if sensor_id else F.concat(F.lit("UAVDT:"), F.col("run_id"))
    return _frames(order_frames(images), fps, number, sensor, modality)


def index_uavdt(spark: SparkSession, root: str, **options) -> DataFrame:
    return frames_of_uavdt(list_files(spark, f"{root}/UAV-benchmark-M"), **options)


def uavdt_annotation_candidates(paths: DataFrame) -> DataFrame:
    """Annotation files per sequence, recognised by name only."""
    name = F.regexp_extract("path", r"/([^/]+?)_(gt_whole|gt_merge|gt|whole)\.txt$", 1)
    return paths.select(name.alias("sequence_id"), "path").filter(F.col("sequence_id") != "")


def annotations_from_native(native: DataFrame) -> DataFrame:
    """Labels, XYXY boxes and the ignored flag of native annotation rows."""
    table = F.create_map(*[F.lit(v) for kv in NATIVE_CATEGORIES.items() for v in kv])
    x1, y1, x2, y2 = xywh_to_xyxy(*[F.col(f"bbox_{c}") for c in ("left", "top", "width", "height")])
    return conform(
        native.select(
            *native.columns,
            F.coalesce(table[F.col("object_category")], F.lit("unknown")).alias("label"),
            ((F.col("object_category") == 0) | (F.col("score") <= 0)).alias("ignored"),
            x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        ),
        GROUND_TRUTH,
    )


def read_visdrone_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ten-column files, one per sequence (S5); malformed rows fail the read."""
    raw = (
        spark.read.schema(NATIVE_ANNOTATIONS).option("header", False).option("mode", "FAILFAST").csv(path)
        .withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.[^./]+$", 1))
    )
    return annotations_from_native(raw)


def annotations_as_detections(
    annotations: DataFrame, *, source: str = "ground_truth", include_ignored: bool = False
) -> DataFrame:
    """Annotation rows as confidence-1.0 detections (S6), all frames at once."""
    have = set(annotations.columns)
    frame = "frame_index" if "frame_index" in have else "frame_number"
    object_id = "target_id" if "target_id" in have else "object_id"
    require_columns(annotations, {frame, object_id, "label", "x1", "y1", "x2", "y2"}, "annotations")
    kept = annotations
    if "ignored" in have and not include_ignored:
        kept = kept.filter(~F.col("ignored"))
    native = [c for c in ("object_category", "score", "truncation", "occlusion", "ignored") if c in have]
    by_frame = Window.partitionBy("run_id", frame).orderBy(object_id, "x1", "y1", "x2", "y2")
    typed = kept.select(
        *[c for c in kept.columns if c not in (object_id, frame, "label", "confidence", "detector")],
        F.col(frame).alias("frame_number"),
        F.col("label"),
        F.col(object_id).cast("long").alias("object_id"),
        F.lit(1.0).alias("confidence"),
        F.lit(source).alias("detector"),
        (F.row_number().over(by_frame) - 1).cast("long").alias("detection_index"),
    )
    schema = T.StructType(DETECTIONS.fields + ([T.StructField("metadata", T.StringType())] if native else []))
    if native:
        typed = typed.withColumn("metadata", F.to_json(F.struct(*sorted(native))))
    return conform(typed, schema)


def read_coco(
    spark: SparkSession, path: str, *, multi_line: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO documents.

    Only the three required arrays are in the schema; a missing one is an error.
    A document is read by one task, so very large sets should come as many
    documents: one per file, or one per line with ``multi_line=False``.
    """
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, "
        "categories array<struct<id:bigint,name:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    absent = doc.select(
        *[F.bool_or(F.col(c).isNull()).alias(c) for c in ("images", "annotations", "categories")]
    ).first().asDict()
    missing = sorted(k for k, v in absent.items() if v)
    if missing:
        raise ContractError(f"COCO document is missing required keys: {missing}")
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def inventory_reference_images(spark: SparkSession, root: str) -> DataFrame:
    """Recursive image listing with a content digest per file (S9); hashing runs on executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return inventory_of(files)


def inventory_of(files: DataFrame) -> DataFrame:
    """``path, length, sha256`` of image rows in a ``path, length, content`` table."""
    return files.filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )


def inventory_digest(inventory: DataFrame) -> DataFrame:
    """One digest of a whole inventory, whatever its order.

    Each file's path and content give 256 bits; their eight 32-bit parts are added up over all files and the sums are
    hashed.  Sums are combined before the shuffle, so no list of files is gathered anywhere.
    """
    mark = F.sha2(F.concat(F.sha2("path", 256), F.col("sha256")), 256)
    parts = [F.conv(F.substring(mark, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    summed = inventory.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{k}") for k, p in enumerate(parts)])
    return summed.select("files", F.sha2(F.concat_ws(",", F.col("files").cast("string"), *[f"s{k}" for k in range(8)]), 256).alias("digest"))


def summarise_sources(frames: DataFrame, *, sequence_limit: int = 500, annotations: DataFrame | None = None):
    """Sequences, frames, annotation files and the first sequence names as one row."""
    per_sequence = frames.groupBy("run_id").agg(F.count("*").alias("frame_count"))
    first = (
        per_sequence.orderBy(natural_key(F.col("run_id")), "run_id").limit(sequence_limit)
        .agg(F.collect_list("run_id").alias("_names"))  # at most sequence_limit names
        .select(
            F.transform(
                F.array_sort(F.transform("_names", lambda n: F.struct(natural_key(n).alias("k"), n.alias("n")))),
                lambda s: s["n"],
            ).alias("first_sequences")
        )
    )
    total = per_sequence.agg(F.count("*").alias("sequence_count"), F.sum("frame_count").alias("frame_count"))
    row = total.crossJoin(first).withColumn(  # one row each
        "sequence_list_truncated", F.col("sequence_count") > sequence_limit
    )
    if annotations is not None:
        row = row.crossJoin(annotations.agg(F.count("*").alias("annotation_file_count")))
    return row


def read_embedding_pack(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Packed little-endian float32 rows as (``embedding_row``, ``embedding``)."""
    return read_vectors(spark, path, dim)


def join_vectors(index: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Representation index rows with their vectors."""
    return index.drop("embedding").join(vectors, keys or ["embedding_row"])
