"""Text, id, null and lookup expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

# File suffixes accepted as images and as encoded video.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
SEQUENCE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".m4v")

# Number of display colours of the annotation palette.
PALETTE_SIZE = 8

# Texts read as true.
TRUE_TEXTS = ("1", "true", "t", "yes", "y")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def media_kind(path: Column) -> Column:
    """``image`` or ``video``; raises on any other suffix."""
    ext = suffix(path)
    return (
        F.when(ext.isin(*IMAGE_SUFFIXES), F.lit("image"))
        .when(ext.isin(*VIDEO_SUFFIXES), F.lit("video"))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported media extension: "), ext)).cast("string"))
    )


def natural_key(name: Column) -> Column:
    """Sort key that compares digit runs as numbers and text case-insensitively.

    Compare the array itself (not its concatenation) so a shorter prefix sorts
    first.  A name that begins with digits gets an empty text part in front.
    A digit run loses its leading zeros and gets its length (ten digits) in
    front, so runs of any length compare as numbers.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def keyed(p: Column) -> Column:
        plain = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(plain).cast("string"), 10, "0"), plain)).otherwise(p)

    compared = F.transform(parts, keyed)
    return F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), compared)).otherwise(compared)


def split_name(root: Column) -> Column:
    low = F.lower(root)
    return (
        F.when(low.endswith("-train"), F.lit("train"))
        .when(low.endswith("-val"), F.lit("val"))
        .when(low.contains("test"), F.lit("test"))
        .otherwise(root)
    )


def class_color_index(label: Column) -> Column:
    """Stable palette slot of a class label."""
    key = F.when(label.isNull() | (label == ""), F.lit("unknown")).otherwise(label)
    return (F.crc32(F.lower(F.trim(key)).cast("binary")) % PALETTE_SIZE).cast("int")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def finite_or_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def nan_to_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def severity_rank(c: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in enumerate(SEVERITIES):
        rank = F.when(c == name, F.lit(position)).otherwise(rank)
    return rank


def label_in(labels: Iterable[str] | None, column: str = "label") -> Column:
    """Optional allow-list; ``None`` admits every label."""
    return F.lit(True) if labels is None else F.col(column).isin(*sorted(set(labels)))


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Literal map lookup; null for an unmapped key."""
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[key]


def sorted_json(**fields: Column) -> Column:
    """JSON text with keys in alphabetical order (nulls written)."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def frame_id(stem: Column, frame_number: Column) -> Column:
    return F.format_string("%s_%06d", stem, frame_number)


def caption(track_id: Column, label: Column, confidence: Column, is_alert: Column, is_anomaly: Column) -> Column:
    base = F.format_string("#%d %s %.2f", track_id, label, confidence)
    marks = F.concat_ws(" ", base, F.when(is_alert, F.lit("ALERT")), F.when(is_anomaly, F.lit("ANOM")))
    return marks
