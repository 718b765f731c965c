"""Documents: bytes to manifests, media sniffing, identities, idempotent storage and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_identity

#: Largest source file, and what a page count and an image's pixels may be at most.
MAX_BYTES, MAX_PAGES, MAX_PIXELS = 100 << 20, 2000, 100_000_000


def media_type(content: Column) -> Column:
    """The media type by the first bytes, never by name; null if it is none that is supported."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head == "89504E470D0A1A0A", "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
    )


def png_size(content: Column) -> Column:
    """Width and height of a PNG from its header, without decoding it."""
    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")

    return F.when(media_type(content) == "image/png", F.struct(number(17).alias("width"), number(21).alias("height")))


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Width and height of JPEGs from their frame headers, without decoding; null if there is none."""
    return pd.DataFrame([_frame(c) for c in content], columns=["width", "height"], dtype="Int64")


def _frame(data: bytes | None) -> tuple[int | None, int | None]:
    at = 2
    while data is not None and at + 9 < len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None, None


def verified(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per stored file (document_id, length, content): whether size and digest are those of its manifest."""
    want = manifests.select("document_id", F.col("byte_size").alias("_size"), F.col("fingerprint").alias("_digest")).dropDuplicates(["document_id"])
    got = files.select("document_id", "length", F.sha2("content", 256).alias("digest")).join(want, "document_id", "left")
    return got.select(
        "document_id",
        F.col("_digest").isNotNull().alias("has_manifest"),
        F.coalesce(F.col("length") == F.col("_size"), F.lit(False)).alias("same_size"),
        F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False)).alias("same_digest"),
    )


def ingest(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Manifests of ``files`` (path, length, content; Spark's binaryFile source).

    Result: document_id, fingerprint, media_type, byte_size, page_count (1 for images, null for PDFs, which a parser
    plugged in later counts), rejection (null if accepted). Content longer than ``max_bytes`` is never hashed. Equal
    content gives one row.
    """
    ok = (F.col("length") > 0) & (F.col("length") <= max_bytes)
    content = F.when(ok, F.col("content"))
    png = png_size(content)
    jpeg = jpeg_size(F.when(media_type(content) == "image/jpeg", content))
    rows = files.select(
        F.sha2(content, 256).alias("fingerprint"),
        media_type(content).alias("media_type"),
        F.col("length").alias("byte_size"),
        F.coalesce(png.width * png.height, jpeg.width * jpeg.height).alias("pixels"),
        F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").alias("_size"),
    )
    rejection = (
        F.when(F.col("_size").isNotNull(), F.col("_size"))
        .when(F.col("media_type").isNull(), "unsupported_media")
        .when(F.col("pixels") > MAX_PIXELS, "too_many_pixels")
    )
    return (
        rows.withColumn("rejection", rejection)
        .select(
            F.concat(F.lit("sha256-"), "fingerprint").alias("document_id"),
            "fingerprint",
            "media_type",
            "byte_size",
            F.when(F.col("media_type").startswith("image/"), 1).alias("page_count"),
            "rejection",
        )
        .dropDuplicates(["document_id", "byte_size", "rejection"])
    )


def manifest_audit(manifests: DataFrame) -> DataFrame:
    """Per manifest: whether id and fingerprint are well formed and belong together, and its unit and page rule."""
    image = F.col("media_type").startswith("image/")
    return manifests.select(
        "document_id",
        is_identity(F.col("document_id"), "sha256-").alias("valid_id"),
        F.coalesce(F.col("document_id") == F.concat(F.lit("sha256-"), "fingerprint"), F.lit(False)).alias("same_identity"),
        F.when(F.col("media_type") == "application/pdf", "points").when(image, "pixels").alias("dimension_unit"),
        F.coalesce(image & (F.col("page_count") != 1), F.lit(False)).alias("page_count_violation"),
        F.coalesce((F.col("byte_size") > MAX_BYTES) | (F.col("page_count") > MAX_PAGES), F.lit(False)).alias("limit_violation"),
    ).distinct()


def first_arrivals(manifests: DataFrame) -> DataFrame:
    """One manifest for each document, the first that came, with the number of its deliveries."""
    value = F.struct("ingested_at", "byte_size", "page_count", "media_type")
    return manifests.groupBy("document_id").agg(F.min(value).alias("m"), F.count("*").alias("deliveries")).select(
        "document_id", "m.media_type", "m.byte_size", "m.page_count", "m.ingested_at", "deliveries"
    )


def conflicts(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys whose rows contradict one another in ``columns`` (nulls don't)."""
    counts = [F.count_distinct(c).alias(f"{c}_values") for c in columns]
    worst = F.greatest(*(F.col(f"{c}_values") for c in columns)) if len(columns) > 1 else F.col(f"{columns[0]}_values")
    return table.groupBy(key).agg(*counts).filter(worst > 1)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Content-addressed deduplication: one row for each distinct text with its first id and number of copies."""
    return docs.groupBy(F.sha2(text_col, 256).alias("fingerprint")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def unknown_rows(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't stored yet, each key once: what an idempotent append writes."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def provenance_breaks(child: DataFrame, parent: DataFrame, key: str, *pairs: tuple[str, str]) -> DataFrame:
    """Rows of ``child`` without a parent or whose (child column, parent column) pairs differ, null-safely."""
    theirs = parent.select(F.col(key), *(F.col(p).alias(f"_{p}") for _, p in pairs), F.lit(True).alias("_there")).dropDuplicates([key])
    joined = child.join(theirs, key, "left")
    wrong = F.col("_there").isNull()
    for c, p in pairs:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"_{p}"))
    return joined.filter(wrong).select(*child.columns, F.when(F.col("_there").isNull(), "missing_parent").otherwise("mismatch").alias("break"))
