"""Pages: text routing, OCR selection and assembly, render preflight, span order, boxes and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import visible_length

SPARSE_BELOW = 4
SPANS_PER_PAGE, SPANS_PER_DOCUMENT = 100_000, 1_000_000


def rounded(x: Column, digits: int = 6) -> Column:
    """A coordinate rounded half to even, without a negative zero."""
    return F.bround(x, digits) + F.lit(0.0)


def text_routing(pages: DataFrame, sparse_below: int = SPARSE_BELOW) -> DataFrame:
    """How each page's embedded text is used: kept, kept as sparse, or left to OCR; with measured counts.

    A page without visible characters, also one with null text, is an OCR candidate with no text and counts 0.
    """
    seen = F.coalesce(visible_length(F.col("text")), F.lit(0))
    status = F.when(seen == 0, "ocr_candidate").when(seen < sparse_below, "sparse_embedded_text").otherwise("embedded_text")
    kept = seen > 0
    return pages.select(
        "page_id",
        status.alias("routed_status"),
        F.when(kept, F.col("text")).alias("text"),
        F.when(kept, F.length("text")).otherwise(0).alias("characters"),
        seen.alias("visible_characters"),
    ).distinct()


def count_audit(pages: DataFrame) -> DataFrame:
    """Pages whose stored counts differ from the measured ones."""
    length = F.coalesce(F.length("text"), F.lit(0))
    seen = F.coalesce(visible_length(F.col("text")), F.lit(0))
    wrong = ~F.col("character_count").eqNullSafe(length) | ~F.col("non_whitespace_character_count").eqNullSafe(seen)
    return pages.filter(wrong).select(
        "page_id", "character_count", length.alias("characters"), "non_whitespace_character_count", seen.alias("visible_characters")
    ).distinct()


def ocr_selection(routed: DataFrame, sparse: bool = True) -> DataFrame:
    """Adds ``selected``: candidates, and sparse pages where ``sparse``."""
    wanted = ["ocr_candidate", "sparse_embedded_text"] if sparse else ["ocr_candidate"]
    return routed.withColumn("selected", F.col("routed_status").isin(wanted))


def skipped_pages(routed: DataFrame) -> DataFrame:
    """The rows OCR gives for pages that aren't selected: no text, counts 0."""
    rows = routed.filter(~F.col("selected"))
    return rows.select("page_id", F.lit("not_selected").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("character_count"), F.lit(0).alias("line_count"))


def recognised_pages(lines: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Pages from an engine's lines (page_id, line_index, text, confidence): a page without lines is no row here.

    ``below``: lines under the least confidence, which an engine set to it must not give.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    return lines.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("text"),
        F.count("*").alias("line_count"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("confidence") < least_confidence).alias("below"),
    )


def table_order(tables: DataFrame) -> DataFrame:
    """table_index and table_id of each page's tables, from 1 by place: top, left, bottom, right."""
    b = F.col("bounding_box")
    place = Window.partitionBy("page_id").orderBy(b.top, b.x0, b.bottom, b.x1)
    rows = tables.withColumn("table_index", F.row_number().over(place))
    return rows.withColumn("table_id", F.format_string("%s-table-%06d", "page_id", "table_index"))


def cells_outside(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells whose box isn't within that of their table. Both have table_id and bounding_box."""
    outer = tables.select("table_id", F.col("bounding_box").alias("_outer"))
    inside = box_within(F.col("bounding_box"), F.col("_outer"))
    return cells.join(outer, "table_id").filter(~F.coalesce(inside, F.lit(False))).drop("_outer")


def assembled_pages(spans: DataFrame) -> DataFrame:
    """What recognition gives for each page from its line spans: text, lines and mean confidence.

    Lines are joined in span order; repeated spans count once; the mean is rounded to 6 digits and null where no
    line has a confidence. A page is a bounded group.
    """
    lines = spans.filter("source = 'ocr_line'").dropDuplicates(["page_id", "span_id"])
    ordered = F.array_sort(F.collect_list(F.struct("span_index", "text")))
    return lines.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("text"),
        F.count("*").alias("line_count"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def replay_audit(page_ocr: DataFrame, spans: DataFrame) -> DataFrame:
    """Per recognised page: whether text, line count and mean confidence equal what its line spans give."""
    stored = page_ocr.filter("status = 'ocr_text'").select("page_id", F.col("text").alias("stored"), F.col("line_count").alias("stored_lines"), F.col("mean_confidence").alias("stored_mean")).distinct()
    given = assembled_pages(spans)
    return stored.join(given, "page_id", "left").select(
        "page_id",
        F.coalesce(F.col("stored") == F.col("text"), F.lit(False)).alias("same_text"),
        F.coalesce(F.col("stored_lines") == F.col("line_count"), F.lit(False)).alias("same_lines"),
        F.coalesce(F.abs(F.col("stored_mean") - F.col("mean_confidence")) < 5e-6, F.col("stored_mean").eqNullSafe(F.col("mean_confidence"))).alias("same_mean"),
    )


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = F.coalesce(rotation.isin(90, 270), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def render_preflight(pages: DataFrame, doc_col: str, dpi: int = 150, max_page_pixels: int = 25_000_000, max_document_pixels: int = 100_000_000) -> DataFrame:
    """Pixels each page would take at ``dpi``, their running sum in the document, and whether a limit breaks.

    pages: ``doc_col``, page_number, width, height (points), source_rotation_degrees. The running sum is over one
    document's pages, at most some thousand rows of numbers.
    """
    w, h = display_size(F.col("width"), F.col("height"), F.col("source_rotation_degrees"))
    w, h = (F.ceil(x * dpi / 72).cast("long") for x in (w, h))
    running = Window.partitionBy(doc_col).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.select(doc_col, "page_number", w.alias("pixel_width"), h.alias("pixel_height"))
    rows = rows.withColumn("pixels", F.col("pixel_width") * F.col("pixel_height"))
    rows = rows.withColumn("running_pixels", F.sum("pixels").over(running))
    return rows.withColumn("violation", (F.col("pixels") > max_page_pixels) | (F.col("running_pixels") > max_document_pixels))


def span_order(spans: DataFrame) -> DataFrame:
    """The place of every span on its page: embedded words first, then OCR lines, each in their own order."""
    rank = F.when(F.col("source") == "embedded_word", 0).otherwise(1)
    place = Window.partitionBy("page_id").orderBy(rank, "span_index", "span_id")
    rows = spans.select("page_id", "span_id", "source", "span_index").distinct()
    return rows.withColumn("place", F.row_number().over(place))


def box_union(box: Column) -> list[Column]:
    """Aggregates for the smallest box around a group's boxes."""
    return [F.min(box.x0).alias("x0"), F.min(box.top).alias("top"), F.max(box.x1).alias("x1"), F.max(box.bottom).alias("bottom")]


def box_valid(box: Column) -> Column:
    return (box.x0 >= 0) & (box.top >= 0) & (box.x1 > box.x0) & (box.bottom > box.top)


def box_within(inner: Column, outer: Column) -> Column:
    return (inner.x0 >= outer.x0) & (inner.top >= outer.top) & (inner.x1 <= outer.x1) & (inner.bottom <= outer.bottom)


def quad_box(quad: Column, x_scale: Column, y_scale: Column) -> Column:
    """The axis-parallel box around four points, scaled to the page."""
    xs, ys = F.transform(quad, lambda p: p.x), F.transform(quad, lambda p: p.y)
    return F.struct(
        (F.array_min(xs) * x_scale).alias("x0"), (F.array_min(ys) * y_scale).alias("top"),
        (F.array_max(xs) * x_scale).alias("x1"), (F.array_max(ys) * y_scale).alias("bottom"),
    )


def structure_audit(pages: DataFrame, doc_col: str = "record_id", tolerance: float = 1e-6) -> DataFrame:
    """Per delivered page whether it agrees with the page's first delivery: size within the tolerance, unit, rotation.

    pages: ``doc_col``, page_id, width, height, dimension_unit, source_rotation_degrees. Pages without an id aren't compared.
    """
    values = ["width", "height", "dimension_unit", "source_rotation_degrees"]
    known = pages.filter("page_id is not null")
    first = known.groupBy("page_id").agg(F.min(F.struct(doc_col, *values)).alias("_first"))

    def near(name: str) -> Column:
        a, b = F.col(name), F.col(f"_first.{name}")
        allowed = F.greatest(F.lit(tolerance), F.greatest(F.abs(a), F.abs(b)) * 1e-9)
        return F.coalesce(F.abs(a - b) <= allowed, a.eqNullSafe(b))

    return known.join(first, "page_id").select(
        doc_col, "page_id", (near("width") & near("height")).alias("same_size"),
        F.col("dimension_unit").eqNullSafe(F.col("_first.dimension_unit")).alias("same_unit"),
        F.col("source_rotation_degrees").eqNullSafe(F.col("_first.source_rotation_degrees")).alias("same_rotation"),
    ).distinct()


def page_boxes(spans: DataFrame) -> DataFrame:
    """The box around all spans of each page, and how many spans have no valid box."""
    bad = F.count_if(~F.coalesce(box_valid(F.col("bounding_box")), F.lit(False)))
    return spans.groupBy("page_id").agg(*box_union(F.col("bounding_box")), bad.alias("invalid_boxes"))


def span_limits(spans: DataFrame, per_page: int = SPANS_PER_PAGE, per_document: int = SPANS_PER_DOCUMENT) -> DataFrame:
    """Spans of each document and of its fullest page, and whether a limit breaks; nothing is cut."""
    pages = spans.groupBy("document_id", "page_id").agg(F.count_distinct("span_id").alias("n"))
    return pages.groupBy("document_id").agg(F.sum("n").alias("spans"), F.max("n").alias("page_spans")).withColumn(
        "violation", (F.col("spans") > per_document) | (F.col("page_spans") > per_page)
    )


def enforce(violations: DataFrame, what: str) -> None:
    """Raises where a limit breaks: fail, never truncate."""
    if violations.limit(1).count():
        raise ValueError(f"{what}: a limit is exceeded")
