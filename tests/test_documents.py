import hashlib
import struct

from quirewright.operators import documents, pages
from quirewright.sources import files

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30) + b"\x08\x02\0\0\0"


def test_sniffing_and_rejections(spark):
    content = [b"%PDF-1.7 x", PNG, b"\xff\xd8\xff\xe0", b"<html>", b""]
    rows = [(f"f{i}", len(c), bytearray(c)) for i, c in enumerate(content)] + [("copy", len(PNG), bytearray(PNG))]
    got = {r.byte_size: r for r in documents.ingest(spark.createDataFrame(rows, "path STRING, length BIGINT, content BINARY")).collect()}
    assert len(got) == 5
    assert got[len(PNG)].media_type == "image/png" and got[len(PNG)].page_count == 1
    assert got[len(PNG)].document_id == "sha256-" + hashlib.sha256(PNG).hexdigest()
    assert got[10].media_type == "application/pdf" and got[10].page_count is None and got[10].rejection is None
    assert got[6].rejection == "unsupported_media" and got[0].rejection == "empty"


def test_size_limit_and_png_size(spark):
    df = spark.createDataFrame([("a", len(PNG), bytearray(PNG))], "path STRING, length BIGINT, content BINARY")
    assert documents.ingest(df, max_bytes=5).first().rejection == "too_large"
    assert tuple(df.select(documents.png_size(df.content).alias("s")).first().s) == (40, 30)


def test_idempotent_append(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.append_new(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k STRING, v INT"), path, "k")
    files.append_new(spark.createDataFrame([("b", 2), ("c", 3)], "k STRING, v INT"), path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_provenance(spark):
    parent = spark.createDataFrame([("d1", "f1"), ("d2", None)], "d STRING, f STRING")
    child = spark.createDataFrame([("d1", "f1"), ("d1", "zz"), ("d2", None), ("d3", "x")], "d STRING, g STRING")
    got = {(r.d, r.g, r["break"]) for r in documents.provenance_breaks(child, parent, "d", ("g", "f")).collect()}
    assert got == {("d1", "zz", "mismatch"), ("d3", "x", "missing_parent")}


def test_routing(spark):
    rows = [("a", "Enough embedded text"), ("b", "x"), ("c", "  \n"), ("d", None), ("e", "")]
    got = {r.page_id: r for r in pages.text_routing(spark.createDataFrame(rows, "page_id STRING, text STRING")).collect()}
    assert [got[k].routed_status for k in "abcde"] == ["embedded_text", "sparse_embedded_text", "ocr_candidate", "ocr_candidate", "ocr_candidate"]
    assert got["c"].text is None and got["c"].characters == 0 and got["a"].visible_characters == 18
    routed = pages.text_routing(spark.createDataFrame(rows, "page_id STRING, text STRING"))
    assert pages.ocr_selection(routed).filter("selected").count() == 4
    assert pages.ocr_selection(routed, sparse=False).filter("selected").count() == 3


def test_preflight_and_boxes(spark):
    rows = [("d", 1, 72.0, 144.0, 90), ("d", 2, 100.0, 10.0, None)]
    df = spark.createDataFrame(rows, "doc STRING, page_number INT, width DOUBLE, height DOUBLE, source_rotation_degrees INT")
    got = pages.render_preflight(df, "doc", dpi=72, max_document_pixels=11_000).orderBy("page_number").collect()
    assert (got[0].pixel_width, got[0].pixel_height, got[0].violation) == (144, 72, False)
    assert got[1].running_pixels == 144 * 72 + 1000 and got[1].violation
    quad = spark.sql("SELECT array(struct(1D AS x, 5D AS y), struct(9D AS x, 2D AS y)) AS q")
    b = quad.select(pages.quad_box(quad.q, pages.F.lit(2.0), pages.F.lit(1.0)).alias("b")).first().b
    assert tuple(b) == (2.0, 2.0, 18.0, 5.0)


def test_assembled_pages(spark):
    rows = [("p", "s2", 2, "OCR", "ocr_line", 0.8), ("p", "s1", 1, "First", "ocr_line", 0.9), ("p", "s1", 1, "First", "ocr_line", 0.9), ("p", "w", 1, "w", "embedded_word", None)]
    df = spark.createDataFrame(rows, "page_id STRING, span_id STRING, span_index INT, text STRING, source STRING, confidence DOUBLE")
    r = pages.assembled_pages(df).first()
    assert (r.text, r.line_count, r.mean_confidence) == ("First\nOCR", 2, 0.85)
