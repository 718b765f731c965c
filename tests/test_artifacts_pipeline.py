import json


from quirewright.functions import artifacts
from quirewright.operators import documents, pages, quality
from quirewright.plans import pipeline



def test_round_trip_and_refusals(spark):
    df = spark.sql("SELECT 'q' AS id, 1.5D AS score, array(struct('a' AS chunk, 1 AS rank)) AS hits")
    enc = artifacts.encoded(df, ["id", "score", "hits"])
    text = enc.first().json
    assert json.loads(text) == {"id": "q", "score": 1.5, "hits": [{"chunk": "a", "rank": 1}]} and " " not in text
    schema = df.schema
    good = artifacts.decoded(enc.select("json"), "json", schema).first()
    assert good.refused is None and good.value.hits[0].chunk == "a"
    bad = ['{"id":"q"}', '{"id":"q","id":"q","score":1,"hits":[]}', "{", None, text[:-1] + ',"x":1}', text.replace("1.5", "NaN"), text.replace('"rank":1', '"rung":1')]
    rows = artifacts.decoded(spark.createDataFrame([(b,) for b in bad], "json STRING"), "json", schema).collect()
    assert all(r.refused and r.value is None for r in rows)


def test_identities_follow_content(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 1), ('a', 2) AS t(x, y)")
    ids = [r[0] for r in df.select(artifacts.artifact_id("art-", pages.F.struct("x", "y"))).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("art-")
    one = artifacts.dataset_id("d-", [("q", "t", ("c",))])
    assert one != artifacts.dataset_id("d-", [("q", "t", ("d",))]) and one == artifacts.dataset_id("d-", [("q", "t", ("c",))])


def test_jpeg_size_and_verification(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x1e\x00\x28\x03" + b"\0" * 12
    df = spark.createDataFrame([(bytearray(jpeg),), (bytearray(b"\xff\xd8\xff"),), (None,)], "c BINARY")
    assert [tuple(r.s) for r in df.select(documents.jpeg_size("c").alias("s")).collect()] == [(40, 30), (None, None), (None, None)]
    files = spark.createDataFrame([("d", 3, bytearray(b"abc")), ("e", 1, bytearray(b"x"))], "document_id STRING, length BIGINT, content BINARY")
    import hashlib

    manifests = spark.createDataFrame([("d", 3, hashlib.sha256(b"abc").hexdigest())], "document_id STRING, byte_size BIGINT, fingerprint STRING")
    got = {r.document_id: (r.has_manifest, r.same_size, r.same_digest) for r in documents.verified(files, manifests).collect()}
    assert got == {"d": (True, True, True), "e": (False, False, False)}


def test_tables(spark):
    ddl = "page_id STRING, bounding_box STRUCT<x0: DOUBLE, top: DOUBLE, x1: DOUBLE, bottom: DOUBLE>"
    got = pages.table_order(spark.createDataFrame([("p", (5.0, 50.0, 9.0, 60.0)), ("p", (1.0, 5.0, 9.0, 9.0))], ddl)).collect()
    assert {(r.bounding_box.top, r.table_id) for r in got} == {(5.0, "p-table-000001"), (50.0, "p-table-000002")}
    cells = spark.createDataFrame([("t", (1.0, 1.0, 2.0, 2.0)), ("t", (1.0, 1.0, 99.0, 2.0))], ddl.replace("page_id", "table_id"))
    tables = spark.createDataFrame([("t", (0.0, 0.0, 10.0, 10.0))], ddl.replace("page_id", "table_id"))
    assert pages.cells_outside(cells, tables).count() == 1


def test_suite(spark):
    case = "case_id STRING"
    got = quality.suite_violations(spark.createDataFrame([("a",), ("b",)], case), spark.createDataFrame([("a",)], case), spark.createDataFrame([("z",), ("b",)], case))
    assert {tuple(r) for r in got.collect()} == {("a", "duplicate_case"), ("z", "unknown_case")}


def test_pipeline_is_deterministic(spark):
    ddl = "document_id STRING, page_id STRING, page_number INT, span_id STRING, span_index INT, source STRING, text STRING"
    rows = [
        ("d", "d-1", 1, "s1", 1, "ocr_line", "Revenue grew by 12 percent in the first year."),
        ("d", "d-1", 1, "s2", 2, "ocr_line", "Costs fell."),
        ("d", "d-2", 2, "s3", 1, "ocr_line", "The outlook for the second year is stable."),
    ]
    spans = spark.createDataFrame(rows, ddl)
    queries = spark.createDataFrame([("q1", "How did revenue grow?"), ("q2", "carbon emissions")], "query_id STRING, query STRING")
    scope = spark.createDataFrame([("q1", "d"), ("q2", "d")], "query_id STRING, corpus_id STRING")

    def run():
        chunks = pipeline.corpus(spans)
        _, hits, made = pipeline.ask(queries, chunks, scope, top_k=1)
        judged = hits.filter("query_id = 'q1'").select("query_id", "chunk_id")
        gates = spark.createDataFrame([("retrieval.mean_recall", "minimum", 1.0, 1), ("provenance.citation_precision", "minimum", 1.0, 1)], "metric STRING, comparator STRING, threshold DOUBLE, minimum_samples INT")
        seen, results = pipeline.report(made, hits, judged, gates, 1)
        return [sorted(map(str, x.collect())) for x in (chunks, hits, made, seen, results)], {r.query_id: r for r in made.collect()}, quality.report_status(results).first().status

    one, answers, status = run()
    assert one == run()[0] and status == "passed"
    assert answers["q1"].answer.startswith("Revenue grew") and answers["q2"].abstention_reason == "no_retrieval_hits"
