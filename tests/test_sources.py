import time

import pytest
from pyspark.sql import functions as F

from quirewright import session
from quirewright.operators import pages
from quirewright.plans import pipeline
from quirewright.sources import files, plugs


def test_texts_that_are_too_large_fail(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é small")
    (tmp_path / "b.txt").write_text("x" * 100)
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"é small", "x" * 100}
    with pytest.raises(Exception, match="too large"):
        files.read_texts(spark, str(tmp_path), 50).collect()
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text('{"a": 1}')
    assert files.read_json(spark, str(tmp_path), "a INT").first().a == 1
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path), "a INT", 3)


def test_appends_refuse_contradictions(spark, tmp_path):
    path = str(tmp_path / "store")
    ddl = "id STRING, digest STRING, extra INT"
    files.append_new(spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("a", "1", 5)], ddl), path, "id", "digest")
    files.append_new(spark.createDataFrame([("a", "1", 9), ("c", None, 0)], ddl), path, "id", "digest")
    files.append_new(spark.createDataFrame([("c", None, 0)], ddl), path, "id", "digest")
    assert {(r.id, r.digest) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "2"), ("c", None)} and spark.read.parquet(path).count() == 3
    for rows in ([("b", "3", 0)], [("z", "1", 0), ("z", "2", 0)]):
        with pytest.raises(ValueError):
            files.append_new(spark.createDataFrame(rows, ddl), path, "id", "digest")
    assert spark.read.parquet(path).count() == 3


def test_bundles(spark, tmp_path):
    ddl = "document_id STRING, page_id STRING, page_number INT, span_id STRING, span_index INT, source STRING, text STRING"
    spans = spark.createDataFrame([("d", "d-1", 1, "s1", 1, "ocr_line", "The weir broke in May."), ("d", "d-1", 1, "s2", 2, "ocr_line", "Rain fell.")], ddl)
    queries = spark.createDataFrame([("q", "when did the weir break"), ("r", "badgers")], "query_id STRING, query STRING")
    scope = queries.select("query_id", F.lit("d").alias("corpus_id"))
    judged = spark.createDataFrame([], "query_id STRING, chunk_id STRING")
    gates = spark.createDataFrame([("retrieval.mean_recall", "minimum", 1.0, 1)], "metric STRING, comparator STRING, threshold DOUBLE, minimum_samples INT")
    for name in ("one", "two"):
        pipeline.store(spans.repartition(3), queries, scope, judged, gates, str(tmp_path / name))
        assert all(r.same for r in files.verify_bundle(spark, str(tmp_path / name)).collect())
    one, two = (sorted(map(str, spark.read.json(str(tmp_path / n / "manifest")).collect())) for n in ("one", "two"))
    assert one == two and len(one) == 5
    with pytest.raises(Exception, match="(?i)exists"):
        pipeline.store(spans, queries, scope, judged, gates, str(tmp_path / "one"))
    spark.createDataFrame([("x",)], "c STRING").write.mode("overwrite").parquet(str(tmp_path / "one" / "hits"))
    assert {r.name for r in files.verify_bundle(spark, str(tmp_path / "one")).collect() if not r.same} == {"hits"}


def test_plugged_parsers(spark):
    def lines(data):
        if data.startswith(b"%"):
            raise ValueError("encrypted")
        for n, x in enumerate(data.decode().split("\n"), 1):
            yield {"line_index": n, "text": x, "confidence": 0.5 * n, "quad": [{"x": 0.0, "y": 1.0}]}

    inputs = spark.createDataFrame([("p", bytearray(b"one\ntwo")), ("q", bytearray(b"%PDF")), ("r", None)], "page_id STRING, content BINARY")
    out = plugs.parse(inputs, "page_id", "lines", lines)
    assert {(r.page_id, r.refused, r.text) for r in out.collect()} == {("p", None, "one"), ("p", None, "two"), ("q", "encrypted", None), ("r", "missing", None)}
    page = pages.recognised_pages(out.filter("refused is null"), 0.6).first()
    assert (page.text, page.line_count, page.mean_confidence, page.below) == ("one\ntwo", 2, 0.75, 1)
    for kind in plugs.KINDS:
        assert plugs.parse(inputs.limit(0), "page_id", kind, lines).count() == 0


def test_tables_written_by_a_job_can_be_released(spark):
    before = session.written()
    df = session.cut(spark.range(5))
    assert df.count() == 5 and session.written() == before + 1
    assert session.release(spark, before) == 1 and session.written() == before
    with pytest.raises(Exception):
        df.count()


def test_shuffles_of_a_tidy_table_are_gone_at_once(spark):
    """F8: those of the job that has just ended too; the session is left as it was."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n for n in files.getAllFiles().mkString("\n").split("\n") if n.endswith(".data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, before = spark.conf.get(name), shuffled()
    df = session.cut(spark.range(20_000).withColumn("k", F.col("id") % 500).groupBy("k").count(), tidy=True)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and df.count() == 500
    assert spark.conf.get(name) == old
