"""The queries of this subpackage and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import lookalikes, mixing, mojibake, packing, scans, sentences, splitting


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.Scans(table(spark, sf_dir, "page_ocr")).noise()


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.Scans(table(spark, sf_dir, "page_ocr")).paragraphs()


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.evidence_values(*(table(spark, sf_dir, t) for t in ("page_text", "queries", "answers")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    return lookalikes.changed(values, lookalikes.fit(values))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    return lookalikes.normalize(values, lookalikes.fit(values))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookalikes.class_table(lookalikes.fit(_values(spark, sf_dir)))
    return spark.createDataFrame(rows, "class STRING, script STRING, form STRING, n LONG, representative STRING")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "corpus_configs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(sentences.evidence_texts(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "answers")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("record_id", "citation_index", "sentence_start").distinct()


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).drop("text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_settings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized(_packed(spark, sf_dir))


def p6_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


#: Pairs of sources that ``p6_apart`` keeps out of one another's containers.
APART = (("scan_archive", "letters"), ("scan_archive", "minutes"), ("manuals", "catalogue"))


def p6_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each setting that hold both sources of a pair which is kept apart."""
    placed = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_settings"), keep_apart=APART)
    both = [F.count_if(F.array_contains("sources", a) & F.array_contains("sources", b)).alias(f"{a}_{b}") for a, b in APART]
    return packing.containers(placed).groupBy("setting_id").agg(*both)


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was placed in each setting."""
    return _packed(spark, sf_dir).groupBy("setting_id").agg(
        F.count_if(F.col("piece") == 0).alias("items"), F.count("*").alias("all_pieces"), F.sum("tokens").alias("tokens")
    )


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of which the scheduled mixture holds less than was asked."""
    return _mix(spark, sf_dir).report().filter("short").select("mix_id", "source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).mixture()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report().withColumn("target_tokens", F.round("target_tokens", 3))


def p7_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source is always within a block of its share."""
    return _mix(spark, sf_dir).deviation().select("mix_id", "source", (F.col("worst") < 1).alias("within_block"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mojibake.repair_documents(docs, mojibake.fit(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).filter("garbled").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).filter("garbled")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_paragraphs, p2_found, p2_forms, p2_classes, p3_found, p3_pieces, p5_found, p5_sentences, p6_found,
        p6_placements, p6_fill, p6_apart, p6_totals, p7_found, p7_mixture, p7_shares, p7_deviation, p8_found, p8_restored,
    )
}

_ALLOTTED = """
        WITH sized AS (
            SELECT lower(trim(source)) AS source, coalesce(strlen(text), 0) AS tokens FROM (SELECT DISTINCT doc_id, text, source FROM documents)
        ),
        total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS tokens FROM sized),
        own AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM sized GROUP BY source),
        asked AS (
            SELECT t.*, t.target_share * t.budget_fraction * total.tokens AS target, coalesce(own.tokens, 0) AS have
            FROM mix_targets t CROSS JOIN total LEFT JOIN own ON own.source = lower(trim(t.source))
        ),
        allotted AS (SELECT *, CAST(least(ceil(target), max_copies * have) AS BIGINT) AS allot FROM asked)"""

SQL: dict[str, str] = {
    "p3_found": """
        SELECT DISTINCT c.chunk_id
        FROM chunks c LEFT JOIN corpus_configs g ON c.config_id = g.config_id
        WHERE length(c.text) > coalesce(g.max_characters_per_chunk, 4000)
    """,
    "p6_found": """
        SELECT s.setting_id, d.doc_id
        FROM documents d JOIN container_settings s ON strlen(d.text) > s.capacity_tokens
    """,
    "p6_apart": "SELECT setting_id, " + ", ".join(f"0 AS {a}_{b}" for a, b in APART) + " FROM container_settings",
    "p6_totals": """
        SELECT s.setting_id, count(*) AS items, CAST(sum(greatest(1, ceil(coalesce(strlen(d.text), 0) / s.capacity_tokens))) AS BIGINT) AS all_pieces,
            CAST(sum(coalesce(strlen(d.text), 0)) AS BIGINT) AS tokens
        FROM documents d CROSS JOIN container_settings s GROUP BY 1
    """,
    "p7_found": """
        WITH sized AS (
            SELECT lower(trim(source)) AS source, coalesce(strlen(text), 0) AS tokens FROM documents
        ),
        total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS tokens FROM sized),
        own AS (SELECT source, sum(tokens) AS tokens FROM sized GROUP BY source)
        SELECT t.mix_id, t.source
        FROM mix_targets t CROSS JOIN total LEFT JOIN own ON own.source = lower(trim(t.source))
        WHERE t.max_copies * coalesce(own.tokens, 0) < t.target_share * t.budget_fraction * total.tokens
    """,
    "p7_shares": f"""{_ALLOTTED}
        SELECT mix_id, source, target_share, max_copies, budget_fraction, round(target, 3) AS target_tokens, allot AS tokens,
            CAST(CASE WHEN allot > 0 THEN ceil(allot / have) ELSE 0 END AS INT) AS copies, allot < target AS short,
            round(allot / sum(allot) OVER (PARTITION BY mix_id), 9) AS share
        FROM allotted
    """,
    "p7_deviation": f"""{_ALLOTTED} SELECT mix_id, source, true AS within_block FROM allotted WHERE allot > 0""",
}
