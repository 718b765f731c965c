"""Every query of the core, and the SQL that checks it.

The SQL engine composes characters but doesn't replace compatibility forms, so its tokens are made from texts in
which a table made from the Unicode database has replaced those of letters and digits.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, chunking, documents, evaluation, events, nested, pages, quality, retrieval
from ..session import cut, table
from . import nested_queries

QUERIES = {**nested_queries.QUERIES}
SQL = {**nested_queries.SQL}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _micros(df: DataFrame, **names: str) -> DataFrame:
    """Times as microseconds, which read alike in any time zone."""
    for old, new in names.items():
        df = df.withColumn(new, F.unix_micros(F.col(old).cast("timestamp"))).drop(old)
    return df


# documents


@query("SELECT doc_id, sha256(text) AS fingerprint, length(text) AS characters FROM documents")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), F.length("text").alias("characters"))


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.content_groups(table(spark, sf_dir, "documents"))


@query("""
SELECT DISTINCT document_id, coalesce(regexp_full_match(document_id, 'sha256-[0-9a-f]{64}'), false) AS valid_id,
  coalesce(document_id = 'sha256-' || fingerprint, false) AS same_identity,
  CASE WHEN media_type = 'application/pdf' THEN 'points' WHEN media_type LIKE 'image/%' THEN 'pixels' END AS dimension_unit,
  coalesce(media_type LIKE 'image/%' AND page_count <> 1, false) AS page_count_violation,
  coalesce(byte_size > 104857600 OR page_count > 2000, false) AS limit_violation
FROM manifests""")
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.manifest_audit(table(spark, sf_dir, "manifests"))


@query("""
SELECT document_id, media_type, byte_size, page_count, epoch_us(ingested_at) AS ingested_us, deliveries FROM (
  SELECT *, count(*) OVER (PARTITION BY document_id) AS deliveries,
    row_number() OVER (PARTITION BY document_id ORDER BY ingested_at NULLS FIRST, byte_size NULLS FIRST, page_count NULLS FIRST, media_type NULLS FIRST) AS k
  FROM manifests) WHERE k = 1""")
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(documents.first_arrivals(table(spark, sf_dir, "manifests")), ingested_at="ingested_us")


@query("""
SELECT document_id, count(DISTINCT fingerprint) AS fingerprint_values, count(DISTINCT media_type) AS media_type_values FROM manifests
GROUP BY 1 HAVING greatest(count(DISTINCT fingerprint), count(DISTINCT media_type)) > 1""")
def manifest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.conflicts(table(spark, sf_dir, "manifests"), "document_id", "fingerprint", "media_type")


@query("""
SELECT DISTINCT document_id, page_id FROM page_text p
WHERE NOT EXISTS (SELECT 1 FROM manifests m WHERE m.document_id = p.document_id)""")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "page_text").select("document_id", "page_id").distinct()
    return documents.provenance_breaks(child, table(spark, sf_dir, "manifests"), "document_id").drop("break")


# pages

_SEEN = r"coalesce(length(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')), 0)"


@query(f"""
SELECT DISTINCT page_id,
  CASE WHEN n = 0 THEN 'ocr_candidate' WHEN n < 4 THEN 'sparse_embedded_text' ELSE 'embedded_text' END AS routed_status,
  CASE WHEN n > 0 THEN text END AS text, CASE WHEN n > 0 THEN length(text) ELSE 0 END AS characters, n AS visible_characters
FROM (SELECT page_id, text, {_SEEN.format("text")} AS n FROM page_text)""")
def page_text_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.text_routing(table(spark, sf_dir, "page_text"))


@query(f"""
SELECT DISTINCT page_id, character_count, coalesce(length(text), 0) AS characters, non_whitespace_character_count,
  {_SEEN.format("text")} AS visible_characters FROM page_text
WHERE character_count IS DISTINCT FROM coalesce(length(text), 0) OR non_whitespace_character_count IS DISTINCT FROM {_SEEN.format("text")}""")
def page_count_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.count_audit(table(spark, sf_dir, "page_text"))


@query(f"""
SELECT page_id, routed_status, routed_status IN ('ocr_candidate', 'sparse_embedded_text') AS selected FROM (
  SELECT DISTINCT page_id, CASE WHEN n = 0 THEN 'ocr_candidate' WHEN n < 4 THEN 'sparse_embedded_text' ELSE 'embedded_text' END AS routed_status
  FROM (SELECT page_id, text, {_SEEN.format("text")} AS n FROM page_text))""")
def ocr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pages.text_routing(table(spark, sf_dir, "page_text")).select("page_id", "routed_status").distinct()
    return pages.ocr_selection(routed)


_ASSEMBLED = """
lines AS (SELECT DISTINCT page_id, span_id, span_index, text, confidence FROM spans WHERE source = 'ocr_line'),
given AS (SELECT page_id, string_agg(text, chr(10) ORDER BY span_index, text) AS text, count(*) AS line_count,
  round(avg(confidence), 6) AS mean_confidence FROM lines GROUP BY 1)"""


@query(f"WITH {_ASSEMBLED} SELECT page_id, text, line_count, round(mean_confidence, 5) AS mean_confidence FROM given")
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assembled_pages(table(spark, sf_dir, "spans")).withColumn("mean_confidence", F.round("mean_confidence", 5))


@query(f"""
WITH {_ASSEMBLED},
stored AS (SELECT DISTINCT page_id, text, line_count, mean_confidence FROM page_ocr WHERE status = 'ocr_text')
SELECT s.page_id, coalesce(s.text = g.text, false) AS same_text, coalesce(s.line_count = g.line_count, false) AS same_lines,
  coalesce(abs(s.mean_confidence - g.mean_confidence) < 5e-6, s.mean_confidence IS NOT DISTINCT FROM g.mean_confidence) AS same_mean
FROM stored s LEFT JOIN given g ON s.page_id = g.page_id""")
def ocr_replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.replay_audit(table(spark, sf_dir, "page_ocr"), table(spark, sf_dir, "spans"))


@query(nested_queries._CTE + """,
sized AS (
  SELECT record_id, page_number, w, h FROM (
    SELECT record_id, CAST(p->>'page_number' AS INT) AS page_number,
      CAST(ceil(CAST(p->>'width' AS DOUBLE) * 150 / 72) AS BIGINT) AS a, CAST(ceil(CAST(p->>'height' AS DOUBLE) * 150 / 72) AS BIGINT) AS b,
      coalesce(CAST(p->>'source_rotation_degrees' AS INT) IN (90, 270), false) AS turned,
      CASE WHEN turned THEN b ELSE a END AS w, CASE WHEN turned THEN a ELSE b END AS h
    FROM pages))
SELECT record_id, page_number, w AS pixel_width, h AS pixel_height, w * h AS pixels,
  CAST(sum(w * h) OVER (PARTITION BY record_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_pixels,
  (w * h > 25000000 OR sum(w * h) OVER (PARTITION BY record_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) > 100000000) AS violation
FROM sized""")
def render_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = nested.subtype_table(table(spark, sf_dir, "artifact_records"), "page").select(
        "record_id", F.col("idx1").alias("page_number"), "width", "height", "source_rotation_degrees"
    )
    return pages.render_preflight(sized, "record_id")


@query("""
SELECT page_id, span_id, source, span_index,
  row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN source = 'embedded_word' THEN 0 ELSE 1 END, span_index, span_id) AS place
FROM (SELECT DISTINCT page_id, span_id, source, span_index FROM spans)""")
def span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.span_order(table(spark, sf_dir, "spans"))


@query("""
SELECT page_id, min(b.x0) AS x0, min(b.top) AS top, max(b.x1) AS x1, max(b.bottom) AS bottom,
  count(*) FILTER (NOT coalesce(b.x0 >= 0 AND b.top >= 0 AND b.x1 > b.x0 AND b.bottom > b.top, false)) AS invalid_boxes
FROM (SELECT page_id, bounding_box AS b FROM spans) GROUP BY 1""")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_boxes(table(spark, sf_dir, "spans"))


@query("""
SELECT document_id, CAST(sum(n) AS BIGINT) AS spans, max(n) AS page_spans, (sum(n) > 1000000 OR max(n) > 100000) AS violation
FROM (SELECT document_id, page_id, count(DISTINCT span_id) AS n FROM spans GROUP BY 1, 2) GROUP BY 1""")
def span_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.span_limits(table(spark, sf_dir, "spans"))


# corpora


def _packing(limits: str) -> str:
    """Packing one fragment a step: ``limits`` gives (key, page_id, size) of what is to be packed.

    ``packed`` has a row for each fragment: the chunk it goes to, the separator before it and its slice.
    """
    return f"""
RECURSIVE limits AS ({limits}),
ordered AS (SELECT l.key, l.size, s.page_id, s.source, s.text, s.span_id, row_number() OVER (PARTITION BY l.key, s.page_id
    ORDER BY CASE WHEN s.source = 'embedded_word' THEN 0 ELSE 1 END, s.span_index, s.span_id) AS k
  FROM (SELECT page_id, span_id, min(span_index) AS span_index, min(source) AS source, min(text) AS text FROM spans WHERE coalesce(text, '') <> '' GROUP BY 1, 2) s
  JOIN limits l ON l.page_id = s.page_id),
steps AS (
  SELECT key, page_id, 1::BIGINT AS k, 0::BIGINT AS pos, 1 AS chunk, 0::BIGINT AS filled, 0 AS fragments, NULL::VARCHAR AS before, NULL::VARCHAR AS piece, 0 AS n FROM ordered WHERE k = 1
  UNION ALL
  SELECT key, page_id, CASE WHEN closes THEN k WHEN pos + take = length(text) THEN k + 1 ELSE k END, CASE WHEN closes THEN pos WHEN pos + take = length(text) THEN 0 ELSE pos + take END,
    CASE WHEN closes THEN chunk + 1 ELSE chunk END, CASE WHEN closes THEN 0 ELSE filled + gap + take END, CASE WHEN closes THEN 0 ELSE fragments + 1 END,
    CASE WHEN closes THEN NULL ELSE source END, CASE WHEN closes THEN NULL ELSE substring(lines, 1, gap) || substring(text, pos + 1, take) END, n + 1
  FROM (SELECT *, fragments > 0 AND (filled + gap >= size OR fragments = 10000) AS closes, least(length(text) - pos, size - filled - gap) AS take FROM (
    SELECT s.*, o.source, o.text, o.size, CASE WHEN s.fragments = 0 THEN 0 ELSE 1 END AS gap,
      CASE WHEN s.before = 'embedded_word' AND o.source = 'embedded_word' THEN ' ' ELSE chr(10) END AS lines
    FROM steps s JOIN ordered o ON o.key = s.key AND o.page_id = s.page_id AND o.k = s.k))),
packed AS (SELECT key, page_id, chunk, string_agg(piece, '' ORDER BY n) AS text, count(*) AS fragments FROM steps WHERE piece IS NOT NULL GROUP BY 1, 2, 3)"""


@query("WITH " + _packing("SELECT DISTINCT 0 AS key, page_id, 4000 AS size FROM spans") + """,
numbered AS (SELECT p.*, s.document_id, s.page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number, p.page_id, chunk) AS chunk_index
  FROM packed p JOIN (SELECT DISTINCT document_id, page_id, page_number FROM spans) s ON s.page_id = p.page_id)
SELECT document_id, page_id, page_number, chunk AS page_chunk_index, chunk_index, 'chunk-sha256-' || sha256(document_id || ':' || chunk_index) AS chunk_id, text,
  length(text) AS character_count, sha256(text) AS content_fingerprint, fragments FROM numbered""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.number_chunks(chunking.pack_pages(table(spark, sf_dir, "spans"))).withColumn("fragments", F.size("fragments"))


@query("""
SELECT page_id, k + 1 AS page_chunk_index, substring(text, k * 4000 + 1, 4000) AS text FROM (
  SELECT page_id, text, CAST(unnest(generate_series(0, (length(text) - 1) // 4000)) AS INT) AS k
  FROM (SELECT DISTINCT page_id, text FROM page_text WHERE text IS NOT NULL AND text <> ''))""")
def fixed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_slices(table(spark, sf_dir, "page_text"))


@query("""
SELECT DISTINCT chunk_id, character_count IS DISTINCT FROM length(text) AS wrong_count,
  content_fingerprint IS DISTINCT FROM sha256(text) AS stale_fingerprint,
  coalesce(chunk_id = 'chunk-sha256-' || sha256(corpus_id || ':' || chunk_index), false) AS derived_id FROM chunks""")
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_audit(table(spark, sf_dir, "chunks"))


@query("""
SELECT corpus_id, count(DISTINCT chunk_index) AS chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index,
  max(chunk_index) - min(chunk_index) + 1 - count(DISTINCT chunk_index) AS missing FROM chunks GROUP BY 1""")
def chunk_index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.index_gaps(table(spark, sf_dir, "chunks"))


_FRAGMENTS = "(SELECT chunk_id, text, unnest(fragments) AS f FROM (SELECT DISTINCT chunk_id, text, fragments FROM chunks))"


@query(f"""
SELECT chunk_id, count(*) AS fragments, count(*) FILTER (t IS NULL) AS missing_spans,
  count(*) FILTER (t IS NOT NULL AND substring(t, f.source_start + 1, f.source_end - f.source_start)
    <> substring(text, f.chunk_start + 1, f.chunk_end - f.chunk_start)) AS different
FROM (SELECT c.chunk_id, c.text, c.f, s.text AS t FROM {_FRAGMENTS} c
  LEFT JOIN (SELECT span_id, min(text) AS text FROM spans GROUP BY 1) s ON s.span_id = c.f.span_id) GROUP BY 1""")
def fragment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fragment_audit(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "spans"))


@query(f"""
SELECT chunk_id, min(f.bounding_box.x0) AS x0, min(f.bounding_box.top) AS top, max(f.bounding_box.x1) AS x1, max(f.bounding_box.bottom) AS bottom
FROM {_FRAGMENTS} GROUP BY 1""")
def fragment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fragment_boxes(table(spark, sf_dir, "chunks"))


# retrieval


def _normal(x: str) -> str:
    """``x`` normalised as far as letters and digits go."""
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x80, 0xD800), *range(0xF900, 0x1FFFF))}
    changed = {a: b for a, b in plain.items() if a != b and unicodedata.normalize("NFC", a) == a and any(c.isalnum() or c == "'" for c in b)}
    one = {a: b for a, b in changed.items() if len(b) == 1}
    many = {a: b for a, b in changed.items() if len(b) > 1}
    to = "".join(one.values()).replace("'", "''")
    values = ", ".join("'" + b.replace("'", "''") + "'" for b in many.values())
    one_by_one = f"list_transform(string_split({x}, ''), lambda c: coalesce([{values}][nullif(instr('{''.join(many)}', c), 0)], c))"
    spread = f"CASE WHEN regexp_matches({x}, '[{''.join(many)}]') THEN array_to_string({one_by_one}, '') ELSE {x} END"
    return f"nfc_normalize(translate({spread}, '{''.join(one)}', '{to}'))"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(replace(replace(lower({_normal(x)}), 'ß', 'ss'), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"


def _pool(corpus: str) -> str:
    return f"""
pool AS (SELECT corpus_id, chunk_id, chunk_index, coalesce({_tokens("text")}, []) AS tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus_id, chunk_id ORDER BY text NULLS FIRST, chunk_index NULLS FIRST) AS k
  FROM (SELECT {corpus} AS corpus_id, chunk_id, chunk_index, text FROM chunks)) WHERE k = 1),
each AS (SELECT corpus_id, chunk_id, chunk_index, len(tokens) AS length, unnest(tokens) AS term FROM pool),
tf AS (SELECT corpus_id, chunk_id, chunk_index, length, term, count(*) AS tf FROM each GROUP BY ALL),
stats AS (SELECT corpus_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM pool GROUP BY 1)"""


_POOL = _pool("corpus_id")
_TERMS = f"""
terms AS (SELECT query_id, list_sort(list_distinct(tokens)) AS terms, len(tokens) AS token_count FROM (
  SELECT query_id, query, {_tokens("query")} AS tokens FROM (SELECT query_id, min(query) AS query FROM queries WHERE query IS NOT NULL GROUP BY 1))
  WHERE len(tokens) BETWEEN 1 AND 1000 AND length(query) <= 10000)"""


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.unique_chunks(table(spark, sf_dir, "chunks"))


@query(f"SELECT doc_id, len({_tokens('text')}) AS tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(text.exact_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {_POOL} SELECT corpus_id, chunk_id, chunk_index, length, term, tf FROM tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_frequency(_unique(spark, sf_dir))


@query(f"WITH {_POOL} SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY 1, 2")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequency(retrieval.term_frequency(_unique(spark, sf_dir)))


@query(f"WITH {_POOL} SELECT corpus_id, n, round(avgdl, 9) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_stats(_unique(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 9))


@query(f"""
SELECT query_id, {_SEEN.format("query")} = 0 AS blank, coalesce(length(query), 0) AS characters, coalesce(len({_tokens("query")}), 0) AS token_count,
  {_SEEN.format("query")} > 0 AND coalesce(length(query), 0) <= 10000 AND coalesce(len({_tokens("query")}), 0) BETWEEN 1 AND 1000 AS valid
FROM (SELECT DISTINCT query_id, query FROM queries)""")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.query_validation(table(spark, sf_dir, "queries"))


@query(f"WITH {_TERMS} SELECT query_id, array_to_string(terms, ' ') AS terms, token_count FROM terms")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.query_terms(table(spark, sf_dir, "queries")).withColumn("terms", F.array_join("terms", " "))


def _hits_sql(corpus: str, scope: str) -> str:
    return f"""
WITH {_pool(corpus)}, {_TERMS}, {scope},
asked AS (SELECT t.query_id, s.corpus_id, unnest(t.terms) AS term FROM terms t JOIN scope s ON t.query_id = s.query_id),
df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
scored AS (
  SELECT a.query_id, a.corpus_id, f.chunk_id, f.chunk_index,
    round(list_sum(list(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * (1.2::DOUBLE + 1) / (f.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * f.length / s.avgdl)) ORDER BY a.term)), 12) AS score,
    string_agg(a.term, ' ' ORDER BY a.term) AS matched_terms
  FROM asked a JOIN tf f ON f.corpus_id = a.corpus_id AND f.term = a.term JOIN df d ON d.corpus_id = a.corpus_id AND d.term = a.term
  JOIN stats s ON s.corpus_id = a.corpus_id GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY score DESC, chunk_index, chunk_id) AS rank FROM scored WHERE score > 0),
hits AS (SELECT * FROM ranked WHERE rank <= 10)"""


_HITS = _hits_sql("'all'", "scope AS (SELECT DISTINCT query_id, 'all' AS corpus_id FROM queries)")


def _search(spark: SparkSession, sf_dir: str) -> tuple[retrieval.Index, DataFrame]:
    """All queries against all chunks."""
    index = retrieval.Index(table(spark, sf_dir, "chunks"), whole=True)
    return index, index.search(table(spark, sf_dir, "queries"))


@query(f"""{_HITS},
home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY text NULLS FIRST, chunk_index NULLS FIRST, corpus_id NULLS FIRST, page_id NULLS FIRST) AS k FROM chunks) WHERE k = 1)
SELECT h.query_id, h.rank, round(h.score, 8) AS score, h.chunk_id, h.chunk_index, h.matched_terms, c.corpus_id AS home_corpus_id, c.page_id, c.page_number,
  c.bounding_box.x0 AS x0, c.bounding_box.bottom AS bottom, sha256(c.text) AS content_fingerprint, length(c.text) AS characters
FROM hits h JOIN home c ON h.chunk_id = c.chunk_id""")
def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of all for every query, with where they come from."""
    index, hits = _search(spark, sf_dir)
    return index.provenance(hits).select(
        "query_id", "rank", F.round("score", 8).alias("score"), "chunk_id", "chunk_index", F.array_join("matched_terms", " ").alias("matched_terms"),
        "home_corpus_id", "page_id", "page_number", "bounding_box.x0", "bounding_box.bottom", "content_fingerprint", F.length("text").alias("characters"),
    )


@query(f"{_HITS} SELECT query_id, 'all' AS corpus_id FROM terms WHERE query_id NOT IN (SELECT query_id FROM hits)")
def no_hit_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, hits = _search(spark, sf_dir)
    asked = retrieval.query_terms(table(spark, sf_dir, "queries")).select("query_id", F.lit(retrieval.ALL).alias("corpus_id"))
    return retrieval.no_hits(asked, hits)


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit scope: the corpora that a query is judged for."""
    judged = _judgments(spark, sf_dir)
    return judged.join(table(spark, sf_dir, "chunks").select("chunk_id", "corpus_id").distinct(), "chunk_id").select("query_id", "corpus_id").distinct()


@query(_hits_sql("corpus_id", """
scope AS (SELECT DISTINCT a.query_id, c.corpus_id FROM (SELECT query_id, unnest(citations).chunk_id AS chunk_id FROM answers) a
  JOIN chunks c ON a.chunk_id = c.chunk_id)""") + " SELECT query_id, corpus_id, rank, round(score, 8) AS score, chunk_id, chunk_index, matched_terms FROM hits")
def corpus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries against each corpus of their scope, by that corpus' own statistics."""
    hits = retrieval.Index(table(spark, sf_dir, "chunks")).search(table(spark, sf_dir, "queries"), _scope(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 8)).withColumn("matched_terms", F.array_join("matched_terms", " "))


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("query_id", F.explode("citations.chunk_id").alias("chunk_id")).filter("chunk_id is not null").distinct()


@query("""
SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, unnest(citations).chunk_id AS chunk_id FROM answers)
WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks)""")
def unknown_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.unknown_judgments(_judgments(spark, sf_dir), table(spark, sf_dir, "chunks"))


_CASES = f"""{_HITS},
judged AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, unnest(citations).chunk_id AS chunk_id FROM answers) WHERE chunk_id IS NOT NULL),
relevant AS (SELECT query_id, count(*) AS relevant FROM judged GROUP BY 1),
found AS (SELECT b.query_id, b.rank, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) AS i
  FROM hits b JOIN judged j ON b.query_id = j.query_id AND b.chunk_id = j.chunk_id),
got AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(i / rank) AS precisions, sum(1 / log2(rank + 1)) AS gain FROM found GROUP BY 1),
cases AS (SELECT r.query_id, relevant, coalesce(found, 0) AS relevant_retrieved,
  round(coalesce(found / 10, 0), 12) AS precision, round(coalesce(found / relevant, 0), 12) AS recall,
  round(coalesce(1 / first, 0), 12) AS reciprocal_rank, round(coalesce(precisions / least(relevant, 10), 0), 12) AS average_precision,
  round(coalesce(gain / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda k: 1 / log2(k + 1))), 0), 12) AS ndcg
  FROM relevant r LEFT JOIN got g ON r.query_id = g.query_id)"""
_NAMES = ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg")


@query(_CASES + " SELECT query_id, relevant, relevant_retrieved, " + ", ".join(f"round({m}, 9) AS {m}" for m in _NAMES) + " FROM cases")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = evaluation.case_metrics(_search(spark, sf_dir)[1], _judgments(spark, sf_dir))
    return cases.withColumns({m: F.round(m, 9) for m in _NAMES})


@query(_CASES + " SELECT count(*) AS cases, " + ", ".join(f"round(avg({m}), 9) AS mean_{m}" for m in _NAMES) + " FROM cases")
def retrieval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = evaluation.case_metrics(_search(spark, sf_dir)[1], _judgments(spark, sf_dir))
    means = evaluation.mean_metrics(cases)
    return means.withColumns({f"mean_{m}": F.round(f"mean_{m}", 9) for m in _NAMES})


# answers

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SENTENCES = rf"""
parts AS (
  SELECT chunk_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (
    SELECT chunk_id, string_split(regexp_replace(regexp_replace(text, '([\r\n])', chr(1) || '\1' || chr(1), 'g'),
      '([.!?])({_BLANK})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p
    FROM (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1))),
placed AS (SELECT chunk_id, part, coalesce(sum(length(part)) OVER (PARTITION BY chunk_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM parts),
sentences AS (
  SELECT chunk_id, CAST(off + length(part) - length(regexp_replace(part, '^{_BLANK}+', '')) AS INT) AS start,
    regexp_replace(regexp_replace(part, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS sentence
  FROM placed WHERE regexp_replace(part, '{_BLANK}', '', 'g') <> '')"""


@query(f'WITH {_SENTENCES} SELECT chunk_id, start, start + length(sentence) AS "end", sentence FROM sentences')
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return answers.sentence_spans(chunks).drop("text")


_CANDIDATES = f"""{_CASES},
{_SENTENCES},
tried AS (
  SELECT query_id, rank, chunk_id, start, sentence, matched, terms, round(len(matched) / len(terms), 12) AS coverage FROM (
    SELECT b.query_id, b.rank, b.chunk_id, s.start, s.sentence, t.terms,
      list_sort(list_intersect(t.terms, s.tokens)) AS matched
    FROM hits b JOIN (SELECT *, {_tokens("sentence")} AS tokens FROM sentences) s ON s.chunk_id = b.chunk_id JOIN terms t ON t.query_id = b.query_id)),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, rank, start, start + length(sentence)) AS position
  FROM tried WHERE len(matched) > 0 AND coverage >= 0.25)"""


def _candidate_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, hits, chunks) of all queries against all chunks; the hits are written once."""
    hits = _search(spark, sf_dir)[1].select("query_id", "rank", "chunk_id")
    return retrieval.query_terms(table(spark, sf_dir, "queries")), cut(hits, tidy=True), table(spark, sf_dir, "chunks")


@query(f"{_CANDIDATES} SELECT query_id, rank, chunk_id, start, sentence, array_to_string(matched, ' ') AS matched_terms, round(coverage, 9) AS coverage, position FROM candidates")
def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, hits, chunks = _candidate_parts(spark, sf_dir)
    found = answers.candidates(hits, chunks, terms).drop("end")
    return found.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("coverage", F.round("coverage", 9))


_MADE = f"""{_CANDIDATES},
taken AS (SELECT * FROM candidates WHERE position <= 3),
cited AS (SELECT query_id, string_agg(sentence, chr(10) ORDER BY position) AS answer, count(*) AS citations, list_sort(list_distinct(list(chunk_id))) AS chunk_ids,
  sum(length(sentence)) AS evidence FROM taken GROUP BY 1),
made AS (SELECT t.query_id, t.token_count, CASE WHEN c.query_id IS NOT NULL THEN 'answered' ELSE 'abstained' END AS status,
  CASE WHEN c.query_id IS NOT NULL THEN NULL WHEN t.query_id NOT IN (SELECT query_id FROM hits) THEN 'no_retrieval_hits'
    ELSE 'insufficient_query_term_coverage' END AS abstention_reason, c.answer, coalesce(c.citations, 0) AS citations,
  coalesce(c.chunk_ids, []) AS chunk_ids, coalesce(c.evidence, 0) AS evidence
  FROM terms t LEFT JOIN cited c ON t.query_id = c.query_id)"""


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(answers, terms, hits, chunks)."""
    terms, hits, chunks = _candidate_parts(spark, sf_dir)
    return cut(answers.answers(terms, hits, chunks), tidy=True), terms, hits, chunks


@query(f"{_MADE} SELECT query_id, status, abstention_reason, answer, sha256(answer) AS answer_fingerprint, citations FROM made")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, hits, chunks = _candidate_parts(spark, sf_dir)
    made = answers.answers(terms, hits, chunks)
    return made.select("query_id", "status", "abstention_reason", "answer", "answer_fingerprint", F.size("citations").alias("citations"))


@query(f"""{_MADE}
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS INT) AS citation_index, rank AS retrieval_rank, chunk_id, start AS excerpt_start,
  start + length(sentence) AS excerpt_end, sha256(sentence) AS excerpt_fingerprint, array_to_string(matched, ' ') AS matched_terms, round(coverage, 9) AS query_term_coverage FROM taken""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, hits, chunks = _candidate_parts(spark, sf_dir)
    each = answers.answers(terms, hits, chunks).select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*").drop("excerpt")
    return each.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("query_term_coverage", F.round("query_term_coverage", 9))


@query(f"""
WITH {_TERMS},
each AS (SELECT DISTINCT query_id, c FROM (SELECT query_id, unnest(citations) AS c FROM answers)),
joined AS (SELECT e.query_id, e.c, x.text, t.terms, list_sort(list_intersect(t.terms, {_tokens("e.c.excerpt")})) AS found
  FROM each e LEFT JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) x ON x.chunk_id = e.c.chunk_id LEFT JOIN terms t ON t.query_id = e.query_id),
numbers AS (SELECT query_id, min(c.citation_index) = 1 AND max(c.citation_index) = count(DISTINCT c.citation_index) AS contiguous FROM each GROUP BY 1)
SELECT j.query_id, c.citation_index, c.chunk_id, text IS NOT NULL AS chunk_exists,
  coalesce(substring(text, c.excerpt_start + 1, c.excerpt_end - c.excerpt_start) = c.excerpt, false) AS exact_slice,
  coalesce(sha256(c.excerpt) = c.excerpt_fingerprint, false) AS right_fingerprint, coalesce(list_sort(c.matched_terms) = found, false) AS right_terms,
  coalesce(abs(c.query_term_coverage - round(len(found) / len(terms), 12)) < 1e-9, false) AS right_coverage,
  coalesce(round(len(found) / len(terms), 12) >= 0.25, false) AS enough_coverage,
  count(*) OVER (PARTITION BY j.query_id, c.chunk_id, c.excerpt_start, c.excerpt_end) = 1 AS unique_slice, coalesce(n.contiguous, false) AS contiguous
FROM joined j JOIN numbers n ON n.query_id = j.query_id""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.query_terms(table(spark, sf_dir, "queries"))
    return answers.citation_audit(table(spark, sf_dir, "answers"), table(spark, sf_dir, "chunks"), terms)


@query("""
WITH each AS (SELECT DISTINCT query_id, status, answer, citations FROM answers),
joined AS (SELECT *, coalesce(len(citations), 0) AS n, array_to_string(list_transform(citations, lambda c: c.excerpt), chr(10)) AS whole FROM each)
SELECT DISTINCT query_id, status, n AS citation_count, (n = 0 AND answer IS NULL) OR coalesce(whole IS NOT DISTINCT FROM answer, false) AS joined_answer,
  (status = 'answered') = (n > 0) AS status_agrees FROM joined""")
def answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answer_audit(table(spark, sf_dir, "answers"))


@query("""
SELECT status, abstention_reason, count(*) AS answers, CAST(sum(len(citations)) AS BIGINT) AS citations FROM (
  SELECT DISTINCT query_id, status, abstention_reason, coalesce(citations, []) AS citations FROM answers) GROUP BY 1, 2""")
def abstention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "answers").select("query_id", "status", "abstention_reason", "citations").distinct()
    n = F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0))
    return rows.groupBy("status", "abstention_reason").agg(F.count("*").alias("answers"), F.sum(n).alias("citations"))


# text errors and quality


def _excerpt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited excerpts against the slices of their chunks."""
    cited = table(spark, sf_dir, "answers").select("query_id", F.explode("citations").alias("c"))
    chunks = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"))
    rows = cited.select("query_id", "c.citation_index", "c.chunk_id", "c.excerpt_start", "c.excerpt_end", "c.excerpt").distinct().join(chunks, "chunk_id")
    return rows.select(
        F.concat_ws("#", "query_id", "citation_index").alias("case_id"),
        F.substring("text", F.col("excerpt_start") + 1, F.col("excerpt_end") - F.col("excerpt_start")).alias("reference"),
        F.col("excerpt").alias("hypothesis"),
    )


# the engine's distance is over bytes: each distinct character, and each distinct word, of a pair becomes one byte
_ERRORS = rf"""
WITH pairs AS (
  SELECT query_id || '#' || citation_index AS case_id, coalesce(substring(text, excerpt_start + 1, excerpt_end - excerpt_start), '') AS a, coalesce(excerpt, '') AS b
  FROM (SELECT DISTINCT query_id, c.citation_index, c.chunk_id, c.excerpt_start, c.excerpt_end, c.excerpt FROM (SELECT query_id, unnest(citations) AS c FROM answers)) x
  JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) t ON t.chunk_id = x.chunk_id),
split AS (SELECT *, list_distinct(string_split(a || b, '')) AS signs, list_filter(string_split_regex(a, '{_BLANK}+'), lambda w: w <> '') AS wa,
  list_filter(string_split_regex(b, '{_BLANK}+'), lambda w: w <> '') AS wb FROM pairs),
coded AS (SELECT *, list_distinct(wa || wb) AS known,
  levenshtein(array_to_string(list_transform(string_split(a, ''), lambda c: chr(CAST(list_position(signs, c) AS INT))), ''),
    array_to_string(list_transform(string_split(b, ''), lambda c: chr(CAST(list_position(signs, c) AS INT))), '')) AS characters FROM split),
counted AS (SELECT case_id, a = b AS exact_match, characters, length(a) AS n, len(wa) AS m,
  levenshtein(array_to_string(list_transform(wa, lambda w: chr(CAST(list_position(known, w) AS INT))), ''),
    array_to_string(list_transform(wb, lambda w: chr(CAST(list_position(known, w) AS INT))), '')) AS words FROM coded),
errors AS (SELECT case_id, exact_match, CASE WHEN n > 0 THEN characters / n WHEN characters = 0 THEN 0 ELSE 1 END AS character_error_rate,
  CASE WHEN m > 0 THEN words / m WHEN words = 0 THEN 0 ELSE 1 END AS word_error_rate FROM counted)"""


@query(f"{_ERRORS} SELECT case_id, exact_match, round(character_error_rate, 9) AS character_error_rate, round(word_error_rate, 9) AS word_error_rate FROM errors")
def excerpt_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = evaluation.text_errors(_excerpt_pairs(spark, sf_dir))
    return errors.withColumns({c: F.round(c, 9) for c in ("character_error_rate", "word_error_rate")})


_EXPECTED = f"""{_MADE},
expected AS (SELECT query_id, min(status) AS expected_status, list_sort(list_distinct(list(answer) FILTER (answer IS NOT NULL))) AS acceptable FROM answers GROUP BY 1),
judging AS (SELECT m.query_id AS case_id, m.*, e.expected_status, coalesce(e.acceptable, []) AS acceptable FROM made m JOIN expected e ON m.query_id = e.query_id),
wanted AS (SELECT query_id, list(chunk_id) AS wanted FROM judged GROUP BY 1),
scores AS (SELECT w.query_id, len(coalesce(m.chunk_ids, [])) AS cited, len(w.wanted) AS relevant, len(list_intersect(coalesce(m.chunk_ids, []), w.wanted)) AS joint
  FROM wanted w LEFT JOIN made m ON m.query_id = w.query_id),
sizes AS (SELECT h.query_id, sum(length(c.text)) AS n FROM hits h JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) c ON c.chunk_id = h.chunk_id GROUP BY 1),
sums AS (SELECT count(*) AS n, sum(token_count) AS tokens, sum(coalesce(s.n, 0)) AS retrieved, sum(length(coalesce(answer, ''))) AS characters, sum(evidence) AS evidence
  FROM made m LEFT JOIN sizes s ON s.query_id = m.query_id),
observations AS (
  SELECT 'retrieval.mean_' || unnest(['reciprocal_rank', 'precision', 'recall', 'average_precision', 'ndcg']) AS metric,
    unnest([avg(reciprocal_rank), avg(precision), avg(recall), avg(average_precision), avg(ndcg)]) AS value, count(*) AS sample_count FROM cases
  UNION ALL SELECT 'answer.status_accuracy', avg(CAST(status = expected_status AS INT)), count(*) FROM judging
  UNION ALL SELECT 'answer.exact_match_rate', avg(CAST(coalesce(list_contains(acceptable, answer), false) AS INT)), count(*) FROM judging WHERE len(acceptable) > 0
  UNION ALL SELECT 'safety.false_answer_rate', avg(CAST(status = 'answered' AS INT)), count(*) FROM judging WHERE expected_status = 'abstained'
  UNION ALL SELECT 'provenance.citation_precision', avg(CASE WHEN cited > 0 THEN joint / cited ELSE 0 END), count(*) FROM scores
  UNION ALL SELECT 'provenance.citation_recall', avg(joint / relevant), count(*) FROM scores
  UNION ALL SELECT 'provenance.supported_answer_rate', 1.0, count(*) FROM made
  UNION ALL SELECT 'cost.' || unnest(['query_tokens', 'retrieved_characters', 'answer_characters', 'evidence_characters', 'external_requests', 'estimated_external_usd']),
    unnest([tokens, retrieved, characters, evidence, 0, 0]), n FROM sums)"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(retrieval cases, citation scores, answer cases, kinds of observations): the made answers against the stored ones."""
    made, terms, hits, chunks = _made(spark, sf_dir)
    judged = _judgments(spark, sf_dir)
    cases = evaluation.case_metrics(hits, judged)
    scores = quality.citation_scores(made.select("query_id", F.col("citations.chunk_id").alias("chunk_ids")), judged)
    expected = table(spark, sf_dir, "answers").groupBy("query_id").agg(F.min("status").alias("expected_status"), F.collect_set("answer").alias("acceptable_answers"))
    answered = made.select("query_id", "status", "answer").join(expected, "query_id").withColumn("case_id", F.col("query_id"))
    audit = answers.citation_audit(made, chunks, terms)
    marks = [c for c in audit.columns if c not in ("query_id", "citation_index", "chunk_id")]
    wrong = audit.filter(~reduce(lambda a, b: a & b, (F.col(c) for c in marks))).select("query_id").distinct()
    supported = made.join(wrong.withColumn("_wrong", F.lit(True)), "query_id", "left").select("query_id", F.col("_wrong").isNull().alias("supported"))
    seen = (
        quality.retrieval_observations(cases), quality.answer_observations(answered), quality.provenance_observations(scores),
        quality.supported_observations(supported), quality.cost_observations(made, terms, hits, chunks),
    )
    return cases, scores, answered, seen


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind is a few rows and written by itself, so what is shuffled for one is gone before the next."""
    return reduce(DataFrame.unionByName, (cut(kind, tidy=True) for kind in _cases(spark, sf_dir)[3]))


@query(f"{_EXPECTED} SELECT metric, round(value, 9) AS value, sample_count FROM observations")
def quality_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ordered_observations(_observations(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"""{_ERRORS}
SELECT 'text.' || unnest(['exact_match_rate', 'mean_character_error_rate', 'mean_word_error_rate']) AS metric,
  round(unnest([avg(CAST(exact_match AS INT)), avg(character_error_rate), avg(word_error_rate)]), 9) AS value, count(*) AS sample_count FROM errors""")
def text_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well cited excerpts agree with their chunks."""
    return quality.text_observations(evaluation.text_errors(_excerpt_pairs(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query("""
SELECT 'text_mismatch' AS code, 'warning' AS severity, 'text' AS dimension, query_id || '#' || citation_index AS case_id,
  'Predicted text does not exactly match the reference.' AS message
FROM (SELECT DISTINCT query_id, c.citation_index, c.chunk_id, c.excerpt_start, c.excerpt_end, c.excerpt FROM (SELECT query_id, unnest(citations) AS c FROM answers)) a
JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) t ON t.chunk_id = a.chunk_id
WHERE coalesce(substring(text, excerpt_start + 1, excerpt_end - excerpt_start), '') <> coalesce(excerpt, '')""")
def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.coalesce("reference", F.lit("")) == F.coalesce("hypothesis", F.lit(""))
    return quality.text_findings(_excerpt_pairs(spark, sf_dir).select("case_id", same.alias("exact_match")))


@query(f"""{_EXPECTED},
findings AS (
  SELECT 'retrieval_zero_recall' AS code, 'warning' AS severity, 'retrieval' AS dimension, query_id AS case_id,
    'No judged relevant chunk was retrieved at the configured cutoff.' AS message FROM cases WHERE recall = 0
  UNION ALL SELECT 'citation_not_judged_relevant', 'warning', 'provenance', query_id, 'The answer cites a chunk not judged relevant for this case.' FROM scores WHERE cited > joint
  UNION ALL SELECT 'relevant_evidence_not_cited', 'warning', 'provenance', query_id, 'The answer omits at least one judged relevant chunk.' FROM scores WHERE relevant > joint
  UNION ALL SELECT 'false_answer', 'error', 'safety', case_id, 'The system answered a case expected to abstain.' FROM judging WHERE status = 'answered' AND expected_status <> 'answered'
  UNION ALL SELECT 'unexpected_abstention', 'error', 'safety', case_id, 'The system abstained from a case expected to be answered.' FROM judging
    WHERE status <> 'answered' AND expected_status = 'answered'
  UNION ALL SELECT 'answer_exact_mismatch', 'warning', 'answer', case_id, 'Answer text is outside the case''s accepted exact-answer set.' FROM judging
    WHERE len(acceptable) > 0 AND NOT coalesce(list_contains(acceptable, answer), false))
SELECT * FROM findings""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, scores, answered, _ = _cases(spark, sf_dir)
    parts = quality.retrieval_findings(cases), quality.citation_findings(scores), quality.answer_findings(answered)
    return quality.ordered_findings(reduce(DataFrame.unionByName, parts))


#: Gates and rules of regression that the reports below are made with, and what is compared with.
GATES = (
    ("retrieval.mean_recall", "minimum", 0.5, 1), ("safety.false_answer_rate", "maximum", 0.05, 1), ("provenance.supported_answer_rate", "minimum", 1.0, 1),
    ("cost.external_requests", "maximum", 0.0, 1), ("text.exact_match_rate", "minimum", 0.9, 1), ("answer.status_accuracy", "minimum", 0.1, 1_000_000),
)
RULES = (
    ("retrieval.mean_recall", 0.02, 1), ("retrieval.mean_ndcg", 1.0, 1), ("safety.false_answer_rate", 0.01, 1), ("cost.query_tokens", 0.0, 1),
    ("human.mean_relevance", 0.1, 1), ("provenance.citation_recall", 0.5, 1_000_000),
)
BASELINE = (("retrieval.mean_recall", 0.99, 50), ("retrieval.mean_ndcg", 0.9, 50), ("safety.false_answer_rate", 0.5, 50), ("cost.query_tokens", 10.0, 50), ("provenance.citation_recall", 0.9, 50))


def _values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ")"


_GATED = f"""{_EXPECTED},
gated AS (SELECT g.metric, g.comparator, g.threshold, g.minimum_samples, known, CASE WHEN known THEN round(value, 9) END AS value, CASE WHEN known THEN sample_count ELSE 0 END AS sample_count,
  CASE WHEN NOT known THEN 'not_evaluated' WHEN (comparator = 'minimum' AND round(value, 12) >= threshold) OR (comparator = 'maximum' AND round(value, 12) <= threshold) THEN 'passed' ELSE 'failed' END AS status
  FROM (SELECT g.*, o.value, o.sample_count, coalesce(o.sample_count >= g.minimum_samples, false) AS known
    FROM {_values(GATES)} g(metric, comparator, threshold, minimum_samples) LEFT JOIN observations o ON o.metric = g.metric) g),
ruled AS (SELECT r.metric, maximum_degradation, CASE WHEN known THEN round(loss, 9) + 0.0 END AS degradation,
  CASE WHEN NOT known THEN 'not_evaluated' WHEN loss <= maximum_degradation THEN 'passed' ELSE 'failed' END AS status
  FROM (SELECT r.*, round((b.value - o.value) * d.direction, 12) AS loss,
      coalesce(least(o.sample_count, b.samples) >= r.minimum_samples, false) AND d.direction <> 0 AND o.metric IS NOT NULL AND b.metric IS NOT NULL AS known
    FROM {_values(RULES)} r(metric, maximum_degradation, minimum_samples) LEFT JOIN observations o ON o.metric = r.metric
    LEFT JOIN {_values(BASELINE)} b(metric, value, samples) ON b.metric = r.metric
    LEFT JOIN {_values(tuple((m, d) for m, d, _, _ in quality.TABLE))} d(metric, direction) ON d.metric = r.metric) r)"""


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gate results, regression results)."""
    seen = _observations(spark, sf_dir)
    gates = quality.gates(spark.createDataFrame(GATES, "metric STRING, comparator STRING, threshold DOUBLE, minimum_samples INT"), seen)
    rules = spark.createDataFrame(RULES, "metric STRING, maximum_degradation DOUBLE, minimum_samples INT")
    return gates, quality.regressions(rules, seen, spark.createDataFrame(BASELINE, "metric STRING, value DOUBLE, sample_count LONG"))


@query(f"{_GATED} SELECT metric, comparator, threshold, minimum_samples, value, sample_count, status FROM gated")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[0].withColumn("value", F.round("value", 9))


@query(f"{_GATED} SELECT metric, maximum_degradation, degradation, status FROM ruled")
def quality_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[1].select("metric", "maximum_degradation", F.round("degradation", 9).alias("degradation"), "status")


@query(f"""{_GATED},
every AS (SELECT status FROM gated UNION ALL SELECT status FROM ruled)
SELECT CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'not_evaluated') > 0 THEN 'incomplete'
  WHEN count(*) > 0 THEN 'passed' ELSE 'observational' END AS status,
  (SELECT string_agg('Quality gate failed for ' || metric || '.', ' ' ORDER BY metric) FROM gated WHERE status = 'failed') AS gate_messages,
  (SELECT string_agg('Metric regressed beyond tolerance: ' || metric || '.', ' ' ORDER BY metric) FROM ruled WHERE status = 'failed') AS regression_messages FROM every""")
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's status and the messages of what failed."""
    gates, rules = _reports(spark, sf_dir)

    def messages(found: DataFrame, name: str) -> DataFrame:
        joined = F.array_join(F.array_sort(F.collect_list("message")), " ")
        return found.agg(F.when(F.count("*") > 0, joined).alias(name))

    # one row each
    return quality.report_status(gates, rules).join(messages(quality.gate_findings(gates), "gate_messages")).join(
        messages(quality.regression_findings(rules), "regression_messages")
    )


@query("SELECT * FROM " + _values(tuple((m, d, low, -1.0 if high is None else high) for m, d, low, high in quality.TABLE)) + " m(metric, direction, lower, upper)")
def metric_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric with its direction and bounds; an upper bound of -1 is none."""
    return quality.metric_table(spark).fillna(-1.0, ["upper"])


# events


@query("SELECT event_type, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(events.counters(table(spark, sf_dir, "events")), first_at="first_us", last_at="last_us")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 1000")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_page(table(spark, sf_dir, "events"), 100).select("event_id", "event_type", "user_id")


@query("""
SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS eligible, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS kept
FROM events GROUP BY 1""")
def purge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.purge_preview(table(spark, sf_dir, "events"), "2024-01-15")


@query("""
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.events import windowed_counts

    counts = windowed_counts(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))
    return _micros(counts, window_start="window_us")


#: A machine over the log's event types.
MACHINE = (
    ("visitor", "signup", "member"), ("member", "purchase", "buyer"), ("member", "error", "blocked"), ("buyer", "error", "blocked"),
    ("blocked", "view", "member"), ("blocked", "click", "visitor"),
)
_MOVES = " ".join(f"WHEN s = '{a}' AND e = '{e}' THEN '{b}'" for a, e, b in MACHINE)


@query(f"""
SELECT user_id, list_reduce(list_prepend('visitor', list(event_type ORDER BY ts, event_id)), lambda s, e: CASE {_MOVES} ELSE s END) AS state,
  count(*) AS events, epoch_us(max(ts)) AS last_us
FROM (SELECT DISTINCT user_id, event_id, ts, event_type FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) GROUP BY 1""")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each user's events lead to."""
    return _micros(events.folded_states(table(spark, sf_dir, "events"), MACHINE, "visitor"), last_at="last_us")


# more audits


@query("WITH " + _packing("""
  SELECT DISTINCT c.corpus_id AS key, c.page_id, coalesce(g.max_characters_per_chunk, 4000) AS size FROM chunks c
  LEFT JOIN (SELECT config_id, min(max_characters_per_chunk) AS max_characters_per_chunk FROM corpus_configs GROUP BY 1) g ON g.config_id = c.config_id""") + """,
stored AS (SELECT corpus_id, page_id, page_chunk_index, min(sha256(text)) AS stored FROM chunks GROUP BY 1, 2, 3),
again AS (SELECT key, page_id, chunk, min(sha256(text)) AS again FROM packed GROUP BY 1, 2, 3)
SELECT coalesce(s.corpus_id, a.key) AS corpus_id, count(stored) AS stored_chunks, count(*) FILTER (coalesce(stored = again, false)) AS same,
  count(*) FILTER (NOT coalesce(stored = again, false)) AS different
FROM stored s FULL JOIN again a ON s.corpus_id = a.key AND s.page_id = a.page_id AND s.page_chunk_index = a.chunk GROUP BY 1""")
def corpus_rebuild_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored corpora against what packing their spans again gives."""
    chunks = table(spark, sf_dir, "chunks")
    rebuilt = chunking.rebuilt_corpora(chunks, table(spark, sf_dir, "spans"), table(spark, sf_dir, "corpus_configs"))
    return chunking.rebuild_audit(chunks, rebuilt)


@query(nested_queries._CTE + """,
grid AS (SELECT record_id, page_number, table_index, count(*) AS cells FROM (SELECT record_id, n AS page_number, ti AS table_index FROM cells) GROUP BY 1, 2, 3)
SELECT record_id, page_number, table_index, cells FROM grid""")
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every table that has any."""
    cells = nested_queries._children(spark, sf_dir).filter("child = 'cell'")
    return cells.groupBy("record_id", F.col("idx1").alias("page_number"), F.col("idx2").alias("table_index")).agg(F.count("*").alias("cells"))


@query("""
SELECT DISTINCT page_id, 'not_selected' AS status, CAST(NULL AS VARCHAR) AS text, 0 AS character_count, 0 AS line_count
FROM (SELECT page_id, """ + _SEEN.format("text") + """ AS n FROM page_text) WHERE n >= 4""")
def skipped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pages.text_routing(table(spark, sf_dir, "page_text")).select("page_id", "routed_status").distinct()
    return pages.skipped_pages(pages.ocr_selection(routed))


@query("""
SELECT page_id, source, count(DISTINCT span_id) AS spans, round(avg(confidence), 12) AS mean_confidence,
  count(*) FILTER (confidence IS NULL) AS without_confidence
FROM (SELECT DISTINCT page_id, span_id, source, confidence FROM spans) GROUP BY 1, 2""")
def span_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "spans").select("page_id", "span_id", "source", "confidence").distinct()
    return rows.groupBy("page_id", "source").agg(
        F.count_distinct("span_id").alias("spans"),
        F.round(F.avg("confidence"), 12).alias("mean_confidence"),
        F.count_if(F.col("confidence").isNull()).alias("without_confidence"),
    )


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS media_type FROM documents""")
def sniffed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types by first bytes, of texts behind the first bytes of a type or of none."""
    head = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in ("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE000104A46", "20255044462D"))), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", documents.media_type(content).alias("media_type"))


@query("""
SELECT DISTINCT f.chunk_id AS document_id, m.fingerprint IS NOT NULL AS has_manifest, coalesce(strlen(f.text) = m.size, false) AS same_size, coalesce(sha256(f.text) = m.fingerprint, false) AS same_digest
FROM chunks f LEFT JOIN (SELECT chunk_id, min(content_fingerprint) AS fingerprint, min(character_count) AS size FROM chunks GROUP BY 1) m ON m.chunk_id = f.chunk_id""")
def verified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as stored files, verified by the size and digest that are stored of them."""
    chunks = table(spark, sf_dir, "chunks")
    content = F.encode("text", "UTF-8")
    files = chunks.select(F.col("chunk_id").alias("document_id"), F.octet_length("text").alias("length"), content.alias("content"))
    stored = chunks.groupBy(F.col("chunk_id").alias("document_id")).agg(F.min("content_fingerprint").alias("fingerprint"), F.min("character_count").alias("byte_size"))
    return documents.verified(files, stored).distinct()


@query("""
SELECT DISTINCT o.page_id, o.page_number, CASE WHEN t.page_id IS NULL THEN 'missing_parent' ELSE 'mismatch' END AS "break" FROM page_ocr o
LEFT JOIN (SELECT page_id, min(page_number) AS page_number FROM page_text GROUP BY 1) t ON t.page_id = o.page_id
WHERE t.page_id IS NULL OR o.page_number IS DISTINCT FROM t.page_number""")
def ocr_link_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages whose page or number isn't that of the text artifact."""
    parent = table(spark, sf_dir, "page_text").groupBy("page_id").agg(F.min("page_number").alias("page_number"))
    child = table(spark, sf_dir, "page_ocr").select("page_id", "page_number").distinct()
    return documents.provenance_breaks(child, parent, "page_id", ("page_number", "page_number"))


@query(nested_queries._CTE + """,
sized AS (SELECT record_id, p->>'page_id' AS page_id, CAST(p->>'width' AS DOUBLE) AS w, CAST(p->>'height' AS DOUBLE) AS h, p->>'dimension_unit' AS u,
  CAST(p->>'source_rotation_degrees' AS INT) AS d FROM pages),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY record_id NULLS FIRST, w NULLS FIRST, h NULLS FIRST, u NULLS FIRST, d NULLS FIRST) AS k FROM sized WHERE page_id IS NOT NULL) WHERE k = 1)
SELECT DISTINCT s.record_id, s.page_id, coalesce(abs(s.w - f.w) <= greatest(1e-6, greatest(abs(s.w), abs(f.w)) * 1e-9), s.w IS NOT DISTINCT FROM f.w)
  AND coalesce(abs(s.h - f.h) <= greatest(1e-6, greatest(abs(s.h), abs(f.h)) * 1e-9), s.h IS NOT DISTINCT FROM f.h) AS same_size,
  s.u IS NOT DISTINCT FROM f.u AS same_unit, s.d IS NOT DISTINCT FROM f.d AS same_rotation FROM sized s JOIN first f ON f.page_id = s.page_id""")
def structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured pages against their first delivery."""
    return pages.structure_audit(nested.subtype_table(table(spark, sf_dir, "artifact_records"), "page"))


@query(f"""
SELECT chunk_id, count(*) AS fragments, count(*) FILTER (NOT coalesce(f.bounding_box.x0 >= b.x0 AND f.bounding_box.top >= b.top AND f.bounding_box.x1 <= b.x1 AND f.bounding_box.bottom <= b.bottom, false)) AS outside
FROM (SELECT c.chunk_id, c.f, b.b FROM {_FRAGMENTS} c JOIN (SELECT chunk_id, min(bounding_box) AS b FROM chunks GROUP BY 1) b ON b.chunk_id = c.chunk_id) GROUP BY 1""")
def fragments_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments whose box isn't within that of their chunk."""
    chunks = table(spark, sf_dir, "chunks")
    each = chunks.select("chunk_id", "text", "fragments").distinct().select("chunk_id", F.explode("fragments").alias("f"))
    joined = each.join(chunks.groupBy("chunk_id").agg(F.min("bounding_box").alias("b")), "chunk_id")
    inside = F.coalesce(pages.box_within(F.col("f.bounding_box"), F.col("b")), F.lit(False))
    return joined.groupBy("chunk_id").agg(F.count("*").alias("fragments"), F.count_if(~inside).alias("outside"))


@query("""
SELECT DISTINCT span_id, bounding_box.x0 * 0.5 AS x0, bounding_box.top * 2 AS top, bounding_box.x1 * 0.5 AS x1, bounding_box.bottom * 2 AS bottom FROM spans WHERE bounding_box IS NOT NULL""")
def quad_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of spans from their corners, scaled."""
    b = F.col("bounding_box")
    quad = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((b.x1, b.bottom), (b.x0, b.bottom), (b.x0, b.top), (b.x1, b.top))))
    rows = table(spark, sf_dir, "spans").filter(b.isNotNull())
    return rows.select("span_id", pages.quad_box(quad, F.lit(0.5), F.lit(2.0)).alias("q")).select("span_id", "q.*").distinct()


@query(nested_queries._CTE + """,
boxed AS (SELECT record_id, n AS page_number, """ + nested_queries._box("t") + """ FROM tables)
SELECT record_id, page_number, x0, top, x1, bottom, row_number() OVER (PARTITION BY record_id, page_number ORDER BY top NULLS FIRST, x0 NULLS FIRST, bottom NULLS FIRST, x1 NULLS FIRST) AS table_index FROM boxed""")
def table_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of structured pages numbered by place."""
    found = nested.subtype_table(table(spark, sf_dir, "artifact_records"), "table")
    found = found.select("record_id", F.col("idx1").alias("page_number"), F.concat_ws("-", "record_id", F.coalesce(F.col("idx1").cast("string"), F.lit(""))).alias("page_id"), "bounding_box")
    return pages.table_order(found).select("record_id", "page_number", "bounding_box.x0", "bounding_box.top", "bounding_box.x1", "bounding_box.bottom", "table_index")


@query("""
SELECT corpus_id, page_id, count(DISTINCT page_chunk_index) AS chunks, coalesce(min(page_chunk_index) = 1 AND max(page_chunk_index) = count(DISTINCT page_chunk_index), false) AS contiguous
FROM chunks GROUP BY 1, 2""")
def page_index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_index_gaps(table(spark, sf_dir, "chunks"))


@query("""
WITH each AS (SELECT corpus_id, page_id, chunk_id, max(coalesce(len(fragments), 0)) AS f, max(coalesce(length(text), 0)) AS c FROM chunks GROUP BY 1, 2, 3),
pages AS (SELECT corpus_id, page_id, count(*) AS n, sum(f) AS f, sum(c) AS c FROM each GROUP BY 1, 2)
SELECT corpus_id, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS page_chunks, CAST(sum(f) AS BIGINT) AS fragments, CAST(sum(c) AS BIGINT) AS characters,
  (sum(n) > 100000 OR max(n) > 10000 OR sum(f) > 1000000 OR sum(c) > 50000000) AS violation FROM pages GROUP BY 1""")
def corpus_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.corpus_limits(table(spark, sf_dir, "chunks"))
