"""Queries that flatten the raw deliveries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..session import table


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "artifact_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir).select("record_id", "child", "idx1", "idx2", "idx3", "idx4")


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.variants(_children(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str, child: str) -> DataFrame:
    """A subtype table with its box in four columns and its terms as one string."""
    rows = nested.subtype_table(table(spark, sf_dir, "artifact_records"), child).drop("variant", "child")
    if "bounding_box" in rows.columns:
        for name in ("x0", "top", "x1", "bottom"):
            rows = rows.withColumn(name, F.col("bounding_box").getField(name))
        rows = rows.drop("bounding_box")
    if "matched_terms" in rows.columns:
        rows = rows.withColumn("matched_terms", F.array_join("matched_terms", " "))
    return rows


def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.rejects(table(spark, sf_dir, "artifact_records")).select("record_id", "reason", "child")


QUERIES = {"p4_found": p4_found, "p4_variants": p4_variants, "p4_rejects": p4_rejects}
for _child in nested.SUBTYPES:
    QUERIES[f"p4_{_child}s"] = lambda spark, sf_dir, c=_child: _typed(spark, sf_dir, c)

def _read(x: str) -> str:
    """A value that may be given as a string of JSON, once or twice encoded."""
    once = f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"
    return f"(SELECT CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN CAST(v->>'$' AS JSON) ELSE v END FROM (SELECT {once} AS v))"


def _list(x: str) -> str:
    return f"(SELECT CASE json_type(w) WHEN 'ARRAY' THEN CAST(w AS JSON[]) WHEN 'OBJECT' THEN [w] ELSE CAST([] AS JSON[]) END FROM (SELECT {_read(x)} AS w))"


def _each(keys: str, of: str, x: str, name: str) -> str:
    """Rows of ``of`` with the objects of the list ``x`` and their places."""
    return f"""SELECT {keys}, {name}, k FROM (
        SELECT {keys}, {_read(name)} AS {name}, k FROM (
            SELECT {keys}, unnest(l) AS {name}, generate_subscripts(l, 1) AS k FROM (SELECT {keys}, {_list(x)} AS l FROM {of})))
    WHERE json_type({name}) = 'OBJECT'"""


_CTE = f"""
WITH parsed AS (
    SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM artifact_records
),
given AS (SELECT record_id, {_read("j")} AS j FROM parsed),
roots AS (SELECT record_id, CASE WHEN json_type(a) = 'OBJECT' THEN a ELSE j END AS r FROM (SELECT record_id, j, {_read("(j->'artifact')")} AS a FROM given)),
pages AS (SELECT record_id, p, CAST(p->>'page_number' AS INT) AS n FROM ({_each("record_id", "roots", "(r->'pages')", "p")})),
spans AS ({_each("record_id, n, p", "pages", "(p->'spans')", "s")}),
tables AS (SELECT record_id, n, p, t, coalesce(CAST(t->>'table_index' AS INT), k) AS ti FROM ({_each("record_id, n, p", "pages", "(p->'tables')", "t")})),
cells AS ({_each("record_id, n, p, ti", "tables", "(t->'cells')", "c")}),
results AS (SELECT record_id, r, {_read("(r->'retrieval')")} AS q FROM roots),
hits AS ({_each("record_id", "results", "(q->'hits')", "h")}),
citations AS ({_each("record_id", "roots", "(r->'citations')", "c")})
"""

SQL = {
    "p4_found": _CTE
    + """
SELECT record_id, 'page' AS child, CAST(p->>'page_number' AS INT) AS idx1, 0 AS idx2, 0 AS idx3, 0 AS idx4 FROM pages
UNION ALL SELECT record_id, 'span', CAST(p->>'page_number' AS INT), CAST(s->>'span_index' AS INT), 0, 0 FROM spans
UNION ALL SELECT record_id, 'table', CAST(p->>'page_number' AS INT), ti, 0, 0 FROM tables
UNION ALL SELECT record_id, 'cell', CAST(p->>'page_number' AS INT), ti, CAST(c->>'row_index' AS INT), CAST(c->>'column_index' AS INT) FROM cells
UNION ALL SELECT record_id, 'hit', CAST(h->>'rank' AS INT), 0, 0, 0 FROM hits
UNION ALL SELECT record_id, 'citation', CAST(c->>'citation_index' AS INT), CAST(c->>'retrieval_rank' AS INT), 0, 0 FROM citations
""",
}


def _fields(of: str, **kinds: str) -> str:
    return ", ".join(f"CAST({of}->>'{name}' AS {kind}) AS {name}" for name, kind in kinds.items())


def _box(of: str) -> str:
    names = ("x0", "top", "x1", "bottom")
    return ", ".join(
        f"(SELECT CASE json_type(b) WHEN 'ARRAY' THEN CAST(b->>{k} AS DOUBLE) "
        f"WHEN 'OBJECT' THEN CAST(b->>'{name}' AS DOUBLE) END FROM (SELECT {_read(f"({of}->'bounding_box')")} AS b)) AS {name}"
        for k, name in enumerate(names)
    )


def _keys(idx: str, parent: str, up: str = "0, 0") -> str:
    own = [*idx.split(", "), "0", "0", "0", "0"][:4]
    above = up.split(", ")
    return ", ".join(
        ["record_id", *(f"{x} AS idx{k}" for k, x in enumerate(own, 1)), f"'{parent}' AS parent", *(f"{x} AS parent_idx{k}" for k, x in enumerate(above, 1))]
    )


def _terms(of: str) -> str:
    return f"CASE WHEN json_type({of}->'matched_terms') = 'ARRAY' THEN array_to_string(CAST({of}->'matched_terms' AS VARCHAR[]), ' ') END AS matched_terms"


SQL |= {
    "p4_rejects": _CTE
    + """
SELECT record_id, 'missing' AS reason, CAST(NULL AS VARCHAR) AS child FROM artifact_records WHERE coalesce(payload, '') = ''
UNION ALL SELECT record_id, 'unreadable', NULL FROM artifact_records WHERE payload <> '' AND NOT json_valid(payload)
UNION ALL SELECT record_id, 'no known type', NULL FROM (SELECT t.record_id, t.r FROM roots t JOIN parsed p ON t.record_id = p.record_id WHERE p.j IS NOT NULL)
WHERE (json_type(r) <> 'OBJECT' OR NOT list_has_any(json_keys(r), ['pages', 'retrieval', 'citations', 'answer_id', 'artifact']))
""",
    "p4_pages": f"""{_CTE} SELECT {_keys("n", "structured_document")},
        {_fields("p", page_id="VARCHAR", width="DOUBLE", height="DOUBLE", dimension_unit="VARCHAR", coordinate_origin="VARCHAR", source_rotation_degrees="INT")} FROM pages""",
    "p4_spans": f"""{_CTE} SELECT {_keys("n, CAST(s->>'span_index' AS INT)", "page", "n, 0")},
        {_fields("s", span_id="VARCHAR", source="VARCHAR", text="VARCHAR", confidence="DOUBLE")}, {_box("s")} FROM spans""",
    "p4_tables": f"""{_CTE} SELECT {_keys("n, ti", "page", "n, 0")},
        {_fields("t", table_id="VARCHAR", row_count="INT", column_count="INT")}, {_box("t")} FROM tables""",
    "p4_cells": f"""{_CTE} SELECT {_keys("n, ti, CAST(c->>'row_index' AS INT), CAST(c->>'column_index' AS INT)", "table", "n, ti")},
        {_fields("c", text="VARCHAR")}, {_box("c")} FROM cells""",
    "p4_hits": f"""{_CTE} SELECT {_keys("CAST(h->>'rank' AS INT)", "qa_result")},
        {_fields("h", chunk_id="VARCHAR", chunk_index="INT", page_id="VARCHAR", page_number="INT", score="DOUBLE", text="VARCHAR")}, {_terms("h")}, {_box("h")} FROM hits""",
    "p4_citations": f"""{_CTE} SELECT {_keys("CAST(c->>'citation_index' AS INT), CAST(c->>'retrieval_rank' AS INT)", "qa_result")},
        {_fields("c", chunk_id="VARCHAR", excerpt="VARCHAR", excerpt_start="INT", excerpt_end="INT", query_term_coverage="DOUBLE")}, {_terms("c")} FROM citations""",
}
