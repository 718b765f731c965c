"""Every query of the subpackage runs, and gives the rows of its SQL where there is one."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quirewright.llm import queries

COLUMNS = {
    "p1_found": ["page_id", "line_index", "noise"], "p2_found": ["field", "record_id", "citation_index"], "p3_found": ["chunk_id"],
    "p5_found": ["record_id", "citation_index", "sentence_start"], "p6_found": ["setting_id", "doc_id"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS.get(name, df.columns) == df.columns
    rows = Counter(tuple(r) for r in df.collect()) if name in queries.SQL else df.count()
    if name in queries.SQL:
        db = duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        assert rows == Counter(db.execute(queries.SQL[name]).fetchall())
