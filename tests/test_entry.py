"""Every core query runs, and gives the rows of its SQL on small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quirewright.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(str([plain(r[c]) for c in names]) for r in df.collect())
    if name in catalogue.SQL:
        db = duckdb.connect()
        db.execute("SET TimeZone = 'UTC'")
        for f in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cursor = db.execute(catalogue.SQL[name])
        theirs = [d[0] for d in cursor.description]
        assert sorted(theirs) == names
        assert mine == Counter(str([plain(r[theirs.index(c)]) for c in names]) for r in cursor.fetchall())
