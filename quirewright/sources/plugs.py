"""Where parsers and recognisers are plugged in: each is a function of a file's or page's bytes, run by Arrow batches.

Libraries for PDF, layout and recognition aren't part of the engine. What they give is typed here, so that the operators
can go on with it; a file that a parser refuses is a row with the reason, never a lost one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

QUAD = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
BOX = "STRUCT<x0: DOUBLE, top: DOUBLE, x1: DOUBLE, bottom: DOUBLE>"

#: What a parser of each kind gives for one input.
KINDS = {
    # embedded text and size of every page of a document
    "pages": "page_number INT, text STRING, width DOUBLE, height DOUBLE, dimension_unit STRING, source_rotation_degrees INT",
    # rendered pages
    "images": "page_number INT, content BINARY, width_pixels INT, height_pixels INT",
    # recognised lines of a page
    "lines": f"line_index INT, text STRING, confidence DOUBLE, quad {QUAD}",
    # words and tables of a page's layout
    "words": f"page_number INT, word_index INT, text STRING, bounding_box {BOX}",
    "tables": f"page_number INT, bounding_box {BOX}, cells ARRAY<STRUCT<row_index: INT, column_index: INT, text: STRING, bounding_box: {BOX}>>",
}


def parse(inputs: DataFrame, key: str, kind: str, parser: Callable[[bytes], Iterable[dict]], content: str = "content") -> DataFrame:
    """(``key``, refused, the columns of ``KINDS[kind]``): one row for each record that ``parser`` gives for an input.

    A ValueError of the parser gives one row with its text in ``refused``; another error fails the job. A null content
    is refused as missing; an input without records gives no row. No shuffle; an input is a bounded cell.
    """
    names = [c.split()[0] for c in _split(KINDS[kind])]
    none = dict.fromkeys(["refused", *names])
    key_type = inputs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[content]):
                if data is None:
                    rows.append(none | {key: k, "refused": "missing"})
                    continue
                try:
                    rows += [none | {key: k} | {n: r.get(n) for n in names} for r in parser(bytes(data))]
                except ValueError as e:
                    rows.append(none | {key: k, "refused": str(e) or "refused"})
            yield pd.DataFrame(rows, columns=[key, "refused", *names], dtype=object)

    return inputs.select(key, content).mapInPandas(run, f"{key} {key_type}, refused STRING, {KINDS[kind]}")


def _split(ddl: str) -> list[str]:
    """Top-level columns of a DDL string."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return [*parts, ddl[start:].strip()]
