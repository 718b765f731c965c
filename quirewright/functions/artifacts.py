"""Artifacts as canonical JSON: identities, encoding, and strict decoding of any struct."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import canonical, canonical_json, strict_json


def encoded(df: DataFrame, columns: Iterable[str], name: str = "json") -> DataFrame:
    """``df`` with the canonical JSON of some columns."""
    return df.withColumn(name, canonical(F.struct(*columns)))


def artifact_id(prefix: str, struct: Column) -> Column:
    """Identity by content: it changes exactly if the canonical JSON does."""
    return F.concat(F.lit(prefix), F.sha2(canonical(struct), 256))


def dataset_id(prefix: str, judgments: Iterable[tuple[str, str, tuple[str, ...]]]) -> str:
    """Identity of an ordered set of (query_id, query, relevant chunk ids)."""
    rows = [{"query_id": q, "query": t, "relevant": list(c)} for q, t, c in judgments]
    return prefix + hashlib.sha256(canonical_json(rows).encode("utf-8")).hexdigest()


def _keys(schema: T.DataType, value: object) -> str | None:
    """What is wrong with the keys of a decoded value, anywhere in it; null if nothing is."""
    if isinstance(schema, T.StructType):
        if value is None:
            return None
        if not isinstance(value, dict):
            return "not an object"
        names = set(schema.names)
        if set(value) != names:
            extra, missing = sorted(set(value) - names), sorted(names - set(value))
            return f"unknown {extra[0]}" if extra else f"missing {missing[0]}"
        return next((w for f in schema if (w := _keys(f.dataType, value[f.name]))), None)
    if isinstance(schema, T.ArrayType):
        if value is None:
            return None
        if not isinstance(value, list):
            return "not an array"
        return next((w for x in value if (w := _keys(schema.elementType, x))), None)
    return "not a scalar" if isinstance(value, (dict, list)) else None


def decoded(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """``df`` with ``value`` (the typed struct, null if refused) and ``refused`` (why).

    Refused are unreadable texts, duplicate, unknown and missing keys at any depth, and non-finite numbers. A null
    text is refused as missing.
    """

    @F.pandas_udf("string")
    def reason(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            try:
                out.append("missing text" if t is None else _keys(schema, strict_json(t)))
            except (ValueError, RecursionError) as e:
                out.append(str(e)[:80] or "unreadable")
        return pd.Series(out, dtype=object)

    rows = df.withColumn("refused", reason(column))
    return rows.withColumn("value", F.when(F.col("refused").isNull(), F.from_json(column, schema)))
