"""Retrieval metrics and text error rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANK

METRICS = ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg")


def case_metrics(hits: DataFrame, judgments: DataFrame, top_k: int = 10) -> DataFrame:
    """Metrics of every judged query, each rounded to 12 digits.

    judgments: query_id, chunk_id, one row for each relevant chunk (repeats count once). Precision is over ``top_k``;
    average precision and the ideal gain are over min(relevant, top_k). A query without hits scores 0.
    """
    judged = judgments.select("query_id", "chunk_id").distinct()
    relevant = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = hits.filter(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id").join(judged, ["query_id", "chunk_id"])
    place = Window.partitionBy("query_id").orderBy("rank")  # at most top_k rows a query
    found = found.withColumn("i", F.row_number().over(place))
    got = found.groupBy("query_id").agg(
        F.count("*").alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.col("i") / F.col("rank")).alias("precisions"),
        F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"),
    )
    least = F.least("relevant", F.lit(top_k))
    ideal = F.aggregate(F.sequence(F.lit(1), least.cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    zero = F.lit(0.0)
    return relevant.join(got, "query_id", "left").select(
        "query_id",
        "relevant",
        F.coalesce("found", F.lit(0)).alias("relevant_retrieved"),
        F.round(F.coalesce(F.col("found") / top_k, zero), 12).alias("precision"),
        F.round(F.coalesce(F.col("found") / F.col("relevant"), zero), 12).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), zero), 12).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("precisions") / least, zero), 12).alias("average_precision"),
        F.round(F.coalesce(F.col("gain") / ideal, zero), 12).alias("ndcg"),
    )


def mean_metrics(cases: DataFrame) -> DataFrame:
    """One row: the number of cases and the means of the rounded case metrics, rounded again."""
    return cases.agg(F.count("*").alias("cases"), *(F.round(F.avg(m), 12).alias(f"mean_{m}") for m in METRICS))


def edits(a: list | str, b: list | str) -> int:
    """Least insertions, deletions and substitutions that turn ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@F.pandas_udf(T.IntegerType())
def _long_word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x.split(), y.split()) for x, y in zip(a, b)], dtype="Int32")


def words(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def word_edits(a: Column | str, b: Column | str) -> Column:
    """Edit distance over blank-separated words: that of strings in which each distinct word of both is one character.

    All in the JVM; only pairs with more distinct words than there are two-byte characters go to Python.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    known = F.array_distinct(F.concat(words(a), words(b)))
    most = 0xD7FF

    def coded(text: Column) -> Column:
        one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w)), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(words(text), one), "")

    few = F.size(known) <= most
    return F.coalesce(F.when(few, F.levenshtein(coded(a), coded(b))), _long_word_edits(F.when(~few, a), F.when(~few, b)))


def word_count(text: Column | str) -> Column:
    return F.size(words(F.col(text) if isinstance(text, str) else text))


def error_rate(wrong: Column, length: Column) -> Column:
    """Edits over the reference's length; of an empty reference 0 without edits, else 1."""
    return F.when(length > 0, wrong / length).when(wrong == 0, 0.0).otherwise(1.0)


def text_errors(pairs: DataFrame, case_col: str = "case_id") -> DataFrame:
    """Exact match, character and word error rate of (``case_col``, reference, hypothesis), without normalisation.

    Null texts count as empty.
    """
    rows = pairs.select(
        case_col, F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis")
    )
    characters = F.levenshtein("reference", "hypothesis")
    return rows.select(
        case_col,
        (F.col("reference") == F.col("hypothesis")).alias("exact_match"),
        error_rate(characters, F.length("reference")).alias("character_error_rate"),
        error_rate(word_edits("reference", "hypothesis"), word_count("reference")).alias("word_error_rate"),
    )
