"""Extractive answers: sentence candidates, evidence selection, abstention, and the audit of citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, distinct_terms, exact_tokens, fingerprint, identity, tokenize, tokens
from ..session import once

MAX_EVIDENCE, MAX_CHARACTERS, MIN_COVERAGE, SEPARATOR = 3, 4000, 0.25, "\n"
#: Zero-width places: around line breaks and after a terminator before a blank.
PLACES = rf"(?<=[\r\n])|(?=[\r\n])|(?<=[.!?])(?=[{BLANK}])"


def sentence_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one row for each line or sentence of ``text_col``: start, end, sentence, all trimmed.

    A unit ends at a line break and after ``.``, ``!`` or ``?`` before a blank; blank units are dropped; offsets are
    code points from 0. All in the JVM.
    """
    parts = F.split(F.col(text_col), PLACES)
    lengths = F.transform(parts, F.length)
    # offsets by sums over blocks of the square root of the number of parts, so long texts don't cost its square
    rows = df.withColumn("_parts", parts).withColumn("_n", lengths).withColumn("_block", F.greatest(F.ceil(F.sqrt(F.size("_n"))), F.lit(1)).cast("int"))
    size = F.col("_block")

    def total(first: Column, n: Column) -> Column:
        return F.aggregate(F.slice("_n", first + 1, n), F.lit(0), lambda a, x: a + x)

    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / size).cast("int")), lambda k: total(k * size, size))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("_before", before)
    at = F.floor(F.col("_k") / size).cast("int")
    rows = rows.filter(F.size("_parts") > 0).select(*df.columns, F.posexplode("_parts").alias("_k", "_part"), "_n", "_block", "_before")
    rows = rows.withColumn("_at", F.get("_before", at) + total(at * size, F.col("_k") - at * size))
    left = F.length("_part") - F.length(F.regexp_replace("_part", f"^[{BLANK}]+", ""))
    body = F.regexp_replace("_part", f"^[{BLANK}]+|[{BLANK}]+$", "")
    rows = rows.withColumn("start", F.col("_at") + left).withColumn("sentence", body)
    rows = rows.withColumn("end", F.col("start") + F.length("sentence"))
    return rows.filter("sentence <> ''").select(*df.columns, "start", "end", "sentence")


def candidates(hits: DataFrame, chunks: DataFrame, terms: DataFrame, *, min_coverage: float = MIN_COVERAGE, exact: bool = True) -> DataFrame:
    """Sentences of the hits that hold enough of the query's terms.

    Result: query_id, rank, chunk_id, start, end, sentence, matched_terms, coverage, position (in the order they are
    tried: coverage, rank, place).
    """
    # a chunk is read once, however many queries hit it
    texts = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("text").alias("text"))
    words = exact_tokens(F.col("sentence")) if exact else tokens(F.col("sentence"))
    parts = sentence_spans(texts).drop("text").withColumn("_words", distinct_terms(words))
    each = hits.select("query_id", "rank", "chunk_id").join(terms, "query_id").join(parts, "chunk_id")
    each = each.withColumn("matched_terms", F.array_intersect("terms", "_words")).drop("_words")
    each = each.withColumn("coverage", F.round(F.size("matched_terms") / F.size("terms"), 12))
    kept = each.filter((F.size("matched_terms") > 0) & (F.col("coverage") >= min_coverage))
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "rank", "start", "end")  # sentences of top_k chunks
    return kept.select(
        "query_id", "rank", "chunk_id", "start", "end", "sentence", "matched_terms", "coverage", F.row_number().over(order).alias("position")
    )


def reachable(found: DataFrame, max_items: int = MAX_EVIDENCE, max_characters: int = MAX_CHARACTERS, separator: str = SEPARATOR) -> DataFrame:
    """The candidates that ``fill`` may come to: where the first ``max_items`` of a query fit as they are only those, else all."""
    size = F.when(F.col("position") <= max_items, F.length("sentence") + len(separator)).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "rank", "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.withColumn("_size", F.sum(size).over(order))
    return sized.filter((F.col("position") <= max(max_items, 1)) | (F.col("_size") > max_characters + len(separator))).drop("_size")


def fill(
    found: list[dict], terms: list[str], max_items: int = MAX_EVIDENCE, max_characters: int = MAX_CHARACTERS,
    min_coverage: float = MIN_COVERAGE, separator: str = SEPARATOR,
) -> list[dict]:
    """The citations taken from candidates in their order, cut to what room is left.

    A cut candidate must still have enough of the terms, else the next one is tried.
    """
    wanted = set(terms)
    out: list[dict] = []
    used = 0
    for c in found:
        room = max_characters - used - (len(separator) if out else 0)
        if len(out) == max_items or room <= 0:
            break
        text = c["sentence"][:room].rstrip()
        matched, coverage = list(c["matched_terms"]), c["coverage"]
        if text != c["sentence"]:
            matched = sorted(wanted & set(tokenize(text)))
            coverage = round(len(matched) / len(wanted), 12)
            if not matched or coverage < min_coverage:
                continue
        used += len(text) + (len(separator) if out else 0)
        out.append(
            {
                "citation_index": len(out) + 1, "retrieval_rank": int(c["rank"]), "chunk_id": c["chunk_id"], "excerpt_start": int(c["start"]),
                "excerpt_end": int(c["start"]) + len(text), "excerpt": text, "matched_terms": matched, "query_term_coverage": coverage,
            }
        )
    return out


CITATION = (
    "citation_index INT, retrieval_rank INT, chunk_id STRING, excerpt_start INT, excerpt_end INT, excerpt STRING, "
    "matched_terms ARRAY<STRING>, query_term_coverage DOUBLE"
)
CITATIONS = "array<struct<" + CITATION.replace(" INT", ": int").replace(" STRING", ": string").replace(" DOUBLE", ": double").replace(
    " ARRAY<STRING>", ": array<string>"
) + ">>"


def answers(
    terms: DataFrame, hits: DataFrame, chunks: DataFrame, *, max_items: int = MAX_EVIDENCE, max_characters: int = MAX_CHARACTERS,
    min_coverage: float = MIN_COVERAGE, separator: str = SEPARATOR, exact: bool = True,
) -> DataFrame:
    """The answer of every query in ``terms``: query_id, answer_id, status, abstention_reason, answer, answer_fingerprint,
    content_fingerprint, citations (each with its excerpt_fingerprint).

    ``content_fingerprint`` is that of status, reason, answer and citations; ``answer_id`` adds what was asked. Only candidates that may be reached are kept: a query's are at most the sentences of its ``top_k`` hits.
    """
    found = reachable(candidates(hits, chunks, terms, min_coverage=min_coverage, exact=exact), max_items, max_characters, separator)
    item = F.struct("position", "rank", "chunk_id", "start", "sentence", "matched_terms", "coverage")
    per_query = found.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("found"))
    had = hits.groupBy("query_id").agg(F.count("*").alias("hits"))

    @F.pandas_udf(CITATIONS)
    def take(found: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series(
            [fill(list(f), list(t), max_items, max_characters, min_coverage, separator) for f, t in zip(found, terms)], dtype=object
        )

    none = F.array().cast(
        "array<struct<position:int,rank:int,chunk_id:string,start:int,sentence:string,matched_terms:array<string>,coverage:double>>"
    )
    rows = terms.join(had, "query_id", "left").join(per_query, "query_id", "left")
    rows = rows.withColumn("citations", once(take)(F.coalesce("found", none), F.col("terms")))
    cited = F.size("citations") > 0
    reason = (
        F.when(cited, None)
        .when(F.col("hits").isNull(), "no_retrieval_hits")
        .when(F.col("found").isNull(), "insufficient_query_term_coverage")
        .otherwise("answer_character_limit")
    )
    text = F.when(cited, F.array_join(F.transform("citations", lambda c: c.excerpt), separator))
    status = F.when(cited, "answered").otherwise("abstained")
    printed = F.transform("citations", lambda c: F.concat_ws("\x1f", c.citation_index, c.retrieval_rank, c.chunk_id, c.excerpt_start, c.excerpt_end, fingerprint(c.excerpt)))
    content = fingerprint(F.concat_ws("\x1e", status, F.coalesce(reason, F.lit("")), F.coalesce(text, F.lit("")), F.array_join(printed, "\x1e")))
    marked = F.transform("citations", lambda c: c.withField("excerpt_fingerprint", fingerprint(c.excerpt)))
    return rows.select(
        "query_id",
        identity("answer-sha256-", F.col("query_id"), F.array_join("terms", " "), content).alias("answer_id"),
        status.alias("status"),
        reason.alias("abstention_reason"),
        text.alias("answer"),
        fingerprint(text).alias("answer_fingerprint"),
        content.alias("content_fingerprint"),
        marked.alias("citations"),
    )


def citation_audit(stored: DataFrame, chunks: DataFrame, terms: DataFrame, *, min_coverage: float = MIN_COVERAGE, exact: bool = True) -> DataFrame:
    """Per stored citation what holds of it: chunk_exists, exact_slice, right_fingerprint, right_terms (the query's that its
    excerpt has), right_coverage, enough_coverage, unique_slice (no other citation of its answer is that slice) and
    contiguous (the indexes of its answer count from 1). Repeated rows count once; ``terms`` as ``query_terms`` gives.

    A query that can't be asked has no terms, so neither terms nor coverage are right.
    """
    each = stored.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*").distinct()
    texts = chunks.groupBy("chunk_id").agg(F.min("text").alias("_text"))
    wanted = terms.select("query_id", F.col("terms").alias("_terms")).dropDuplicates(["query_id"])
    joined = each.join(texts, "chunk_id", "left").join(wanted, "query_id", "left")
    piece = F.substring("_text", F.col("excerpt_start") + 1, F.col("excerpt_end") - F.col("excerpt_start"))
    words = exact_tokens(F.col("excerpt")) if exact else tokens(F.col("excerpt"))
    joined = joined.withColumn("_found", F.array_intersect("_terms", words))
    coverage = F.round(F.size("_found") / F.size("_terms"), 12)
    same = Window.partitionBy("query_id", "chunk_id", "excerpt_start", "excerpt_end")  # one answer's, so few rows
    answer = Window.partitionBy("query_id")
    places = F.sort_array(F.collect_set("citation_index").over(answer))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "query_id",
        "citation_index",
        "chunk_id",
        F.col("_text").isNotNull().alias("chunk_exists"),
        sure(piece == F.col("excerpt")).alias("exact_slice"),
        sure(F.sha2("excerpt", 256) == F.col("excerpt_fingerprint")).alias("right_fingerprint"),
        sure(F.array_sort(F.col("matched_terms")) == F.col("_found")).alias("right_terms"),
        sure(F.abs(F.col("query_term_coverage") - coverage) < 1e-9).alias("right_coverage"),
        sure(coverage >= min_coverage).alias("enough_coverage"),
        (F.count("*").over(same) == 1).alias("unique_slice"),
        sure((F.array_min(places) == 1) & (F.array_max(places) == F.size(places))).alias("contiguous"),
    )


def rank_audit(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations (any key columns, retrieval_rank, chunk_id) whose rank isn't that of their chunk among ``hits`` (the same
    key columns, rank, chunk_id)."""
    keys = [c for c in citations.columns if c in hits.columns and c != "chunk_id"]
    there = hits.select(*keys, F.col("rank").alias("retrieval_rank"), "chunk_id")
    return citations.select(*keys, "retrieval_rank", "chunk_id").distinct().join(there, [*keys, "retrieval_rank", "chunk_id"], "left_anti")


def answer_audit(stored: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """Per stored answer: whether it is its excerpts joined, and whether status, reason and citations agree."""
    n = F.coalesce(F.size("citations"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    joined = F.array_join(F.transform("citations", lambda c: c.excerpt), separator)
    return stored.select(
        "query_id",
        "status",
        n.alias("citation_count"),
        F.coalesce(joined.eqNullSafe(F.col("answer")) | ((n == 0) & F.col("answer").isNull()), F.lit(False)).alias("joined_answer"),
        ((F.col("status") == "answered") == (n > 0)).alias("status_agrees"),
    ).distinct()
