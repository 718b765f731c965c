"""The whole path as one plan: spans to chunks, queries to hits, hits to cited answers, answers to a judged report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, chunking, evaluation, quality, retrieval
from ..sources.files import write_bundle


def corpus(spans: DataFrame, limit: int = chunking.LIMIT) -> DataFrame:
    """Chunks of every document, each document a corpus of its own."""
    packed = chunking.number_chunks(chunking.pack_pages(spans, chunking.Packer(limit)))
    return packed.withColumnRenamed("document_id", "corpus_id")


def ask(queries: DataFrame, chunks: DataFrame, scope: DataFrame, top_k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, hits, answers) of queries asked against corpora: scope has query_id and corpus_id, one a query."""
    terms = retrieval.query_terms(queries)
    hits = retrieval.retrieve(queries, chunks, scope, top_k=top_k)
    return terms, hits, answers.answers(terms, hits, chunks)


def report(made: DataFrame, hits: DataFrame, judgments: DataFrame, gates: DataFrame, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(observations, gate results) of answers against judged chunks."""
    cited = made.select("query_id", F.col("citations.chunk_id").alias("chunk_ids"))
    seen = quality.retrieval_observations(evaluation.case_metrics(hits, judgments, top_k)).unionByName(
        quality.provenance_observations(quality.citation_scores(cited, judgments))
    )
    return seen, quality.gates(gates, seen)


def store(spans: DataFrame, queries: DataFrame, scope: DataFrame, judgments: DataFrame, gates: DataFrame, path: str, top_k: int = 10) -> None:
    """The whole path into a new bundle: chunks, hits, answers, observations and gate results, with their digests."""
    chunks = corpus(spans)
    _, hits, made = ask(queries, chunks, scope, top_k)
    seen, results = report(made, hits, judgments, gates, top_k)
    write_bundle({"chunks": chunks, "hits": hits, "answers": made, "observations": seen, "gates": results}, path)
