"""Corpora: packing spans into chunks, and audits of stored chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity
from ..session import bounded_rows, cut, once
from .pages import box_union

LIMIT, FRAGMENTS = 4000, 10_000


class Packer:
    """Greedy packing of one page's spans: chunks of at most ``limit`` characters.

    A separator stands between two fragments of one chunk only: ``words`` between embedded words, else ``lines``.
    """

    def __init__(self, limit: int = LIMIT, fragments: int = FRAGMENTS, words: str = " ", lines: str = "\n") -> None:
        self.limit, self.fragments, self.words, self.lines = limit, fragments, words, lines

    def pack(self, spans: list[tuple[str, str, str]]) -> Iterator[tuple[str, list[tuple]]]:
        """(text, [(span_id, source, source_start, source_end, chunk_start, chunk_end)]) of spans (id, source, text)."""
        parts: list[str] = []
        size, marks = 0, []
        for span, source, text in spans:
            at = 0
            while at < len(text):
                gap = ""
                if marks:
                    gap = self.words if marks[-1][1] == source == "embedded_word" else self.lines
                full = len(marks) == self.fragments or size + len(gap) >= self.limit
                if full and marks:
                    yield "".join(parts), marks
                    parts, size, marks = [], 0, []
                    continue
                take = text[at : at + self.limit - size - len(gap)]
                start = size + len(gap)
                parts += (gap, take)
                size = start + len(take)
                marks.append((span, source, at, at + len(take), start, size))
                at += len(take)
        if marks:
            yield "".join(parts), marks


def pack_pages(spans: DataFrame, packer: Packer | None = None) -> DataFrame:
    """Chunks of every page, in span order.

    Result: document_id, page_id, page_number, page_chunk_index (from 1), text, character_count, content_fingerprint,
    fragments. Null and empty spans give nothing; repeated spans count once. A page is a bounded group.
    """
    packer = packer or Packer()
    rank = F.when(F.col("source") == "embedded_word", 0).otherwise(1)
    item = F.struct(rank.alias("r"), "span_index", "span_id", "source", "text")
    pages = (
        spans.filter("text is not null and text <> ''")
        .dropDuplicates(["page_id", "span_id"])
        .groupBy("document_id", "page_id", "page_number")
        .agg(F.array_sort(F.collect_list(item)).alias("spans"))
    )
    mark = "span_id: string, source: string, source_start: int, source_end: int, chunk_start: int, chunk_end: int"
    names = [x.split(":")[0].strip() for x in mark.split(",")]

    @F.pandas_udf(f"array<struct<text: string, fragments: array<struct<{mark}>>>>")
    def fold(spans: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [
                    {"text": text, "fragments": [dict(zip(names, m)) for m in marks]}
                    for text, marks in packer.pack([(x["span_id"], x["source"], x["text"]) for x in page])
                ]
                for page in spans
            ],
            dtype=object,
        )

    each = pages.select("document_id", "page_id", "page_number", F.posexplode(once(fold)("spans")).alias("k", "chunk"))
    return each.select(
        "document_id",
        "page_id",
        "page_number",
        (F.col("k") + 1).alias("page_chunk_index"),
        "chunk.text",
        F.length("chunk.text").alias("character_count"),
        F.sha2("chunk.text", 256).alias("content_fingerprint"),
        "chunk.fragments",
    )


def fixed_slices(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Packing of pages that are one span each: slices of the limit, all in the JVM."""
    rows = pages.filter("text is not null and text <> ''").select("page_id", "text").distinct()
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / limit).cast("int"))
    return rows.select("page_id", F.col("text").alias("_t"), F.explode(at).alias("_k")).select(
        "page_id", (F.col("_k") + 1).alias("page_chunk_index"), F.substring("_t", F.col("_k") * limit + 1, F.lit(limit)).alias("text")
    )


def number_chunks(chunks: DataFrame, corpus_col: str = "document_id") -> DataFrame:
    """Corpus-wide chunk_index and chunk_id of packed chunks: pages in order, chunks in order on them.

    Pages are counted first, so the window holds one small row for each page, and the texts are only joined. Packing isn't
    repeated for that: the chunks are written once.
    """
    chunks = cut(chunks)
    per_page = chunks.groupBy(corpus_col, "page_number", "page_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy(corpus_col).orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_page.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = chunks.join(offsets, [corpus_col, "page_number", "page_id"])
    out = out.withColumn("chunk_index", F.col("before") + F.col("page_chunk_index")).drop("before")
    return out.withColumn("chunk_id", identity("chunk-sha256-", F.col(corpus_col), F.col("chunk_index")))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """Per stored chunk: wrong count, stale fingerprint, and an id that isn't that of its corpus and index."""
    return chunks.select(
        "chunk_id",
        (~F.col("character_count").eqNullSafe(F.length("text"))).alias("wrong_count"),
        (~F.col("content_fingerprint").eqNullSafe(F.sha2("text", 256))).alias("stale_fingerprint"),
        F.coalesce(F.col("chunk_id") == identity("chunk-sha256-", F.col("corpus_id"), F.col("chunk_index")), F.lit(False)).alias("derived_id"),
    ).distinct()


def index_gaps(chunks: DataFrame) -> DataFrame:
    """Corpora with their chunks, the range of their indexes, and how many are missing in it."""
    return chunks.groupBy("corpus_id").agg(
        F.count_distinct("chunk_index").alias("chunks"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index")
    ).withColumn("missing", F.col("last_index") - F.col("first_index") + 1 - F.col("chunks"))


def page_index_gaps(chunks: DataFrame) -> DataFrame:
    """Per page of a corpus: whether its page_chunk_index counts from 1 without gaps."""
    of = F.count_distinct("page_chunk_index")
    whole = (F.min("page_chunk_index") == 1) & (F.max("page_chunk_index") == of)
    return chunks.groupBy("corpus_id", "page_id").agg(of.alias("chunks"), F.coalesce(whole, F.lit(False)).alias("contiguous"))


def corpus_limits(chunks: DataFrame, per_page: int = 10_000, per_document: int = 100_000, fragments: int = 1_000_000, characters: int = 50_000_000) -> DataFrame:
    """Per corpus its chunks, those of its fullest page, fragments and characters, and whether a limit breaks; nothing is cut."""
    each = chunks.select("corpus_id", "page_id", "chunk_id", F.greatest(F.coalesce(F.size("fragments"), F.lit(0)), F.lit(0)).alias("f"), F.coalesce(F.length("text"), F.lit(0)).alias("c"))
    pages = each.groupBy("corpus_id", "page_id", "chunk_id").agg(F.max("f").alias("f"), F.max("c").alias("c")).groupBy("corpus_id", "page_id").agg(
        F.count("*").alias("n"), F.sum("f").alias("f"), F.sum("c").alias("c")
    )
    out = pages.groupBy("corpus_id").agg(F.sum("n").alias("chunks"), F.max("n").alias("page_chunks"), F.sum("f").alias("fragments"), F.sum("c").alias("characters"))
    wrong = (F.col("chunks") > per_document) | (F.col("page_chunks") > per_page) | (F.col("fragments") > fragments) | (F.col("characters") > characters)
    return out.withColumn("violation", wrong)


def fragment_audit(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Per chunk with fragments: fragments, those without their span, and those whose text differs from it."""
    each = chunks.select("chunk_id", "text", "fragments").distinct().select("chunk_id", F.col("text").alias("chunk_text"), F.explode("fragments").alias("f"))
    each = each.select(
        "chunk_id", "f.span_id", "f.source_start", (F.col("f.source_end") - F.col("f.source_start")).alias("n"),
        F.substring("chunk_text", F.col("f.chunk_start") + 1, F.col("f.chunk_end") - F.col("f.chunk_start")).alias("piece"),
    )
    known = spans.select("span_id", F.col("text").alias("span_text")).dropDuplicates(["span_id"])
    joined = each.join(known, "span_id", "left")
    same = F.substring("span_text", F.col("source_start") + 1, F.col("n")) == F.col("piece")
    return joined.groupBy("chunk_id").agg(
        F.count("*").alias("fragments"),
        F.count_if(F.col("span_text").isNull()).alias("missing_spans"),
        F.count_if(F.col("span_text").isNotNull() & ~same).alias("different"),
    )


def fragment_boxes(chunks: DataFrame) -> DataFrame:
    """The box around each chunk's fragments."""
    each = chunks.select("chunk_id", F.explode("fragments").alias("f"))
    return each.groupBy("chunk_id").agg(*box_union(F.col("f.bounding_box")))


def rebuilt_corpora(chunks: DataFrame, spans: DataFrame, limits: DataFrame, default_limit: int = LIMIT) -> DataFrame:
    """The chunks that packing the stored spans again gives, for every page that has stored chunks.

    limits: config_id, max_characters_per_chunk. Result: corpus_id, page_id, page_chunk_index, text. Each limit is
    packed on its own, and there are few of them.
    """
    conf = limits.select("config_id", "max_characters_per_chunk").dropDuplicates(["config_id"])
    pages = chunks.select("corpus_id", "page_id", "config_id").distinct().join(conf, "config_id", "left")
    pages = pages.select("corpus_id", "page_id", F.coalesce("max_characters_per_chunk", F.lit(default_limit)).alias("limit"))
    sizes = sorted(r["limit"] for r in bounded_rows(pages.select("limit").distinct(), 100, "chunk limits"))
    parts = []
    for size in sizes:
        mine = pages.filter(F.col("limit") == size)
        packed = pack_pages(spans.join(mine.select("page_id").distinct(), "page_id", "left_semi"), Packer(size))
        parts.append(packed.select("page_id", "page_chunk_index", "text").join(mine.drop("limit"), "page_id"))
    if not parts:
        return chunks.select("corpus_id", "page_id", "page_chunk_index", "text").limit(0)
    return reduce(DataFrame.unionByName, parts).select("corpus_id", "page_id", "page_chunk_index", "text")


def rebuild_audit(chunks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Per corpus: stored chunks, those that rebuilding gives at the same place, and those it gives elsewhere or not."""
    keys = ["corpus_id", "page_id", "page_chunk_index"]
    stored = chunks.select(*keys, F.sha2("text", 256).alias("stored")).dropDuplicates(keys)
    again = rebuilt.select(*keys, F.sha2("text", 256).alias("again")).dropDuplicates(keys)
    same = F.coalesce(F.col("stored") == F.col("again"), F.lit(False))
    return stored.join(again, keys, "full").groupBy("corpus_id").agg(
        F.count("stored").alias("stored_chunks"), F.count_if(same).alias("same"), F.count_if(~same).alias("different")
    )
