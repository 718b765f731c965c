"""BM25 over all corpora for many queries at once.

Statistics are per corpus. A query is asked against given corpora, or against one made of all chunks. Terms are
de-duplicated; scores are rounded to 12 digits; ties go to the lower chunk_index, then chunk_id.

An ``Index`` tokenises the chunks once. ``search`` deals parts of the chunks and groups of what is asked to cells, adds
the scores of a cell in memory and shuffles only the numbers, scores and places of terms of its best; names are joined
to what is left. Terms are counted where their corpus is, and only those of a divided corpus before. Every chunk that has a term is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_terms, exact_tokens, fingerprint, identity, is_blank, tokens
from ..session import cut

K1, B, TOP_K = 1.2, 0.75, 10
MAX_CHARACTERS, MAX_TOKENS = 10_000, 1000
ALL = "all"
#: Of a cell of the search at most: chunks, their tokens, and what is asked. SEEDS is of no effect any more.
CHUNKS, TOKENS, ASKS, SEEDS = 65_536, 4_000_000, 200_000, 400
#: Cells in place of one where corpora needn't be divided.
FINE = 4


def tokenized(df: DataFrame, text_col: str = "text", exact: bool = True) -> DataFrame:
    """``df`` with its ``tokens``; ``exact`` normalises fully, else case folding stays in the JVM."""
    col = F.col(text_col)
    return df.withColumn("tokens", exact_tokens(col) if exact else tokens(col))


def query_validation(queries: DataFrame, exact: bool = True) -> DataFrame:
    """Per query: blank, too long, tokens, and whether it can be asked."""
    rows = tokenized(queries.select("query_id", "query").distinct(), "query", exact)
    n = F.size("tokens")
    length = F.coalesce(F.length("query"), F.lit(0))
    blank = is_blank(F.col("query"))
    valid = ~blank & (length <= MAX_CHARACTERS) & (n > 0) & (n <= MAX_TOKENS)
    return rows.select("query_id", blank.alias("blank"), length.alias("characters"), F.greatest(n, F.lit(0)).alias("token_count"), valid.alias("valid"))


def query_terms(queries: DataFrame, exact: bool = True) -> DataFrame:
    """(query_id, terms, token_count): the sorted distinct terms, and the tokens, of the queries that can be asked.

    Of several texts of one id the first in order counts.
    """
    rows = tokenized(queries.filter("query is not null").groupBy("query_id").agg(F.min("query").alias("query")), "query", exact)
    ok = (F.length("query") <= MAX_CHARACTERS) & F.size("tokens").between(1, MAX_TOKENS)
    return rows.filter(ok).select("query_id", distinct_terms(F.col("tokens")).alias("terms"), F.size("tokens").alias("token_count"))


def unique_chunks(chunks: DataFrame, whole: bool = False) -> DataFrame:
    """(corpus_id, chunk_id, chunk_index, text): each chunk once; with ``whole`` all in one corpus.

    Of rows that contradict one another the first in order counts.
    """
    corpus = F.lit(ALL) if whole else F.col("corpus_id")
    first = F.min(F.struct("text", "chunk_index"))
    rows = chunks.groupBy(corpus.alias("corpus_id"), "chunk_id").agg(first.alias("_first"))
    return rows.select("corpus_id", "chunk_id", "_first.chunk_index", "_first.text")


def term_frequency(chunks: DataFrame, exact: bool = True) -> DataFrame:
    """(corpus_id, chunk_id, chunk_index, term, tf, length)."""
    rows = tokenized(chunks, exact=exact)
    keys = ["corpus_id", "chunk_id", "chunk_index"]
    each = rows.select(*keys, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return each.groupBy(*keys, "length", "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, exact: bool = True) -> DataFrame:
    """(corpus_id, n, avgdl): chunks without tokens count too."""
    rows = tokenized(chunks, exact=exact)
    return rows.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def term_score(tf: Column, df: Column, n: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The lengths of a column of lists, and all their elements."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def cell_best(held: pa.Table, asked: pa.Table, top_k: int = TOP_K, k1: float = K1, b: float = B) -> pa.Table:
    """(ask, nr, raw, found): the best chunks in ``held`` (corpus, unit, nr, length, avgdl, tokens) of every ask in ``asked`` (corpus,
    unit, ask, terms in order, idf of each), with the unrounded scores and the places of the terms that they have.

    Of a corpus that is here as a whole avgdl is null and idf empty: both follow from its chunks. Parts are added in the order
    of the terms, as everywhere. Chunks within rounding of the last are kept too, and of exactly equal scores only the first
    ``top_k`` in order, for no other can be among the best.
    """
    out: tuple[list, list, list] = [], [], []
    found = pa.array([], pa.list_(pa.int16()))
    if held.num_rows and asked.num_rows:
        # a cell may hold several parts and groups of a corpus: each is a corpus of its own here
        names = pa.chunked_array([*held["corpus"].chunks, *asked["corpus"].chunks]).unique()
        width = 1 + max(x["unit"].to_numpy().max() for x in (held, asked))
        corpus, home = (pc.index_in(x["corpus"], value_set=names).to_numpy().astype(np.int64) * width + x["unit"].to_numpy() for x in (held, asked))
        nr = held["nr"].to_numpy()
        order = np.lexsort((nr, corpus))
        held, corpus, nr = held.take(order), corpus[order], nr[order]
        corpora, starts, sizes = np.unique(corpus, return_index=True, return_counts=True)
        asks, place = asked["ask"].to_numpy(), np.minimum(np.searchsorted(corpora, home), len(corpora) - 1)
        there = corpora[place] == home
        home = place
        length = held["length"].to_numpy()
        mean = np.repeat(np.add.reduceat(length.astype(np.int64), starts) / sizes, sizes)
        avgdl = held["avgdl"].to_numpy().astype(float)
        avgdl = np.where(np.isnan(avgdl), mean, avgdl)
        # postings: one key for each term of a corpus, in it the chunks in order
        many, words = _flat(asked["terms"])
        vocabulary = words.unique()
        counts, tokens = _flat(held["tokens"])
        code = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(nr)), counts)
        at, code = at[code >= 0], code[code >= 0]
        key = np.searchsorted(corpora, corpus)[at] * len(vocabulary) + code
        pairs, tf = np.unique(key * len(nr) + at, return_counts=True)
        key, at = pairs // len(nr), pairs % len(nr)
        keys, first, df = np.unique(key, return_index=True, return_counts=True)
        last = first + df
        mine = np.repeat(home, many) * len(vocabulary) + pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False)
        place = np.searchsorted(keys, mine)
        known = np.repeat(there, many) & (place < len(keys))
        known[known] = keys[place[known]] == mine[known]
        rare, which = np.unique(1 + (sizes[keys // len(vocabulary)] - df + 0.5) / (df + 0.5), return_inverse=True)
        idf = np.array([math.log(x) for x in rare])[which]
        given, values = _flat(asked["idf"])
        told = np.repeat(given > 0, many)
        idf[place[known & told]] = values.to_numpy(zero_copy_only=False)[known[told]]
        part = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / avgdl[at]))
        at = at - np.repeat(starts, sizes)[at]
        least = np.full(len(keys), np.nan)
        room = np.zeros(max(sizes))
        stops = np.cumsum(many)
        for i in range(len(asks)):
            ps = place[stops[i] - many[i] : stops[i]][known[stops[i] - many[i] : stops[i]]]
            if not len(ps):
                continue
            sums = room[: sizes[home[i]]]
            sums.fill(0.0)
            bound = 0.0
            for p in ps:
                x = part[first[p] : last[p]]
                sums[at[first[p] : last[p]]] += x
                if len(x) >= top_k:
                    # top_k chunks have this term's top_k-th part at least
                    if np.isnan(least[p]):
                        least[p] = np.partition(x, len(x) - top_k)[len(x) - top_k]
                    bound = max(bound, least[p])
            chosen = np.flatnonzero(sums >= _below(bound)) if bound else np.flatnonzero(sums)
            scores = sums[chosen]
            if len(chosen) > top_k:
                near = scores >= _below(np.partition(scores, len(scores) - top_k)[len(scores) - top_k])
                chosen, scores = chosen[near], scores[near]
            if len(chosen) > top_k:
                by = np.lexsort((chosen, -scores))
                chosen, scores = chosen[by], scores[by]
                new = np.append(True, scores[1:] != scores[:-1])
                count = np.arange(len(scores))
                kept = count - np.maximum.accumulate(np.where(new, count, 0)) < top_k
                chosen, scores = chosen[kept], scores[kept]
            out[0].append(np.full(len(chosen), i))
            out[1].append(starts[home[i]] + chosen)
            out[2].append(scores)
        row, chunk = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out[:2])
        # the terms that a hit has: their postings are looked up, a block of hits at a time
        block = np.cumsum(many[row]) // 1_000_000
        found = [found]
        for cut_at in np.split(np.arange(len(row)), np.flatnonzero(np.diff(block)) + 1):
            n = many[row[cut_at]]
            hit = np.repeat(np.arange(len(cut_at)), n)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
            term = (stops - many)[row[cut_at]][hit] + nth
            hit, nth, term = (x[known[term]] for x in (hit, nth, term))
            posting = mine[term] * len(nr) + chunk[cut_at][hit]
            has = pairs[np.minimum(np.searchsorted(pairs, posting), len(pairs) - 1)] == posting if len(pairs) else np.zeros(0, bool)
            ends = np.append(0, np.cumsum(np.bincount(hit[has], minlength=len(cut_at))))
            found.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nth[has], pa.int16())))
        found = pa.concat_arrays(found)
        out = [asks[row]], [nr[chunk]], out[2]
    kinds = (np.int64, np.int64, np.float64)
    made = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip(kinds, out))
    return pa.table(dict(zip(("ask", "nr", "raw"), made)) | {"found": found})


def _below(score: float) -> float:
    """A little less than ``score``, for scores are rounded; never 0."""
    return max(score * (1 - 1e-9) - 1e-9, np.finfo(float).tiny)


class Index:
    """Chunks tokenised once in a written table, numbered in the order in which equal scores are ranked.

    chunks: corpus_id, chunk_id, chunk_index, text; other columns are carried by ``hits``. ``whole``: all chunks are one
    corpus, named ``ALL``. Repeated chunks count once; null texts have no tokens but count as chunks.
    """

    def __init__(self, chunks: DataFrame, *, whole: bool = False, exact: bool = True) -> None:
        self.chunks, self.whole, self.exact = chunks, whole, exact
        # sorted by ranges, so the numbers of the rows rise with the order
        rows = unique_chunks(chunks, whole).orderBy("chunk_index", "chunk_id", "corpus_id")
        rows = tokenized(rows, exact=exact).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
        self.rows = cut(rows.select("corpus_id", "chunk_id", "chunk_index", F.monotonically_increasing_id().alias("nr"), F.size("tokens").alias("length"), "tokens"), tidy=True)
        self.stats = self.rows.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), F.sum("length").alias("size"))

    def search(self, queries: DataFrame, scope: DataFrame | None = None, *, top_k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, corpus_id, rank, score, chunk_id, chunk_index, matched_terms): the best chunks of every query.

        scope: (query_id, corpus_id) to be asked; needed unless all chunks are one corpus. A query without hits gives no
        row (see ``no_hits``). Queries with the same terms are asked once. No posting is shuffled: a cell has a part of the
        chunks and a group of what is asked, and gives ``top_k`` numbers and scores of each, and those that rounding may make equal.
        """
        who = query_terms(queries, self.exact).select("query_id", "terms")
        if scope is None:
            if not self.whole:
                raise ValueError("corpora of their own need a scope")
            who = who.withColumn("corpus_id", F.lit(ALL))
        else:
            who = who.join(scope.select("query_id", "corpus_id").distinct(), "query_id")
        who = cut(who, tidy=True)
        what = cut(who.select("corpus_id", "terms").distinct().withColumn("ask", F.monotonically_increasing_id()), tidy=True)
        # a large corpus is divided in parts, what is asked of it in groups
        asks = what.groupBy("corpus_id").agg(F.count("*").alias("asks"))
        share = F.greatest(F.col("n") / CHUNKS, F.col("size") / TOKENS)
        parts, groups = F.ceil(share).cast("int").alias("parts"), F.ceil(F.col("asks") / ASKS).cast("int").alias("groups")
        corpora = cut(self.stats.join(asks, "corpus_id").select("corpus_id", "n", "avgdl", "size", "asks", F.greatest(parts, F.lit(1)).alias("parts"), groups), tidy=True)
        needed = corpora.agg(F.sum(share * F.col("groups")), F.sum(F.col("asks") / ASKS * F.col("parts")), F.count("*")).first()
        # undivided corpora can be spread finely
        cells = max(1, *(math.ceil((x or 0) * (1 if self.whole else FINE)) for x in needed[:2]))
        large = corpora.filter("parts > 1 or groups > 1").select("corpus_id", "n", "avgdl", "parts", "groups")
        large = large if self.whole else cut(large)
        divided = large.filter("parts > 1")

        def dealt(df: DataFrame, *columns: str) -> DataFrame:
            return df.join(large.select("corpus_id", "parts", "groups", *columns), "corpus_id", "left").fillna(1, ["parts", "groups"])

        unit = (F.col("part") * F.col("groups") + F.col("group")).alias("unit")
        place = F.pmod(F.xxhash64("corpus_id") + unit, F.lit(cells)).cast("int").alias("cell"), F.col("corpus_id").alias("corpus"), unit
        # only a divided corpus' terms are counted outside of its cells; at most MAX_TOKENS of one ask, those that no chunk has without idf
        terms = what.join(divided.select("corpus_id", "n"), "corpus_id").select("ask", "corpus_id", "n", F.explode("terms").alias("term"))
        each = self.rows.join(divided.select("corpus_id"), "corpus_id", "left_semi").select("corpus_id", F.explode(F.array_distinct("tokens")).alias("term"))
        freq = each.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
        n, df = F.col("n"), F.col("df")
        rated = terms.join(freq, ["corpus_id", "term"], "left").select("ask", "corpus_id", "term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
        rated = rated.groupBy("ask", "corpus_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t")).select("ask", "corpus_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
        plain = what.join(divided.select("corpus_id"), "corpus_id", "left_anti").select("ask", "corpus_id", "terms", F.array().cast("array<double>").alias("idf"))
        asked = dealt(rated.unionByName(plain)).withColumn("group", F.pmod(F.xxhash64("ask"), "groups")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = asked.select(*place, "ask", "terms", "idf")
        held = self.rows
        if not self.whole and needed[2] <= 10_000:
            held = held.join(F.broadcast(corpora.select("corpus_id")), "corpus_id", "left_semi")
        held = dealt(held, "avgdl").withColumn("part", F.pmod(F.xxhash64("nr"), "parts")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        held = held.select(*place, "nr", "length", F.when(F.col("parts") > 1, F.col("avgdl")).alias("avgdl"), "tokens")

        def best(held: pa.Table, asked: pa.Table) -> pa.Table:
            return cell_best(held, asked, top_k, k1, b)

        found = held.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(best, "ask LONG, nr LONG, raw DOUBLE, found ARRAY<SHORT>")
        order = Window.partitionBy("ask").orderBy(F.desc("score"), "nr")
        found = found.select("ask", "nr", F.round("raw", 12).alias("score"), "found").filter("score > 0")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
        # one shuffle of all hits: what was asked is where the ranks are, then numbers get their names
        matched = F.transform("found", lambda i: F.get(F.col("terms"), i.cast("int"))).alias("matched_terms")
        named = ranked.join(who.join(what, ["corpus_id", "terms"]), "ask").select("nr", "query_id", "rank", "score", matched)
        named = named.join(self.rows.select("nr", "corpus_id", "chunk_id", "chunk_index"), "nr")
        return named.select("query_id", "corpus_id", "rank", "score", "chunk_id", "chunk_index", "matched_terms")

    def provenance(self, hits: DataFrame) -> DataFrame:
        """``hits`` with the columns of their chunks: home_corpus_id, page_id, page_number, bounding_box, text, and the
        fingerprint of that text."""
        carried = [c for c in ("page_id", "page_number", "bounding_box") if c in self.chunks.columns]
        value = F.min(F.struct("text", "chunk_index", F.col("corpus_id").alias("home_corpus_id"), *carried)).alias("_c")
        mine = self.chunks.groupBy("chunk_id").agg(value)
        mine = mine.select("chunk_id", "_c.home_corpus_id", *(f"_c.{c}" for c in carried), "_c.text", fingerprint(F.col("_c.text")).alias("content_fingerprint"))
        return hits.join(mine, "chunk_id")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    scope: DataFrame | None = None,
    *,
    top_k: int = TOP_K,
    k1: float = K1,
    b: float = B,
    exact: bool = True,
) -> DataFrame:
    """The best chunks of every query by an index made for them; without ``scope`` all chunks are one corpus."""
    return Index(chunks, whole=scope is None, exact=exact).search(queries, scope, top_k=top_k, k1=k1, b=b)


def result_ids(hits: DataFrame) -> DataFrame:
    """(query_id, corpus_id, result_id, content_fingerprint): a result's identity by what was asked and by what was found."""
    row = F.concat_ws("\x1f", "rank", F.col("score").cast("string"), "chunk_id", F.array_join("matched_terms", " "))
    lines = F.array_join(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).getField("row"), "\n")
    each = hits.groupBy("query_id", "corpus_id").agg(fingerprint(lines).alias("content_fingerprint"))
    return each.select("query_id", "corpus_id", identity("retrieval-sha256-", F.col("query_id"), F.col("corpus_id"), F.col("content_fingerprint")).alias("result_id"), "content_fingerprint")


def no_hits(scope: DataFrame, hits: DataFrame) -> DataFrame:
    """The (query_id, corpus_id) of ``scope`` without any hit: a valid, empty result."""
    return scope.select("query_id", "corpus_id").distinct().join(hits, ["query_id", "corpus_id"], "left_anti")


def unknown_judgments(judgments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Judged chunks that don't exist, or, where ``judgments`` has a corpus_id, not in the corpus they are judged for."""
    keys = ["chunk_id"] + (["corpus_id"] if "corpus_id" in judgments.columns else [])
    return judgments.select("query_id", *keys).distinct().join(chunks.select(*keys), keys, "left_anti").select("query_id", *keys)


def search_queries(queries: DataFrame) -> DataFrame:
    """The stated query set of a search over everything: ids divisible by 50."""
    return queries.filter(F.regexp_extract("query_id", "[0-9]+$", 0).cast("long") % 50 == 0)
