"""Splitting oversized items at natural boundaries, range by range.

Pieces are cut greedily: each ends at the strongest boundary in the upper half of what fits, and the next begins the
stated overlap earlier. Where a piece ends depends only on where it begins, so long items are worked on in ranges,
each read with a halo on both sides, and the pieces are the same for every size of range. The worker of a range doesn't
know where the piece before it ends; it finds the boundaries at which that may be, at most one limit behind its begin,
and follows the pieces from each of them through its range. These chains soon run together, so the table
of a range (cut that enters, cut that leaves, pieces between) is short. Stitching the tables gives every range the
cut that enters it; prefix sums of lengths and pieces give offsets in the whole item. For files (``split_files``)
ranges are bytes read by separate tasks, and pieces are emitted by offset without loading a file; for table cells
they are parts of the text, and only cells longer than a range are shuffled, part by part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut, once

DEFAULT_LIMIT = 4000
DEFAULT_OVERLAP = 200
#: Limits that make a range of a table cell; bytes of a range of a file; ranges of a file that are stitched together.
LIMITS_PER_RANGE, RANGE_BYTES, RANGES_PER_GROUP = 16, 8 << 20, 1024
#: Characters looked at before a position to tell which boundary it is.
CONTEXT = 16

#: Boundaries from the strongest to the weakest; a cut is made at the end of a match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t\r]*\n\s*",
        r"[.!?…]['\"’”»)\]]*\s+|[。！？।።؟]['\"’”»」』）)\]]*\s*",
        r"\r?\n",
        r"[,;:،؛፣፤、，；：]\s+|[、，；：]",
        r"\s+",
        r"(?<=[぀-ヿ㐀-鿿가-힣])(?=[぀-ヿ㐀-鿿가-힣])",
    )
)
#: Not before a mark, a joiner, a variation selector or the second half of a CR LF.
INSIDE = re.compile(r"[̀-ًͯ-ٟऀ-ःऺ-ॏ॑-ॗ‌‍︀-️゙゚]|(?<=\r)\n")


def best_cut(text: str, low: int, high: int) -> int:
    """The cut in (low, high]: the last of the strongest boundary that ends there, else the last position that
    divides no character, else ``high``."""
    if high >= len(text):
        return len(text)
    for boundary in BOUNDARIES:
        found = -1
        for m in boundary.finditer(text, max(0, low - CONTEXT), min(len(text), high + CONTEXT)):
            if low < m.end() <= high:
                found = m.end()
            elif m.start() < high < m.end() and m.group().isspace() and low < high:
                found = high  # a blank run longer than what fits
        if found > 0:
            return found
    at = high
    while at > low + 1 and INSIDE.match(text, at):
        at -= 1
    return at if at > low + 1 or not INSIDE.match(text, at) else high


def next_cut(text: str, done: int, limit: int, overlap: int) -> int:
    """The end of the piece that follows the cut at ``done``, or that begins the text if ``done`` is 0.

    ``text`` may be a stretch of an item that goes ``overlap`` and ``CONTEXT`` characters back from ``done`` and ``limit``
    and ``CONTEXT`` on, or to the item's ends.
    """
    start = max(0, done - overlap) if done else 0
    if start + limit >= len(text):
        return len(text)
    return best_cut(text, max(done, start + limit // 2), start + limit)


def halo(limit: int, overlap: int) -> tuple[int, int]:
    """Characters that a range is read with before and behind it."""
    return overlap + CONTEXT + 2, limit + CONTEXT + 2


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one item."""
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    return _pieces(text, 0, len(text), limit, overlap)


def _pieces(text: str, done: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces from the cut at ``done`` to the first one that ends at ``stop`` or behind."""
    out = []
    while done < stop:
        end = next_cut(text, done, limit, overlap)
        out.append((max(0, done - overlap) if done else 0, end))
        done = end
    return out


def entries(text: str, begin: int, limit: int, overlap: int) -> list[int]:
    """Where the first cut at ``begin`` or behind may be: ends of boundaries, blanks, and what lies in a stretch
    without boundaries that is long enough for a cut to be forced."""
    stop = min(len(text), begin + limit - 1)
    least = min(limit - limit // 2, limit - overlap)
    low, high = max(0, begin - limit - CONTEXT), min(len(text), stop + limit + CONTEXT)
    marks = {low, high}
    for boundary in BOUNDARIES:
        for m in boundary.finditer(text, low, high):
            marks.add(m.end())
            if m.end() - m.start() > 1:
                marks.update(range(m.start() + 1, m.end()))  # a search that starts inside may end there, or a blank run be cut
    known = sorted(marks)
    # how long the outer stretches are can't be seen
    free = {p for a, b in zip(known, known[1:]) if b - a >= least or a == low or b == high for p in range(a, b)}
    return sorted(p for p in marks | free if begin <= p <= stop)


def chains(text: str, begin: int, end: int, starts: Iterable[int], limit: int, overlap: int) -> dict[int, int]:
    """The cut after each of ``starts`` and after each cut that follows from them, as long as they lie before ``end``."""
    after: dict[int, int] = {}
    for at in starts:
        while at < end and at not in after:
            after[at] = at = next_cut(text, at, limit, overlap)
    return after


def crossings(starts: Iterable[int], after: dict[int, int], begin: int, end: int) -> list[tuple[int, int, int, int]]:
    """(first, last, exit, pieces): from cuts ``first`` to ``last`` behind ``begin`` the chains leave ``exit`` behind ``end``.

    Neighbouring starts with the same way out make one row.
    """
    leaves: dict[int, tuple[int, int]] = {}

    def leave(at: int) -> tuple[int, int]:
        way = []
        while at < end and at not in leaves:
            way.append(at)
            at = after[at]
        out, pieces = leaves[at] if at < end else (at - end, 0)
        for x in reversed(way):
            pieces += 1
            leaves[x] = out, pieces
        return out, pieces

    rows: list[tuple[int, int, int, int]] = []
    for at in starts:
        out, pieces = leave(at)
        if rows and rows[-1][2:] == (out, pieces):
            rows[-1] = (rows[-1][0], at - begin, out, pieces)
        else:
            rows.append((at - begin, at - begin, out, pieces))
    return rows


def crossed(rows: list[tuple[int, int, int, int]], entry: int) -> tuple[int, int]:
    """(exit, pieces) of the chain that enters at ``entry``."""
    k = bisect_right(rows, (entry, 1 << 62)) - 1
    if k < 0 or not rows[k][0] <= entry <= rows[k][1]:
        raise ValueError(f"no piece ends {entry} characters behind the begin of the range")
    return rows[k][2], rows[k][3]


def split_chunks(
    chunks: DataFrame,
    configs: DataFrame,
    *,
    default_limit: int = DEFAULT_LIMIT,
    default_overlap: int = DEFAULT_OVERLAP,
    limits_per_range: int = LIMITS_PER_RANGE,
) -> DataFrame:
    """Pieces of every chunk within its configuration's limit; they don't depend on ``limits_per_range``.

    Result: the chunk's chunk_id, corpus_id, config_id, page_id and page_number with piece_index, pieces, piece_id,
    piece_start, piece_end (code points of the chunk's text), text, character_count, content_fingerprint and
    fragments whose offsets hold for the piece and which still point to their spans. A chunk within the limit is
    one piece. Lengths are measured, ``character_count`` isn't read. A null or unknown config_id or limit means the
    defaults; an overlap is cut to limit - 1. Null text gives one null piece, empty text one empty piece; null
    fragments stay null. Repeated rows give their pieces again; other columns aren't read. Only the parts of texts of
    more than ``limits_per_range`` limits are shuffled.
    """
    conf = configs.select(
        F.col("config_id").alias("_config"),
        F.col("max_characters_per_chunk").alias("_limit"),
        F.col("overlap_characters").alias("_overlap"),
    ).filter("_config is not null").dropDuplicates(["_config"])
    own = ["chunk_id", "corpus_id", "config_id", "page_id", "page_number"]
    rows = chunks.select(*own, F.col("text").alias("_text"), F.col("fragments").alias("_fragments")).join(
        bounded_broadcast(conf), F.col("config_id") == F.col("_config"), "left"
    )
    good = F.col("_limit").isNotNull() & (F.col("_limit") > 0)
    rows = rows.withColumn("_overlap", F.when(good, F.coalesce("_overlap", F.lit(0))).otherwise(default_overlap))
    rows = rows.withColumn("_limit", F.when(good, F.col("_limit")).otherwise(default_limit)).drop("_config")
    length = F.coalesce(F.length("_text"), F.lit(0))

    @F.pandas_udf("array<struct<s: int, e: int>>")
    def ranges(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"s": s, "e": e} for s, e in cuts(t, int(m), int(o))] for t, m, o in zip(text, limit, overlap)],
            dtype=object,
        )

    whole = F.array(F.struct(F.lit(0).alias("s"), length.alias("e")))
    one = F.col("_limit").cast("long") * limits_per_range
    # only texts over the limit go to Python; the rest stay in the JVM
    small = rows.filter(length <= F.col("_limit")).withColumn("_cuts", whole)
    large = rows.filter((length > F.col("_limit")) & (length <= one)).withColumn("_cuts", once(ranges)("_text", "_limit", "_overlap"))
    key = [F.sha2("_text", 256).alias("_key"), "_limit", "_overlap"]
    giant = rows.filter(length > one)
    found = _giant_cuts(giant.select(*key, "_text"), limits_per_range)
    giant = giant.select("*", key[0]).join(found, ["_key", "_limit", "_overlap"]).drop("_key")
    each = small.unionByName(large).unionByName(giant).select("*", F.posexplode("_cuts").alias("_at", "_cut"))
    s, e = F.col("_cut.s"), F.col("_cut.e")
    text = F.substring("_text", s + 1, e - s)
    inside = F.filter("_fragments", lambda f: (f.chunk_start < e) & (f.chunk_end > s))
    moved = F.transform(
        inside,
        lambda f, k: F.struct(
            (k + 1).alias("fragment_index"),
            f.span_id.alias("span_id"),
            f.span_index.alias("span_index"),
            f.source.alias("source"),
            (f.source_start + F.greatest(s - f.chunk_start, F.lit(0))).alias("source_start"),
            (f.source_end - F.greatest(f.chunk_end - e, F.lit(0))).alias("source_end"),
            (F.greatest(f.chunk_start, s) - s).alias("chunk_start"),
            (F.least(f.chunk_end, e) - s).alias("chunk_end"),
            f.bounding_box.alias("bounding_box"),
        ),
    )
    return each.select(
        *own,
        (F.col("_at") + 1).alias("piece_index"),
        F.size("_cuts").alias("pieces"),
        F.concat(F.lit("piece-sha256-"), F.sha2(F.concat_ws(":", "chunk_id", F.col("_at") + 1), 256)).alias("piece_id"),
        s.alias("piece_start"),
        e.alias("piece_end"),
        text.alias("text"),
        (e - s).alias("character_count"),
        F.sha2(text, 256).alias("content_fingerprint"),
        moved.alias("fragments"),
        F.col("_limit").alias("limit_characters"),
        F.col("_overlap").alias("overlap_characters"),
    )


def _giant_cuts(texts: DataFrame, limits_per_range: int) -> DataFrame:
    """(_key, _limit, _overlap, _cuts) of texts of many ranges: each range in its own row, then stitched by its table.

    texts: _key, _limit, _overlap, _text. Copies count once. The table of a range is as long as its pieces and entries.
    """
    size = F.col("_limit") * limits_per_range
    n = F.length("_text")
    parts = texts.dropDuplicates(["_key", "_limit", "_overlap"]).select(
        "*", n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("_part")
    )
    begin = F.col("_part") * size
    from_ = F.greatest(begin - F.col("_overlap") - CONTEXT - 2, F.lit(0))
    to = F.least(begin + size + F.col("_limit") + CONTEXT + 2, F.col("_n"))
    parts = parts.select(
        "_key", "_limit", "_overlap", "_part", from_.alias("_from"), begin.alias("_begin"),
        F.least(begin + size, F.col("_n")).alias("_end"), F.substring("_text", from_ + 1, to - from_).alias("_window"),
    ).repartition("_key", "_limit", "_overlap", "_part")

    @F.pandas_udf("array<struct<s: int, e: int>>")
    def table(text: pd.Series, start: pd.Series, begin: pd.Series, end: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        out = []
        for t, f, b, e, m, o in zip(text, start, begin, end, limit, overlap):
            o = max(0, min(o, m - 1))
            at = [0] if b == 0 else entries(t, b - f, m, o)
            out.append([{"s": x + f, "e": y + f} for x, y in chains(t, b - f, e - f, at, m, o).items()])
        return pd.Series(out, dtype=object)

    tables = parts.select("_key", "_limit", "_overlap", "_part", once(table)("_window", "_from", "_begin", "_end", "_limit", "_overlap").alias("_after"))
    ends = texts.dropDuplicates(["_key", "_limit", "_overlap"]).select("_key", "_limit", "_overlap", n.alias("_n"))

    def stitch(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        after = {x["s"]: x["e"] for row in g["_after"] for x in row}
        at, out, overlap, n = 0, [], max(0, min(int(key[2]), int(key[1]) - 1)), int(key[3])
        while at < n:
            out.append({"s": max(0, at - overlap) if at else 0, "e": after[at]})
            at = after[at]
        return pd.DataFrame([(*key[:3], out)], columns=["_key", "_limit", "_overlap", "_cuts"])

    joined = tables.join(ends, ["_key", "_limit", "_overlap"]).groupBy("_key", "_limit", "_overlap", "_n")
    return joined.applyInPandas(stitch, "_key STRING, _limit INT, _overlap INT, _cuts ARRAY<STRUCT<s: INT, e: INT>>")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _segment(f, size: int, begin: int, end: int) -> str:
    """The text of the characters that begin at bytes ``begin`` to ``end`` of a file."""
    begin, end = max(0, begin), min(size, end)
    if begin >= end:
        return ""
    f.seek(begin)
    data = f.read(min(size, end + 3) - begin)
    head, tail = 0, end - begin
    while begin and head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1  # the rest of a character that begins before
    while end < size and tail < min(end - begin + 3, len(data)) and data[tail] & 0xC0 == 0x80:
        tail += 1
    return data[head:tail].decode("utf-8", "replace")


def split_files(
    spark: SparkSession, files: DataFrame, limit: int = DEFAULT_LIMIT, overlap: int = DEFAULT_OVERLAP, range_bytes: int = RANGE_BYTES,
    ranges_per_group: int = RANGES_PER_GROUP,
) -> DataFrame:
    """Pieces of UTF-8 files, each read in byte ranges; no task holds more than a range and its halo.

    files: path STRING (a URI), length BIGINT, as Spark's binaryFile source lists them without content. Result
    (path, piece_index, piece_start, piece_end, text); offsets are code points of the whole file, and pieces are those
    of ``cuts`` for its text, whatever the range. Null paths and empty files give no pieces; a path listed more than
    once counts once. Undecodable bytes read as U+FFFD.
    """
    overlap = max(0, min(overlap, limit - 1))
    before_chars, after_chars = halo(limit, overlap)
    given = files.filter("path is not null and length > 0").select("path", "length").dropDuplicates(["path"])
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes)))
    steps = given.select("path", "length", parts.alias("part")).repartition("path", "part")

    def load(path: str, size: int, part: int) -> tuple[str, int, int]:
        """A range's text with its halo, and where in it the range begins and ends."""
        begin, end = part * range_bytes, (part + 1) * range_bytes
        with _open(path) as f:
            before = _segment(f, size, begin - 4 * before_chars, begin)
            body = _segment(f, size, begin, end)
            after = _segment(f, size, end, end + 4 * after_chars)
        return before + body + after, len(before), len(before) + len(body)

    row = "first LONG, last LONG, exit LONG, pieces LONG"
    rows_ddl = f"ARRAY<STRUCT<{row.replace(' LONG', ': LONG')}>>"

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, size, part in b[["path", "length", "part"]].itertuples(index=False):
                text, begin, end = load(path, size, part)
                at = entries(text, begin, limit, overlap) if part else [0]
                found = crossings(at, chains(text, begin, end, at, limit, overlap), begin, end)
                out.append((path, part, end - begin, _packed(found)))
            yield pd.DataFrame(out, columns=["path", "part", "characters", "rows"])

    # read once: what follows is some rows of numbers for each range
    table = cut(steps.mapInPandas(detect, f"path STRING, part LONG, characters LONG, rows {rows_ddl}"))
    table = table.withColumn("grp", F.floor(F.col("part") / ranges_per_group))

    def compose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """The table of neighbouring ranges as if they were one."""
        g = g.sort_values("part")
        steps = [_unpacked(r) for r in g["rows"]]
        out = []
        for first, last, exit_, pieces in steps[0]:
            for more in steps[1:]:
                exit_, n = crossed(more, exit_)
                pieces += n
            out.append((first, last, exit_, pieces))
        return pd.DataFrame([(*key, int(g["characters"].sum()), _packed(out))], columns=["path", "grp", "characters", "rows"])

    groups = table.groupBy("path", "grp").applyInPandas(compose, f"path STRING, grp LONG, characters LONG, rows {rows_ddl}")

    def follow(g: pd.DataFrame, by: str, entry: int, number: int, at: int) -> list[tuple]:
        """(``by``, entering cut, pieces before, characters before) of each row of tables in order."""
        out = []
        for k, characters, rows in g.sort_values(by)[[by, "characters", "rows"]].itertuples(index=False):
            out.append((k, entry, number, at))
            entry, n = crossed(_unpacked(rows), entry)
            number, at = number + n, at + characters
        return out

    def enter(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in follow(g, "grp", 0, 0, 0)], columns=["path", "grp", "entry", "number", "at"])

    entering = groups.groupBy("path").applyInPandas(enter, "path STRING, grp LONG, entry LONG, number LONG, at LONG")

    def stitch(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[0]
        rows = follow(g, "part", int(first["entry"]), int(first["number"]), int(first["at"]))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["path", "part", "entry", "number", "at"])

    stitched = table.join(entering, ["path", "grp"]).groupBy("path", "grp").applyInPandas(
        stitch, "path STRING, part LONG, entry LONG, number LONG, at LONG"
    )
    todo = stitched.join(given, "path").repartition("path", "part")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                text, begin, end = load(r.path, r.length, r.part)
                shift = r.at - begin
                got = _pieces(text, begin + r.entry, end, limit, overlap)
                yield pd.DataFrame(
                    [(r.path, r.number + k, s + shift, e + shift, text[s:e]) for k, (s, e) in enumerate(got, 1)],
                    columns=["path", "piece_index", "piece_start", "piece_end", "text"],
                )

    return todo.mapInPandas(emit, "path STRING, piece_index LONG, piece_start LONG, piece_end LONG, text STRING")


def _packed(rows: list[tuple]) -> list[dict]:
    return [dict(zip(("first", "last", "exit", "pieces"), r)) for r in rows]


def _unpacked(rows) -> list[tuple[int, int, int, int]]:
    return [(r["first"], r["last"], r["exit"], r["pieces"]) for r in rows]


def oversized(pieces: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that had to be cut."""
    return pieces.filter((F.col("pieces") > 1) & (F.col("piece_index") == 1)).select("chunk_id").distinct()
