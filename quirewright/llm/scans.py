"""Noise in text from scanned pages: running titles, page numbers, divided and misread words.

Edge lines are compared with the document's title and with the other pages' edges in a form in which characters
that scanners confuse are equal. Words are counted over all body lines; each word has an anagram hash, the sum
of the fifth powers of its code points modulo a prime, so a confusion of characters is one difference of hashes
whatever the word. Rare words are joined with frequent ones whose hash differs by a known confusion, candidates are
checked and ranked by frequency. What no lexicon holds, numbers and words that occur once, is joined in the same way by
its shape: letters and digits made alike, a rare shape ("0A00", "l May") against the frequent one that it is read
from ("0000", "0 May"). A word divided at a line's end is kept together by what the corpus spells.
Pages, lines and words are joined by their keys; no document is gathered in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, once
from .sentences import sentence_spans

# What is printed and what is read instead, between letters.
LETTERS = "e:c n:u i:l l:i a:o h:b v:y f:t u:n c:e o:a t:f b:h y:v ß:B ä:a ö:o ü:u é:e á:a í:i ó:o ú:u ñ:n è:e I:l"
GROUPS = "d:cl m:rn u:ii w:vv ü:ii cl:d rn:m ii:u vv:w"
SIGNS = "o:0 O:0 l:1 i:1 I:1 s:5 S:5 g:9 q:9 t:+ é:6 ó:6 b:6 B:8 l:| I:| z:2 Z:2 1:l 1:I 0:O 0:o 5:S 8:B 6:b"
# The same for Cyrillic and Greek letters.
CYRILLIC, GREEK = "и:н н:и п:н ц:ч ш:щ щ:ш ь:ъ е:с с:е в:з з:в", "ν:υ υ:ν η:π κ:χ ο:σ σ:ο"
OTHER_SIGNS = "о:0 О:0 з:3 З:3 б:6 ч:4 ο:0 Ο:0 ι:1 ε:3"
#: Most that a misread form may occur for each occurrence of the right one.
SHARE = {"letter": 0.08, "group": 0.2, "sign": 0.34}
#: The same where two confusions are needed.
SHARE_TWO = 0.02
#: Shorter words are more often alike by chance: below these lengths each letter less takes ten times the evidence.
SURE, SURE_TWO = 3, 7
#: Least occurrences of a word others are read as.
LEAST = 3
#: Modulus of anagram hashes.
PRIME = (1 << 31) - 1
#: Words that are so frequent that tokens of them are set aside before the join.
FREQUENT = 20_000
#: Part of a document's pages, or of neighbouring ones, that must share an edge line that isn't its title.
REPEATED = 0.12
#: Pages that count as neighbouring; any half as many that follow one another are in one such range.
NEIGHBOURS = 64
#: Pages over which the begin of a paragraph is looked for at once, and those of a document whose rows are joined apart.
PAGES_PER_BLOCK, HOT = 4096, 10_000

CONFUSIONS = [
    (*pair.split(":"), kind) for kind, text in (("letter", f"{LETTERS} {CYRILLIC} {GREEK}"), ("group", GROUPS), ("sign", f"{SIGNS} {OTHER_SIGNS}")) for pair in text.split()
]

# Characters taken for one another, for comparing whole lines.
ALIKE = (("éèêëc", "e"), ("uüúùûñ", "n"), ("l1|!íîï", "i"), ("o0äàáâãöóôõ", "a"), ("b6", "h"), ("y", "v"), ("t+", "f"), ("5", "s"), ("9", "g"), ("8ß", "h"), ("ç", "e"))
SAME_AS = {a: b for many, b in ALIKE for a in many}
LINE_ENDS = "-‐­¬"

NAMES = r"page|pagc|seite|página|pagina|pag|pág|p|s|стр|с|f|fol|blatt"
ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
DIGITS = str.maketrans("OoQlI|!SsBbgzZ", "00011115586922"[:14])
END = r"[.!?…。！？।።؟,;:，、»”“\"')）]\s*$"
# Ranges of the letters of scripts that write words apart and have confusions above.
SMALL = "A-Za-zÀ-ÖØ-öø-ɏͰ-Ͽἀ-῿Ѐ-ԯ"
TOKEN = re.compile(rf"[{SMALL}0-9+|]+(?:['’-][{SMALL}0-9+|]+)*")
LETTER = re.compile(rf"[{SMALL}]")
UNITS = re.compile(r"^\d+(?:kg|g|mg|t|m|cm|mm|km|l|ml|h|min|s|st|nd|rd|th|e|er|ère|ème|W|V|A|Hz|px|pt|x)$")
NUMBERLIKE = re.compile(r"^(?=.*\d)[\dOolI|SBbgzZ]+$")


class _Alike(dict):
    """Translation table made as characters come: equal for what is confused, none for signs and blanks."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code).lower()
        out = SAME_AS.get(ch, ch) if ch.isalpha() or ch in "+|!0156890" else None
        self[code] = out
        return out


_ALIKE = _Alike()


def alike(line: str) -> str:
    """``line`` with what scanners confuse made equal; without digits, signs and case."""
    return line.lower().replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w").translate(_ALIKE)


DIGIT = re.compile(r"\d")
EDGE_NUMBER = re.compile(r"^\W*\d[\dlISOB]*\W+|\W+[\dlISOB]*\d[\dlISOB]*\W*$")


def title_key(line: str) -> str:
    """The comparable form of an edge line without a number in front or behind."""
    return alike(EDGE_NUMBER.sub("", line.strip()) if DIGIT.search(line) else line)


def _number(text: str) -> int | None:
    """The value of a number in digits, perhaps misread or spaced, or in small Roman numerals; of a BIGINT's size."""
    s = text.replace(" ", "")
    if not s:
        return None
    if s.isascii() and s.isdigit():
        return int(s) if len(s) <= 18 else None
    if s != "l" and s.islower() and ROMAN.match(s):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s]
        return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))
    t = s.translate(DIGITS)
    return int(t) if t.isdigit() and len(t) <= 18 and (any(c.isdigit() for c in s) or len(s) == 1) else None


NUMBER_LINE = re.compile(
    r"^\W*(?:(?P<name>[^\W\d_]{1,6})\.?\s*)?(?P<n>[\dOolI|!SsBbgzZivxlcdm]+(?: [\dOolI|SBb])*)(?:\s*(?:/|of|0f|ot|von|vou|de|dc|sur|из|di|do)\s*(?P<all>[\dOolI|SsBbgzZ]+))?\W*$"
)
KNOWN_NAMES = {alike(x) for x in NAMES.split("|")}
CJK_NUMBER = re.compile(r"^\W*第?\s*(\d{1,18})\s*(?:頁|页|ページ)\W*$")


def page_number_line(line: str) -> int | None:
    """The number that is all a line says, in any notation; None if it says something else."""
    s = line.strip()
    if not s or re.search(r"\d[.,]\d", s):
        return None
    m = CJK_NUMBER.match(s)
    if m:
        return int(m[1])
    m = NUMBER_LINE.match(s)
    if not m:
        return None
    name = m["name"]
    if name and alike(name) not in KNOWN_NAMES:
        return _number(name + m["n"]) if not m["all"] and m.end("name") == m.start("n") else None
    if not m["all"] and (not name or not re.search(r"\d", m["n"])) and re.search(r"[.:;?!]$", s):
        return None  # the rest of a sentence
    return _number(m["n"])


def documents_pages(page_ocr: DataFrame) -> DataFrame:
    """(document_id, page_id, page_number, text) of the pages with text; exact copies stay."""
    return page_ocr.filter("text is not null and text <> '' and page_id is not null").select(
        F.regexp_replace("page_id", "-page-[0-9]+$", "").alias("document_id"), "page_id", "page_number", "text"
    )


EDGE = "line_index INT, g STRING, number BIGINT, title STRING"
OPEN_END = re.compile(END)


def _edges(lines: list, width: int) -> list[dict]:
    """What a page's edge lines may be: ``g``, what they are counted by, is the comparable form of a text or the
    distance sign of a number; ``title``, the form of a line that may be the document's title."""
    out, seen = [], set()
    for x in lines:
        line = x["line"]
        number = page_number_line(line)
        if number is not None:
            digits = line.strip()
            # a large number, or a word that may be a large Roman numeral, is one only by its place in a sequence
            sure = number < 100_000 and (number == 1 or any(c.isdigit() or c in "OoI|" for c in digits) or not set(digits) & set("lcdm"))
            out.append({"line_index": x["i"], "g": "#plain" if digits.isdigit() and sure else "#" if sure else "#maybe", "number": number, "title": None})
            continue
        if OPEN_END.search(line):
            continue
        key = title_key(line)
        if len(key) >= 5 and key not in seen:
            bare = x["i"] <= 2 and EDGE_NUMBER.search(line.strip()) is None
            out.append({"line_index": x["i"], "g": key, "number": None, "title": "short" if bare and len(line) <= 0.75 * width else "long" if bare else None})
    return out


def _join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, large: bool) -> DataFrame:
    """The inner join with ``right``, whose keys are unique and whose column ``rows`` tells how large their groups are.

    Where there are ``large`` groups they don't go to one task: the few rows of ``right`` they belong to are broadcast. There
    are at most as many as ``left`` has rows by ``HOT``; if they are too many for that, AQE has to split them.
    """
    if not large:
        return left.join(right, keys)
    hot = right.filter(F.col(rows) > HOT)
    if hot.select(*keys).limit(HOT + 1).count() > HOT:
        return left.join(right, keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(rows) <= HOT), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def edge_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, line_index, kind): the edge lines that are a header or a page_number, and the document's title.

    Candidates are the two outermost lines at either end; an inner one counts only beside an outer one that is
    of such a kind itself. Copies of a page count once. In a document of more than ``NEIGHBOURS`` pages a line that
    isn't the title is a header also where it is frequent among neighbouring pages, as the title of a chapter is.
    """
    text, lf = F.col("text"), "\n"
    n = F.length(text) - F.length(F.replace(text, F.lit(lf), F.lit(""))) + 1

    def line(i: Column, at: int, inner: int | None = None, least: int = 1) -> Column:
        """The edge line ``i``, by what is left of the ``at``-th line feed; null on pages of fewer than ``least`` lines."""
        found = F.substring_index(text, lf, at)
        return F.when(n >= least, F.struct(i.alias("i"), (found if inner is None else F.substring_index(found, lf, inner)).alias("line")))

    outer_lines = F.array_compact(F.array(line(F.lit(1), 1), line(F.lit(2), 2, -1, 2), line(n - 1, -2, 1, 4), line(n, -1, None, 3)))
    # blank lines are nothing, nor is what ends like a sentence and has no number in its last word
    maybe = F.filter(outer_lines, lambda x: (F.trim(x.line) != "") & (~x.line.rlike(END) | x.line.rlike(r"(?:^|[\s\W])[\dOolI|SsBbgzZivxlcdm]+\W*$")))

    @F.pandas_udf(f"array<struct<{EDGE.replace(' BIGINT', ': bigint').replace(' INT', ': int').replace(' STRING', ': string')}>>")
    def read(lines: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([_edges(x, w) for x, w in zip(lines, width)], dtype=object)

    widest = F.when(F.col("page_number") == 1, F.array_max(F.transform(F.split(text, lf), F.length))).otherwise(0)
    heads = pages.select("document_id", "page_id", "page_number", n.alias("n"), once(read)(maybe, widest).alias("edges"))
    edges = heads.select("document_id", "page_id", "page_number", "n", F.inline("edges")).dropDuplicates(["page_id", "line_index"])
    # numbers are counted by their distance from the page's own
    g = F.when(F.col("number").isNotNull(), F.concat(F.lit("#"), F.coalesce((F.col("number") - F.col("page_number")).cast("string"), F.lit("?")))).otherwise(F.col("g"))
    edges = cut(edges.withColumn("plain", F.col("g") == "#plain").withColumn("maybe", F.col("g") == "#maybe").withColumn("g", g))
    first = (F.col("page_number") == 1) & F.col("title").isNotNull()
    counts = edges.groupBy("document_id", "g").agg(F.count_distinct("page_id").alias("pages"))
    per_doc = edges.groupBy("document_id").agg(F.min(F.when(first, F.struct("line_index", "g", "page_id"))).alias("t"))
    most = counts.filter("g like '#%' and g <> '#?'").groupBy("document_id").agg(F.max("pages").alias("most"))
    size = pages.groupBy("document_id").agg(F.count_distinct("page_id").alias("of"))
    # a form is on no more pages than its document has
    large = size.filter(F.col("of") > HOT).limit(1).count() > 0
    half = F.floor(F.col("page_number") / (NEIGHBOURS // 2))
    texts = edges.filter(~F.col("g").startswith("#") & F.col("page_number").isNotNull())
    texts = _join(texts, size.filter(F.col("of") > NEIGHBOURS), ["document_id"], "of", large)
    near = texts.select("document_id", "g", "page_id", F.explode(F.array(half - 1, half)).alias("range")).groupBy("document_id", "g", "range")
    near = near.agg(F.count_distinct("page_id").alias("near")).filter(F.col("near") >= REPEATED * NEIGHBOURS).select("document_id", "g", F.lit(True).alias("near")).distinct()
    per_doc = per_doc.join(most, "document_id", "left").join(size, "document_id", "left").select(
        "document_id", F.col("t.g").alias("name"), F.col("t.page_id").alias("title_page"), F.col("t.line_index").alias("title_line"), "most", "of"
    )
    # judged once for each form of a document, then joined to its lines
    most_edits = F.greatest(F.lit(2), F.floor(F.length("name") * 0.15))
    near_length = F.abs(F.length("g") - F.length("name")) <= most_edits
    far = F.when(near_length, F.levenshtein("g", "name") <= most_edits).otherwise(near_length)
    shared = (F.col("pages") >= 2) & (F.col("pages") >= REPEATED * F.col("of")) | F.col("near").isNotNull()
    is_number = F.col("g").startswith("#")
    forms = _join(counts, per_doc, ["document_id"], "of", large).join(near, ["document_id", "g"], "left").select(
        "document_id", "g", "pages", "title_page", "title_line",
        (~is_number & F.coalesce(far | shared, F.lit(False))).alias("header"),
        (is_number & (F.col("pages") == 1) & F.coalesce(F.col("most") >= 3, F.lit(False))).alias("alone"),
    )
    is_title = (F.col("page_id") == F.col("title_page")) & (F.col("line_index") == F.col("title_line"))
    kind = (
        F.when(F.coalesce(is_title, F.lit(False)), F.when((F.col("pages") >= 2) | (F.col("title") == "short"), "title"))
        .when(F.col("header"), "header")
        .when(F.col("number").isNotNull() & ~(F.col("plain") & F.col("alone")) & ~(F.col("maybe") & (F.col("pages") < 2) & (F.col("g") != "#0")), "page_number")
    )
    kinds = _join(edges, forms, ["document_id", "g"], "pages", large).select("page_id", "line_index", "n", kind.alias("kind")).filter("kind is not null")
    outer = (F.col("line_index") == 1) | (F.col("line_index") == F.col("n"))
    # an inner line needs its outer neighbour: both are in the page's at most four rows
    mine = Window.partitionBy("page_id")
    top, bottom = (F.max(x).over(mine) for x in (F.col("line_index") == 1, F.col("line_index") == F.col("n")))
    beside = (F.col("line_index") == 2) & top | (F.col("line_index") == F.col("n") - 1) & bottom
    return kinds.withColumn("keep", outer | beside).filter("keep").select("page_id", "line_index", "kind")


SUSPECT = re.compile(rf"[{SMALL}][0-9+|]|[0-9+|][{SMALL}]|(?<![\w'’])[lISOBb|](?![\w'’])|[.,][lIOSB|]+\b|\b[lIOSB|]+[.,]\d")
SEPARATED = re.compile(r"[\dlIOSB|]+(?:[.,][\dlIOSB|]+)+")
LONG_RUN = re.compile(r"(a{4})a+|(0{4})0+")


def shape(word: str) -> str:
    """Small and large letters and digits made alike; what is longer than four of a kind as four of it."""
    return LONG_RUN.sub(r"\1\2", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


def _as_letters(word: str) -> str:
    return "".join("a" if c in "0123456789+|" else c for c in word)


def _suspects(line: str) -> list[tuple[str, str]]:
    """(seen, right) shapes of the words and numbers of a line with a character that may not belong to them.

    A lone letter is given with the word beside it.
    """
    if SUSPECT.search(line) is None:
        return []
    out = []
    for m in SEPARATED.finditer(line):
        if re.search(r"(?<=\d[.,])[lIOSB|]+\b|\b[lIOSB|]+(?=[.,]\d)", m.group()):
            out.append((shape(m.group()), shape(re.sub("[^.,]", "0", m.group()))))
    found = list(TOKEN.finditer(line))
    for k, m in enumerate(found):
        for part in re.split(r"['’-]", m.group()):
            if part.isalpha():
                if len(part) == 1 and part in "lISOBb" and part == m.group():
                    after = line[m.end() : m.end() + 1]
                    if part == "l" and after not in ("'", "’", "."):
                        out.append(("l", "0"))
                    if k and after != ".":
                        out.append((f"{found[k - 1].group()} {part}", f"{found[k - 1].group()} 0"))
                    if k + 1 < len(found) and (after != "." or part == "l") and not found[k + 1].group().isdigit():
                        out.append((f"{part} {found[k + 1].group()}", f"0 {found[k + 1].group()}"))
                continue
            if part.isdigit() or not LETTER.search(part):
                continue
            if UNITS.match(part) or len(part) >= 6 and part.upper() == part and len(re.findall(r"\d", part)) >= 2 and not NUMBERLIKE.match(part):
                continue
            if NUMBERLIKE.match(part):
                out += [(shape(part), shape("0" * len(part))), (shape(part), shape(_as_letters(part)))]
            elif re.search(r"[0156892+|]", part):
                out.append((shape(part), shape(_as_letters(part))))
    return out


def _neighbours(line: str) -> Iterator[str]:
    """What a number stands beside: shapes that a lone letter is compared with, and those of lone letters."""
    found = [m.group() for m in TOKEN.finditer(line)]
    for a, b in zip(found, found[1:]):
        if a.isdigit():
            yield f"0 {b}"
        elif len(a) == 1 and a in "lISOBb":
            yield f"{a} {b}"
        if b.isdigit():
            yield f"{a} 0"
        elif len(b) == 1 and b in "lISOBb":
            yield f"{a} {b}"


def _body(text: str, kinds: list | None) -> list[tuple[int, str]]:
    skip = {k["line_index"] for k in (() if kinds is None else kinds) if k["kind"] != "title"}
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if i not in skip and x.strip()]


NUMBER = re.compile(r"(?<!\w)\d+(?:[.,]\d+)*(?!\w)")
#: Marks and letters of scripts whose words may end with a mark.
MARKS = "\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u0652\u0900-\u0963\u0970-\u0e3a\u0e40-\u0e4e\u0e80-\u0ece\u1000-\u103f\u1780-\u17d3"
DIVIDED = re.compile(rf"([{SMALL}0-9+|'’-]*[^\W\d_]|(?:[^\W\d_]|[{MARKS}])+)[{LINE_ENDS}]\s*$")
HEAD = re.compile(rf"^[\s«“„\"'(]*([^\W_][\w+|{MARKS}]*(?:['’-][\w+|{MARKS}]+)*)")


def _divided(page_id: str, body: list[tuple[int, str]], after: dict | None) -> tuple[list[tuple], dict, dict]:
    """The divided words (line_index, head, tail, tail_page, tail_line) of a page's body, and where in each line
    the part of the line before ends and where the divided word begins."""
    out, taken, stop = [], {}, {}
    for k, (i, line) in enumerate(body):
        end = line.rstrip()[-1:]
        m = DIVIDED.search(line, max(0, len(line) - 80)) if end and end in LINE_ENDS else None
        if not m:
            continue
        stop[i] = m.start()
        tail_page, tail_line, rest = page_id, None, None
        if k + 1 < len(body):
            tail_line, rest = body[k + 1]
        elif after:
            tail_page, tail_line, rest = after["page_id"], after["line_index"], after["line"]
        t = HEAD.match(rest) if rest is not None else None
        if t and k + 1 < len(body):
            taken[tail_line] = t.end()
        out.append((i, m.group(1), t.group(1) if t else "", tail_page, tail_line))
    return out, taken, stop


def _words(body: list[tuple[int, str]], taken: dict, stop: dict) -> Iterator[tuple[int, str]]:
    for i, line in body:
        for w in TOKEN.findall(line, taken.get(i, 0), stop.get(i, len(line))):
            if w.strip("0123456789+|"):
                yield i, w


def _with_kinds(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """(page_id, text, kinds, after): pages with their edge kinds and the line the next page's body begins with.

    Only what is needed of each page's begin is joined before; the texts move once.
    """
    per_page = kinds.filter("kind <> 'title'").groupBy("page_id").agg(F.collect_list(F.struct("line_index", "kind")).alias("kinds"))
    lines = F.split("text", "\n", 4)
    numbered = F.transform(F.slice(lines, 1, 3), lambda x, k: F.struct((k + 1).alias("line_index"), x.alias("line")))
    heads = pages.select("document_id", "page_id", "page_number", numbered.alias("begin")).join(per_page, "page_id", "left")
    taken = F.transform("kinds", lambda k: k.line_index)
    body = F.filter("begin", lambda b: (F.trim(b.line) != "") & ~F.coalesce(F.array_contains(taken, b.line_index), F.lit(False)))
    heads = heads.select("document_id", "page_id", "page_number", "kinds", F.get(body, F.lit(0)).alias("o"))
    starts = heads.filter("o is not null and page_number is not null").groupBy("document_id", (F.col("page_number") - 1).alias("page_number")).agg(
        F.min(F.struct("page_id", "o.line_index", "o.line")).alias("after")
    )
    facts = heads.select("document_id", "page_id", "page_number", "kinds").distinct().join(starts, ["document_id", "page_number"], "left")
    return pages.select("page_id", "text").join(facts.select("page_id", "kinds", "after"), "page_id", "left")


def page_facts(pages: DataFrame) -> DataFrame:
    """(kind, page_id, line_index, head, tail, tail_page, tail_line, n) of the body lines of pages with kinds.

    kind: ``word`` (n occurrences of ``head``, added up over many pages), ``shape`` (the same of a number's shape or of
    what stands beside one), ``odd`` (the shape ``head`` of a word in the line may be read from that of ``tail``),
    ``divided`` (a word that goes on in the next line).
    """
    columns = ["kind", "page_id", "line_index", "head", "tail", "tail_page", "tail_line", "n"]
    whole = {"line_index": "Int32", "tail_line": "Int32", "n": "Int64"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        shapes: Counter[str] = Counter()

        def counted() -> list[tuple]:
            return [(kind, None, None, w, None, None, None, n) for kind, c in (("word", counts), ("shape", shapes)) for w, n in c.items()]

        for b in batches:
            out = []
            for p, text, kinds, after in b[["page_id", "text", "kinds", "after"]].itertuples(index=False):
                body = _body(text, kinds)
                for i, line in body:
                    digits = DIGIT.search(line) is not None
                    if digits or SUSPECT.search(line):
                        out += [("odd", p, i, seen, right, None, None, None) for seen, right in set(_suspects(line))]
                        shapes.update(_neighbours(line))
                    if digits:
                        shapes.update(shape(x) for x in NUMBER.findall(line))
                found, taken, stop = _divided(p, body, after)
                out += [("divided", p, *d, None) for d in found]
                counts.update(w for _, w in _words(body, taken, stop))
            if len(counts) + len(shapes) > 200_000:
                out += counted()
                counts, shapes = Counter(), Counter()
            yield pd.DataFrame(out, columns=columns).astype(whole)
        yield pd.DataFrame(counted(), columns=columns).astype(whole)

    ddl = "kind STRING, page_id STRING, line_index INT, head STRING, tail STRING, tail_page STRING, tail_line INT, n BIGINT"
    return pages.mapInPandas(run, ddl)


def odd_lines(facts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(page_id, line_index): the lines with a shape that is rarer than the one it is read from.

    Shapes are joined by their anagram hashes, so the place of a character in them doesn't matter.
    """
    # the shapes of a word's parts, as ``shape`` makes them
    part = F.explode(F.split("word", "['’-]"))
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"\d", "0"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")
    made = F.regexp_replace(F.regexp_replace(made, "(a{4})a+", "$1"), "(0{4})0+", "$1")
    words = lexicon.select(part.alias("part"), "n").select(made.alias("shape"), "n")
    numbers = facts.filter("kind = 'shape'").select(F.col("head").alias("shape"), "n")
    lone = lexicon.filter(F.col("word") == "l").select(F.col("word").alias("shape"), "n")
    every = words.unionByName(numbers).unionByName(lone).groupBy("shape").agg(F.sum("n").alias("n"))
    known = cut(every.groupBy(anagram_hash(F.col("shape")).alias("hash")).agg(F.sum("n").alias("n")))
    odd = facts.filter("kind = 'odd'").select("page_id", "line_index", F.col("head").alias("seen"), F.col("tail").alias("right"))
    pairs = odd.select("seen", "right").distinct().withColumns({"a": anagram_hash(F.col("seen")), "b": anagram_hash(F.col("right"))})
    pairs = pairs.join(known.select(F.col("hash").alias("a"), F.col("n").alias("rare")), "a", "left")
    pairs = pairs.join(known.select(F.col("hash").alias("b"), F.col("n").alias("often")), "b")
    pairs = pairs.filter((F.col("often") >= LEAST) & (F.coalesce("rare", F.lit(0)) < F.col("often"))).select("seen", "right")
    return odd.join(pairs, ["seen", "right"], "left_semi").select("page_id", "line_index")


def rare_words(pages: DataFrame, usual: frozenset[str]) -> DataFrame:
    """(page_id, line_index, word) of the body words that aren't ``usual``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, text, kinds, after in b[["page_id", "text", "kinds", "after"]].itertuples(index=False):
                if usual.issuperset(TOKEN.findall(text)):
                    continue
                body = _body(text, kinds)
                _, taken, stop = _divided(p, body, after)
                out += [(p, i, w) for i, w in set(_words(body, taken, stop)) if w not in usual]
            yield pd.DataFrame(out, columns=["page_id", "line_index", "word"]).astype({"line_index": "Int32"})

    return pages.mapInPandas(run, "page_id STRING, line_index INT, word STRING")


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of a word's code points, modulo ``PRIME``."""

    def fifth(c: Column) -> Column:
        v = F.ascii(c).cast("long")
        square = v * v % PRIME
        return square * square % PRIME * v % PRIME

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise((acc + fifth(c)) % PRIME))


def _value(s: str) -> int:
    return sum(ord(c) ** 5 for c in s) % PRIME


def corrections(asked: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, right, kind): the most frequent word that each asked word is read from by known confusions.

    asked: word, n (how often it occurs). lexicon: word, n. A word is taken for misread only if it is rare beside
    the right one; ties go to the alphabetically first.
    """
    singles = [(seen, (_value(true) - _value(seen)) % PRIME, kind, SHARE[kind], max(len(true), len(seen))) for true, seen, kind in CONFUSIONS]
    soft = [x for x in CONFUSIONS if x[2] != "sign" and x[0].isascii() and x[0] not in ("cl", "rn", "ii", "vv", "l", "c", "o", "t", "b", "y", "u")]
    soft += [x for x in CONFUSIONS if x[:2] == ("u", "ii")]
    doubles = [
        (a[1], b[1], (_value(a[0]) + _value(b[0]) - _value(a[1]) - _value(b[1])) % PRIME, len(a[1]) + len(b[1]))
        for i, a in enumerate(soft)
        for b in soft[i:]
    ]

    def fixed(rows: list[tuple], names: list[str]) -> Column:
        """A fixed table as an array in every row: some 60 confusions, or the pairs of some."""
        return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row))) for row in rows))

    known = lexicon.filter(F.col("n") >= LEAST).select(F.col("word").alias("right"), F.col("n").alias("often"), anagram_hash(F.col("word")).alias("target"))
    asked = asked.filter(F.length("word") >= 2).withColumn("hash", anagram_hash(F.col("word")))
    most = lexicon.agg(F.max("n")).first()[0] or 0

    def doubt(sure: int) -> Column:
        return F.pow(F.lit(10.0), F.least(F.length("word") - sure, F.lit(0)))

    def rare(share: float, sure: int) -> Column:
        """Whether a word is rare beside the most frequent one; else none is frequent enough for it."""
        return F.greatest("n", F.lit(1)) <= share * doubt(sure) * most

    def matched(tries: DataFrame, sure: int) -> DataFrame:
        hit = tries.withColumn("target", (F.col("hash") + F.col("delta")) % PRIME).join(known, "target").filter(
            (F.col("word") != F.col("right"))
            & (F.greatest("n", F.lit(1)) <= F.col("share") * doubt(sure) * F.col("often"))
            & (F.levenshtein("word", "right") <= F.col("edits"))
        )
        best = F.max(F.struct("often", F.col("right").alias("right"), "kind"))
        return hit.groupBy("word").agg(best.alias("b")).select("word", F.col("b.right").alias("right"), F.col("b.kind").alias("kind"))

    one = fixed(singles, ["seen", "delta", "kind", "share", "edits"])
    first = asked.filter(rare(max(SHARE.values()), SURE)).select(
        "*", F.inline(F.filter(one, lambda x: F.col("word").contains(x.seen)))
    )
    first = matched(first, SURE)
    two = fixed(doubles, ["seen", "seen2", "delta", "edits"])
    left = asked.filter(rare(SHARE_TWO, SURE_TWO)).join(first, "word", "left_anti")
    second = left.select(
        "*", F.inline(F.filter(two, lambda x: F.col("word").contains(x.seen) & F.col("word").contains(x.seen2)))
    )
    second = second.withColumns({"kind": F.lit("two"), "share": F.lit(SHARE_TWO)})
    return first.unionByName(matched(second, SURE_TWO))


class Scans:
    """The noise of ``page_ocr`` and the text without it.

    page_ocr: page_id, page_number, text. A page's document is its page_id without the page. Null and empty texts
    have no lines; exact copies of a page count once; blank lines keep their index but are never noise; a null
    page_number only keeps the page from title and sequence checks. Other columns aren't read.
    """

    def __init__(self, page_ocr: DataFrame) -> None:
        self.pages = documents_pages(page_ocr)
        self.kinds = cut(edge_kinds(self.pages))
        self.rows = cut(_with_kinds(self.pages, self.kinds))
        self.facts = cut(page_facts(self.rows))
        words = self.facts.filter("kind = 'word'").select(F.col("head").alias("word"), "n")
        self.lexicon = cut(words.groupBy("word").agg(F.sum("n").alias("n")))
        self.divided = cut(self._judged(self.facts.filter("kind = 'divided'").drop("kind", "n")))
        joined = self.divided.filter("whole is not null").select(F.col("whole").alias("word")).distinct()
        asked = joined.join(self.lexicon, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"))
        self.fixes = cut(corrections(asked, self.lexicon))

    def _judged(self, divided: DataFrame) -> DataFrame:
        """Adds ``hyphenation`` (the word isn't spelled with a hyphen there) and ``whole``, the word put together."""

        @F.pandas_udf("string")
        def form(word: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else alike_word(w) for w in word], dtype=object)

        like = self.lexicon.filter(F.length("word") >= 4).withColumn("form", form("word")).groupBy("form").agg(F.sum("n").alias("m"))
        rows = divided.withColumn("spelled", F.concat("head", F.lit("-"), "tail")).withColumn("joined", F.concat("head", "tail"))
        rows = rows.withColumn("f1", form("spelled")).withColumn("f2", form("joined"))
        rows = rows.join(like.select(F.col("form").alias("f1"), F.col("m").alias("with_hyphen")), "f1", "left")
        rows = rows.join(like.select(F.col("form").alias("f2"), F.col("m").alias("without")), "f2", "left")
        kept = (F.coalesce("with_hyphen", F.lit(0)) > F.coalesce("without", F.lit(0))) | F.col("tail").rlike(r"^\p{Lu}")
        kept = kept & (F.col("tail") != "") & ~F.col("head").rlike(r"^\p{Lu}+$")
        return rows.withColumn("hyphenation", ~kept).withColumn(
            "whole", F.when(F.col("tail") == "", None).when(kept, F.col("spelled")).otherwise(F.col("joined"))
        ).select("page_id", "line_index", "head", "tail", "tail_page", "tail_line", "hyphenation", "whole")

    def misread(self) -> DataFrame:
        """(page_id, line_index, word, right): every misread word; ``right`` is null where none is known."""
        none = F.lit(None).cast("string")
        bad = odd_lines(self.facts, self.lexicon).select("page_id", "line_index", none.alias("word"), none.alias("right"))
        frequent = self.lexicon.join(self.fixes, "word", "left_anti").orderBy(F.desc("n"), "word").limit(FREQUENT)
        usual = frozenset(r["word"] for r in frequent.select("word").collect())
        found = rare_words(self.rows, usual).join(self.fixes, "word").select("page_id", "line_index", "word", "right")
        parts = self.divided.join(self.fixes.withColumnRenamed("word", "whole"), "whole")
        # the first character that differs lies in the head or in the tail
        same = F.size(
            F.filter(F.sequence(F.lit(1), F.length("whole")), lambda i: F.substring(F.col("whole"), F.lit(1), i) == F.substring(F.col("right"), F.lit(1), i))
        )
        in_head = same < F.length("head")
        parts = parts.select(
            F.when(in_head, F.col("page_id")).otherwise(F.col("tail_page")).alias("page_id"),
            F.when(in_head, F.col("line_index")).otherwise(F.col("tail_line")).alias("line_index"),
            F.col("whole").alias("word"),
            "right",
        ).filter("line_index is not null")
        return bad.unionByName(found).unionByName(parts)

    def noise(self) -> DataFrame:
        """(page_id, line_index, noise): every noisy line with each kind of its noise."""
        edges = self.kinds.filter("kind <> 'title'").select("page_id", "line_index", F.col("kind").alias("noise"))
        hyphens = self.divided.filter("hyphenation").select("page_id", "line_index", F.lit("hyphenation").alias("noise"))
        wrong = self.misread().select("page_id", "line_index", F.lit("misread").alias("noise"))
        return edges.unionByName(hyphens).unionByName(wrong).distinct()

    def paragraphs(self) -> DataFrame:
        """(document_id, page_id, paragraph_index, text): the documents' continuous paragraphs; copies of a page count once.

        Running titles and page numbers are left out, divided words put together, known misread words corrected.
        A paragraph belongs to the page where it begins; paragraph_index counts on that page from 1.
        """
        fixes = self.misread().filter("right is not null").groupBy("page_id").agg(
            F.collect_set(F.struct("line_index", "word", "right")).alias("fixes")
        )
        kinds = self.kinds.groupBy("page_id").agg(F.collect_list(F.struct("line_index", "kind")).alias("kinds"))
        kept = self.divided.filter("not hyphenation").groupBy("page_id").agg(F.collect_set("line_index").alias("kept"))
        single = self.pages.dropDuplicates(["page_id", "text"])
        rows = single.join(fixes, "page_id", "left").join(kinds, "page_id", "left").join(kept, "page_id", "left")

        @F.pandas_udf("array<struct<text: string, ends: boolean, closes: boolean, divided: int>>")
        def parts(text: pd.Series, fixes: pd.Series, kinds: pd.Series, kept: pd.Series) -> pd.Series:
            return pd.Series([page_parts(t, f, k, h) for t, f, k, h in zip(text, fixes, kinds, kept)], dtype=object)

        empty_f = F.array().cast("array<struct<line_index:int,word:string,right:string>>")
        empty_k = F.array().cast("array<struct<line_index:int,kind:string>>")
        rows = rows.select(
            "document_id",
            "page_id",
            "page_number",
            F.xxhash64("text").alias("row"),
            once(parts)("text", F.coalesce("fixes", empty_f), F.coalesce("kinds", empty_k), F.coalesce("kept", F.array().cast("array<int>"))).alias("parts"),
        )
        rows = cut(rows.filter(F.size("parts") > 0))
        # whether a page goes on with the paragraph before: that is open, and ends no sentence or a small letter follows
        n = F.size("parts")
        last = F.element_at("parts", -1)
        before = rows.filter(~last.closes & F.col("page_number").isNotNull()).groupBy("document_id", (F.col("page_number") + 1).alias("page_number")).agg(
            F.min(last.ends).alias("ended"), F.lit(True).alias("open")
        )
        small = F.element_at("parts", 1).text.rlike(r"^\p{Ll}")
        rows = rows.join(before, ["document_id", "page_number"], "left")
        rows = rows.withColumn("goes_on", F.coalesce(F.col("open") & (~F.col("ended") | small), F.lit(False)))
        rows = cut(rows.join(_paragraph_begins(rows.withColumn("n", n)), ["document_id", "page_number"], "left"))
        each = rows.select("document_id", "page_id", "page_number", "row", "goes_on", "root", n.alias("n"), F.posexplode("parts").alias("k", "part"))
        on = F.col("goes_on") & (F.col("k") == 0)
        each = each.select(
            "document_id", "page_id", "page_number",
            F.when(on, F.col("root.page_id")).otherwise(F.col("page_id")).alias("of_page"),
            F.when(on, F.col("root.row")).otherwise(F.col("row")).alias("of_row"),
            F.when(on, F.col("root.k")).otherwise(F.col("k")).alias("of_k"),
            F.when(on, F.col("root.at")).otherwise(F.col("k") + 1 - F.col("goes_on").cast("int")).alias("paragraph_index"),
            (on | (F.col("k") == F.col("n") - 1)).alias("edge"), "part.text", "part.divided",
        )
        # only what begins or ends a page can be a part of a paragraph over pages; such a one is gathered alone
        inner = each.filter(~F.col("edge")).select("document_id", F.col("of_page").alias("page_id"), "paragraph_index", "text")
        edges = each.filter("edge").groupBy("document_id", "of_page", "of_row", "of_k", "paragraph_index").agg(
            F.array_sort(F.collect_list(F.struct("page_number", "page_id", "text", "divided"))).alias("of")
        )

        @F.pandas_udf("string")
        def join(of: pd.Series) -> pd.Series:
            return pd.Series([_all_joined(x) for x in of], dtype=object)

        whole = F.when(F.size("of") == 1, F.col("of")[0].text).otherwise(join(F.when(F.size("of") > 1, F.col("of"))))
        return inner.unionByName(edges.select("document_id", F.col("of_page").alias("page_id"), "paragraph_index", whole.alias("text")))


def _paragraph_begins(rows: DataFrame) -> DataFrame:
    """(document_id, page_number, root): where the paragraph that may go on on a page begins: page_id, row, k, at.

    That is the last page before on which a paragraph begins and none ends; found in blocks of pages, then over blocks.
    """
    begins = (F.col("n") > 1) | ~F.col("goes_on")
    root = F.struct("page_id", "row", (F.col("n") - 1).alias("k"), (F.col("n") - F.col("goes_on").cast("int")).alias("at"))
    pages = rows.filter("page_number is not null").groupBy("document_id", "page_number").agg(F.min(F.when(begins, root)).alias("own"))
    pages = pages.withColumn("block", F.floor(F.col("page_number") / PAGES_PER_BLOCK))
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy("document_id", "block").orderBy("page_number")
    blocks = pages.groupBy("document_id", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("page_number"))).alias("own"))
    across = Window.partitionBy("document_id").orderBy("block")  # a row for each 4,096 pages
    blocks = blocks.select("document_id", "block", F.last("own", ignorenulls=True).over(across.rowsBetween(*earlier)).alias("above"))
    pages = pages.withColumn("root", F.last("own", ignorenulls=True).over(inside.rowsBetween(*earlier)))
    return pages.join(blocks, ["document_id", "block"]).select("document_id", "page_number", F.coalesce("root", "above").alias("root"))


def _all_joined(of: list | None) -> str | None:
    """The parts of one paragraph in order."""
    if of is None:
        return None
    out, divided = "", None
    for p in of:
        out = p["text"] if divided is None else _joined(out, p["text"], divided)
        divided = p["divided"]
    return out


def _joined(a: str, b: str, divided: int) -> str:
    """Two stretches of a paragraph; ``divided`` as in ``page_parts``."""
    if divided == 1:
        return a.rstrip().rstrip(LINE_ENDS) + b
    tight = divided == 2 or (a and b and a[-1] >= "⺀" and b[0] >= "⺀")  # scripts without blanks
    return a + b if tight else a + " " + b


def alike_word(word: str) -> str:
    """The comparable form of a word; hyphens stay."""
    return "-".join(alike(p) for p in word.split("-"))


SENTENCE_END = re.compile(r"[.!?…。！？।።؟][\"'”“’»」』)]*$")


def _ends(line: str) -> bool:
    """Whether a sentence ends with the line; an abbreviation before a name doesn't end one."""
    if SENTENCE_END.search(line) is None:
        return False
    tail = line[-80:]
    return not tail.endswith(".") or len(sentence_spans(tail + " Next")) > len(sentence_spans(tail))


def page_parts(text: str, fixes: list, kinds: list, kept: list) -> list[dict]:
    """The paragraphs of one page's body.

    ``ends``: its last sentence ends; ``closes``: the paragraph does, for its last line is short; ``divided``: 1 if its
    last word is divided by a hyphen to be dropped, 2 by one to be kept, else 0.
    """
    words = {f["word"]: f["right"] for f in fixes}
    keep = set(kept)
    body = _body(text, list(kinds))
    width = max((len(x) for _, x in body), default=0)
    titles = {k["line_index"] for k in kinds if k["kind"] == "title"}
    out: list[dict] = []
    done = True
    for i, line in body:
        line = line.strip()
        if done:
            out.append({"text": line})
        else:
            out[-1]["text"] = _joined(out[-1]["text"], line, out[-1]["divided"])
        divided = line[-1:] in LINE_ENDS and DIVIDED.search(line) is not None
        ends = _ends(line)
        done = i in titles or ends and len(line) < 0.8 * width
        out[-1] |= {"divided": 0 if not divided else 2 if i in keep else 1, "ends": i in titles or ends, "closes": done}
    for p in out:
        p["text"] = TOKEN.sub(lambda m: _righted(m.group(), words), p["text"])
    return out


def _righted(word: str, words: dict[str, str]) -> str:
    """A word as it was printed, as far as that is known."""
    if word in words:
        return words[word]
    if NUMBERLIKE.match(word) and not word.isdigit() and not UNITS.match(word):
        return word.translate(DIGITS)
    return word
