"""Sentence units by cascading tables of break and no-break rules.

Candidate positions follow a run of terminators with its closing quotes and blanks, in Thai and Lao, which have no
terminators, a blank between letters. For each candidate the tables of the cascade are read in order: that of the
language around it, that of its script, the default. A rule is a pair of regular expressions, one for the text that
ends at the candidate and one for the text that begins there; the first rule whose both sides match decides whether
a unit ends. Where no rule matches, none does. Both sides see the whole text. The language is that of the function
words and letters around the candidate; each counts the less the farther it stands, and all count. Offsets are code
points of the stored text; matching is done on a form without invisible characters and width variants that keeps a
map to them.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once

# Abbreviations by how they behave, as alternatives of a pattern.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Fa|Sr|Sra|Srta|Dra|Mme|Mlle|MM|Hr|Fr|Ing|Dipl|Hon|Rev|Gen|Col|Capt|Lt|St|M|Exmo|Exma|Eng"
BEFORE_NUMBER = (
    "No|Nos|Nr|Fig|Figs|figs|fig|pp|p|pág|págs|pag|pags|art|arts|Art|núm|núms|num|Abb|Abs|Bd|Kap|S|Sec|Vol|vol|ch|Ch|Eq|"
    "Tab|Taf|Ziff|vs|ca|Ca|approx|Approx|aprox|Aprox|env|cf|Cf|vgl|al|nº|n|fl|fls|cap|tab|§"
)
NEVER_LAST = (
    r"z\. ?B|d\. ?h|u\. ?a|u\. ?ä|i\. ?d\. ?R|o\. ?ä|s\. ?o|s\. ?u|m\. ?E|bzw|vgl|i\.e|e\.g|p\. ?ej|p\. ?ex|c\.-à-d|vs|cf|viz|"
    r"approx|Approx|Aprox|aprox|sog|ggf|inkl|Abb|Fig|pág|núm"
)
MONTHS_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
RU_INSIDE = "т|гг|стр|рис|шт|им|ул|кв|см|ср|руб|коп|тыс|млн|млрд|напр|обл|табл|гл|пп|ст|с|п|р|д|г"
HI_TITLES = "डॉ|श्री|श्रीमती|प्रो|पं|कु|सं|क्र|रु|मो"
AR_TITLES = "د|أ|م|ص|ق|ه"

OPEN = r"[«“„‘「『《〈\"'(\[¿¡‹]"

#: Tables of (break?, pattern before, pattern after).
TABLES = {
    "de": (
        (False, r"(?<![\w.,])\d{1,2}\.$", r"\p{Lu}\p{Ll}"),
        (False, r"(?<!\w)(?:St|Str|Hbf|Inh|Geb|gest|geb|Mio|Mrd)\.$", r"[\p{L}\d]"),
    ),
    "fr": ((False, r"(?<!\w)(?:av|apr|éd|chap|boul|dép|ex)\.$", r"[\p{Ll}\d]"),),
    "es": ((False, r"(?<!\w)(?:Ud|Uds|Avda|Sto|Sta|EE)\.$", r"\p{Lu}"),),
    "pt": ((False, r"(?<!\w)(?:Av|Exmos|Exmas|n\.º|D)\.$", r"[\p{Lu}\d]"),),
    "en": ((False, r"(?<!\w)(?:Jan|Feb|Mar|Apr|Aug|Sept|Oct|Nov|Dec)\.$", r"\d"),),
    "ru": (
        (False, rf"(?<!\w)(?:{RU_INSIDE})\.$", r"[\p{Ll}\d,]"),
        (False, r"(?<!\w)(?:им|ул|пос|проф|акад|тов|гор)\.$", r"\p{Lu}"),
        (False, r"(?<!\d\s?)(?<!\w)г\.$", r"\p{Lu}"),
    ),
    "hi": ((False, rf"(?<![\p{{L}}\p{{M}}])(?:{HI_TITLES})\.$", r"."),),
    "ar": ((False, rf"(?<![\p{{L}}\p{{M}}])(?:{AR_TITLES})\.$", r"."),),
    "el": ((False, r"(?<!\w)(?:κ|κα|δρ|αρ|σελ|βλ|π\.χ|δηλ|κεφ|αι)\.$", r"[\p{Greek}\d]"),),
    "th": (
        (False, r"(?<=[ๆຯ])$", r"."),
        (False, r"", r"(?:[ๆฯຯ]|และ|หรือ|แต่|ที่|ซึ่ง|โดย|เพราะ|ແລະ|ຫຼື)"),
        (False, r"(?:และ|หรือ|แต่|ที่|ซึ่ง|โดย|ແລະ|ຫຼື)$", r"."),
        (True, r"[\p{Thai}\p{Lao}]\p{M}*$", r"[\p{Thai}\p{Lao}]"),
    ),
    "latin": (
        (False, rf"(?<![\w.])(?:{TITLES})\.$", r"[\p{Lu}\d]"),
        (False, rf"(?<![\w.])(?:{BEFORE_NUMBER})\.$", r"[\d(]"),
        (False, rf"(?<![\w.])(?:{NEVER_LAST})\.$", r"."),
        (False, r"(?<![\w.,])\d{1,2}\.$", rf"(?:{MONTHS_DE})\b"),
        (False, r"(?<!\w)\p{Lu}\.-\p{Lu}\.$", r"\p{Lu}"),
    ),
    "default": (
        (False, r"", r"[,;:)\]、，；：؛،፣፤…]"),
        (False, r"", r"[—–-]\s*\p{Ll}"),
        (False, r"\d\.$", r"\d"),
        (False, r"(?<![\w.])\p{L}\.$", r"\p{L}\."),
        (False, r"(?<![\w.])\p{Lu}\.$", r"\p{Lu}"),
        (False, r"[!?！？。؟｡]\s?[」』”’»)）]+$", rf"(?:\p{{Lo}}|[\p{{P}}--{OPEN}])"),
        (False, r"[。！？｡]\s?[」』”’)）]+$", r"[^「『“\n]"),
        (False, r"[.!?…][^\p{L}\p{N}]*$", r"\p{Ll}"),
        (True, r"[。！？｡।॥።፧؟۔։။។៕།༎᠃᠉꧉᭟]\p{P}*$", r"."),
        (True, r"\p{Greek}\p{M}*;$", rf"(?:\p{{Lu}}|{OPEN})"),
        (True, r"[!?…]\s?[\p{P}]*$", r"."),
        (True, r"\p{L}\p{M}*\p{L}\p{M}*\.\s?[\p{P}]*$", r"\d"),
        (True, r"\.\s?\p{P}*$", rf"(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}]|{OPEN})"),
    ),
}

#: Language -> tables in the order they are read.
CASCADE = {
    "en": ("en", "latin", "default"),
    "de": ("de", "latin", "default"),
    "fr": ("fr", "latin", "default"),
    "es": ("es", "latin", "default"),
    "pt": ("pt", "latin", "default"),
    "ru": ("ru", "default"),
    "hi": ("hi", "default"),
    "ar": ("ar", "default"),
    "el": ("el", "default"),
    "th": ("th", "default"),
    "": ("latin", "default"),
}

# The most frequent function words of the languages in Latin script.
WORDS = {
    "en": "the of and to in is that was which by are were be with for not his her they this it as from at an has had have or but its",
    "de": "der die das und den dem des ein eine ist war wurde nicht mit von zu auf für im sich als auch es an bei nach aus wie vor wird sind",
    "fr": "le la les des du et est que qui dans pour une un sur par pas avec ne se au ce il elle été sont aux ou plus mais",
    "es": "el la los las de del y que en un una por con para se no es su al lo como más fue ya está pero sus",
    "pt": "o a os as do da dos das e que em um uma por com para não se no na ao mais foi é como mas seu sua já",
}
VOTES = {w: [k for k, x in WORDS.items() if w in x.split()] for v in WORDS.values() for w in v.split()}
VOTE = regex.compile(r"\b(?:" + "|".join(sorted(VOTES, key=len, reverse=True)) + r")\b", regex.I)
#: Characters over which what a word or letter says of the language falls to a third.
REACH = 300

CANDIDATE = regex.compile(
    r"(?:[.!?…]+(?:[\"'“”’»\)\]]|\s?»)*|(?:[।॥።፧؟۔։။។៕།༎᠃᠉꧉᭟]+|(?<=\p{Greek}\p{M}*);)[\"'”’»\)\]]*)(?:(\s+)|$)"
    r"|[。！？｡]+(?:\s?[」』”’）)])*(\s*)"
    r"|(?<=[\p{Thai}\p{Lao}]\p{M}*)(\p{Zs}+)(?=[\p{Thai}\p{Lao}])"
)
NONE = regex.compile(r"[\p{Cf}\p{Zs}\p{Block=Halfwidth and Fullwidth Forms}\p{Block=Mathematical Alphanumeric Symbols};--[ ，。！？、：；（）]]", regex.V1)
OTHER = regex.compile(r"[\p{Devanagari}\p{Arabic}\p{Cyrillic}\p{Greek}\p{Thai}\p{Lao}]")
LETTERS = regex.compile(
    r"(?P<hi>\p{Devanagari}+)|(?P<ar>\p{Arabic}+)|(?P<ru>\p{Cyrillic}+)|(?P<el>\p{Greek}+)|(?P<th>[\p{Thai}\p{Lao}]+)|(?P<latin>\p{Latin}+)"
)


@lru_cache(maxsize=None)
def _rules(language: str) -> tuple:
    """(decides, pattern that is matched where the text before a candidate ends)."""
    return tuple(
        (decides, regex.compile((f"(?<={before.removesuffix('$')})" if before else "") + rf"\s*+(?:{after})", regex.V1))
        for name in CASCADE[language]
        for decides, before, after in TABLES[name]
    )


def _plain(text: str) -> tuple[str, list[int] | None]:
    """A form for matching and, unless it is the text itself, the offset of each of its characters."""
    if NONE.search(text) is None:
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        if ch >= "\x80":
            kind = unicodedata.category(ch)
            if kind == "Cf":
                continue
            if kind == "Zs":
                ch = " "
            elif ch not in "，。！？、：；（）":
                form = unicodedata.normalize("NFKC", ch)
                ch = form if len(form) == 1 else ch
        out.append(ch)
        at.append(i)
    return "".join(out), at


def _sums(said: list[tuple[int, str, float]], places: list[int]) -> list[dict[str, float]]:
    """What is said for each name at each place, by all of ``said`` (position, name, weight) on both sides of it."""
    out: list[dict[str, float]] = [{} for _ in places]
    for forward in (True, False):
        sums: dict[str, float] = {}
        last, k = 0, 0
        ordered = said if forward else said[::-1]
        for n in range(len(places)) if forward else range(len(places) - 1, -1, -1):
            at = places[n]
            while k < len(ordered) and (ordered[k][0] < at if forward else ordered[k][0] >= at):
                where, name, weight = ordered[k]
                faded = math.exp(-abs(where - last) / REACH)
                sums = {x: v * faded for x, v in sums.items()}
                sums[name] = sums.get(name, 0.0) + weight
                last, k = where, k + 1
            faded = math.exp(-abs(at - last) / REACH)
            for x, v in sums.items():
                out[n][x] = out[n].get(x, 0.0) + v * faded
    return out


def languages(text: str, places: list[int]) -> list[str]:
    """The language whose rules hold at each place of a text; "" where only Latin letters or others are around."""
    votes = [(m.start(), k, 1.0) for m in VOTE.finditer(text) for k in VOTES.get(m.group().lower(), ())]
    found = [max(s, key=s.get) if s else "" for s in _sums(votes, places)]
    if OTHER.search(text):
        letters = [(m.start(), m.lastgroup, float(len(m.group()))) for m in LETTERS.finditer(text)]
        scripts = [max(s, key=s.get) if s else "latin" for s in _sums(letters, places)]
        found = [own if script == "latin" else script for own, script in zip(found, scripts)]
    return found


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the units of one text: trimmed, in order, blank ones left out."""
    if not text or text.isspace():
        return []
    form, at = _plain(text)
    starts = [0]
    places = []
    for m in CANDIDATE.finditer(form):
        end = m.end()
        if end < len(form):
            blank = m.group(1) or m.group(2) or m.group(3) or ""
            places.append((end - len(blank), end))
    for (stop, end), name in zip(places, languages(form, [p[0] for p in places]) if places else ()):
        for decides, rule in _rules(name):
            if rule.match(form, stop):
                if decides:
                    starts.append(end)
                break
    out = []
    where = (lambda i: i) if at is None else (lambda i: at[i] if i < len(at) else len(text))
    marks = [0 if s == 0 else where(s) for s in starts] + [len(text)]
    for s, e in zip(marks, marks[1:]):
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip())
        right = len(piece.rstrip())
        if right > left:
            out.append((s + left, s + right))
    return out


def split_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one row for each sentence unit of ``text_col``.

    Added: sentence_index (from 1), sentence_start and sentence_end (code points of the stored text, trimmed),
    sentence. The first unit starts at the first non-blank character. Null, empty and blank texts have no units;
    repeated rows give theirs again. A column of an added name in ``df`` is replaced. One Arrow pass, no shuffle.
    """

    @F.pandas_udf("array<struct<s: int, e: int>>")
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e} for s, e in sentence_spans(t)] for t in text], dtype=object)

    added = ["sentence_index", "sentence_start", "sentence_end", "sentence"]
    kept = [c for c in df.columns if c not in added or c == text_col]
    rows = df.select(*kept).withColumn("_spans", once(spans)(F.col(text_col)))
    rows = rows.select(*kept, F.posexplode("_spans").alias("_n", "_span"))
    s, e = F.col("_span.s"), F.col("_span.e")
    return rows.select(
        *[c for c in kept if c not in added],
        (F.col("_n") + 1).alias("sentence_index"),
        s.alias("sentence_start"),
        e.alias("sentence_end"),
        F.substring(F.col(text_col), s + 1, e - s).alias("sentence"),
    )


def evidence_texts(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(record_id, citation_index, text) of every chunk and every cited excerpt; repeated rows stay."""
    of_chunks = chunks.select(F.col("chunk_id").alias("record_id"), F.lit(0).alias("citation_index"), "text")
    of_answers = answers.select("query_id", F.explode("citations").alias("c")).select(
        F.col("query_id").alias("record_id"), F.col("c.citation_index").alias("citation_index"), F.col("c.excerpt").alias("text")
    )
    return of_chunks.unionByName(of_answers)
