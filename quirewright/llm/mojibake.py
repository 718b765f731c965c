"""Text decoded with a wrong encoding: finding and restoring it.

A segment of text is the start of a graph whose edges are encode, decode and unescape operations. Best-first
search expands the cheapest state first; states already seen are known by their hash. The search ends by cost
alone: when the steps to what is left cost more than the best text, or that has nothing odd. Every step costs more than a text
may cost more than the one before it, so texts on a path become ever more plausible and paths end.

The cost of a text is its implausibility: for each pair of neighbouring characters that isn't plain ASCII, what
kinds of characters meet (controls, odd signs inside words, scripts mixed, capitals after small letters) and how
rare the pair is in the corpus; for each question mark inside a word or before one, that of a lost letter, unless it
stands in an address, or between words that the corpus has. Pairs are counted over all documents. Kept are those whose
count changes their cost; code points below a share of the corpus count by their kind. Both are shares, so
the tables are bounded and a corpus ten times as large is judged alike.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, cut

#: Least share of the characters outside ASCII, or of all words, with which a code point or a word counts by itself.
LEAST_SHARE = 1e-6
#: What an operation costs, and what a restored text must gain at least.
STEP, GAIN = 0.6, 2.0
#: A pair's rarity counts from this many nats on, by this weight, up to this much.
USUAL, WEIGHT, MOST = 7.0, 0.7, 6.0
#: How much more than the text before it a text may cost; less than the two steps between them.
SLACK = 1.0
#: What a character that can't be read costs, and a letter of the thousands of Chinese and Japanese below the least share.
UNREADABLE, SELDOM = 8.0, 4.0
#: A segment with a pair that costs more than this is worth a search.
ODD = 2.2

# Encodings a text may have been read in by mistake, and those it may have been written in.
READ_AS = ("windows-1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15", "cp1254")
WRITTEN_IN = ("utf-8", "windows-1252", "cp1251", "koi8-r", "cp866", "gb18030", "cp932", "euc_jp", "big5", "euc_kr", "mac_roman", "cp437", "cp1250")
#: Readings that leave the bytes of another encoding in place; UTF-8 goes with any reading.
MULTI = ("gb18030", "cp932", "euc_jp", "big5", "euc_kr")
SINGLE = {
    ("latin-1", "windows-1252"),
    ("windows-1252", "cp1251"), ("windows-1252", "koi8-r"), ("windows-1252", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1250", "windows-1252"), ("iso8859-2", "windows-1252"), ("mac_roman", "windows-1252"),
    ("cp437", "windows-1252"), ("cp850", "windows-1252"), ("cp1251", "windows-1252"), ("windows-1252", "mac_roman"),
    ("windows-1252", "cp437"), ("windows-1252", "cp1250"), ("koi8-r", "windows-1252"),
}

# Signs of ordinary text outside ASCII.
ORDINARY = set("“”„‘’‚«»‹›¿¡…–—·°€§№ªº½¼¾×±²³®©™£¥•。、，！？：；「」『』（）《》・々ー।॥،؟؛።፣፤፧")
LOOSE = set("€©®™£¥§±×½¼¾•²³‚‹›")
RUN = re.compile(r"[^\x00-\x7f]+")
C1 = re.compile("[\x80-\x9f]")
#: What a UTF-8 sequence looks like when it is read byte by byte in a western encoding.
_HIGH = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
SEQUENCE = re.compile(f"[Â-ß]{_HIGH}|[à-ï]{_HIGH}{{2}}")
OTHER = re.compile(r"[Ͱ-῿぀-퟿]")
BEFORE_SMALL = re.compile(r"\?[a-zß-öø-ÿ]")
ESCAPED = re.compile(r"&#?\w+;|\\u[0-9a-fA-F]{4}|%[0-9A-Fa-f]{2}%|=[0-9A-F]{2}=")
#: A question mark where a letter was: before a small letter, not after the end of a sentence.
LOST = re.compile(r"(?:(?<=[^\W\d_])|(?<=[\s(«“„])|^)\?+(?=[a-zß-öø-ÿ])")
#: What an address has and a word doesn't.
ADDRESS = r"[/=&@\\]|www\."
BEFORE, AFTER, IN_ADDRESS = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+"), re.compile(ADDRESS)


def _kind(ch: str) -> str:
    """The symbol of a code point outside the alphabet."""
    name = unicodedata.name(ch, "?").split(" ")[0]
    return unicodedata.category(ch) + (name if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "LATIN", "CYRILLIC", "GREEK", "ARABIC", "DEVANAGARI") else "")


def _runs(text: str) -> Iterator[str]:
    """The stretches outside ASCII, each with the character before and after it on its line."""
    for m in RUN.finditer(text):
        i = m.start()
        yield (text[i - 1 : m.end() + 1] if i else " " + text[: m.end() + 1]).replace("\n", " ")


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of ``text``; a lost character becomes a byte that no UTF-8 text has. None if it can't be encoded."""
    try:
        if codec == "latin-1" and "�" not in text:
            return text.encode("latin-1") if C1.search(text) else None
        if codec == "windows-1252":
            try:
                return text.encode("cp1252")
            except UnicodeEncodeError:
                out = bytearray()
                for ch in text:
                    if ch == "�":
                        out.append(0xFF)
                    elif "\x80" <= ch <= "\x9f":
                        out.append(ord(ch))
                    else:
                        out += ch.encode("cp1252")
                return bytes(out)
        if "�" in text:
            return b"\xff".join(x.encode(codec) for x in text.split("�"))
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, codec: str) -> str | None:
    if codec == "windows-1252":
        try:
            return data.decode("cp1252")
        except UnicodeDecodeError:
            return data.decode("latin-1")
    return data.decode(codec, "replace")


def _unescape(text: str) -> Iterator[tuple[str, str]]:
    if "&" in text:
        yield "html", html.unescape(text)
    if "\\u" in text:
        units = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        yield "backslash", units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # halves of a pair become one
    if re.search(r"%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}", text):
        yield "percent", unquote(text, errors="replace")
    if re.search(r"=[0-9A-F]{2}=[0-9A-F]{2}", text):
        yield "quoted", re.sub(r"(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), text)


@lru_cache(maxsize=1 << 17)
def _place(ch: str) -> str:
    """Script of a letter or mark; "" for anything else."""
    if ch < "\x80":
        return "ASCII" if ch.isalpha() else ""
    if unicodedata.category(ch)[0] not in "LM":
        return ""
    name = unicodedata.name(ch, "?").split(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else name


def _shape(a: str, b: str) -> float:
    """Implausibility of ``b`` after ``a`` by what kinds of characters they are."""
    cost = 0.0
    kind = unicodedata.category(b)
    left, right = _place(a), _place(b)
    if b >= "\x80":
        if kind in ("Cc", "Co", "Cn", "Cs") or b == "�":
            cost += UNREADABLE
        elif right:
            cost += 1.0 if right == "LATIN" else 0.5 if right != "HALFWIDTH" else 4.0
        else:
            cost += 0.7 if b in ORDINARY else 3.0
    odd_a, odd_b = (x >= "\x80" and not _place(x) and (x not in ORDINARY or x in LOOSE) for x in (a, b))
    if left and odd_b or right and odd_a:
        cost += 2.5
    if left and right:
        if {left, right} == {"ASCII", "LATIN"} or left == right:
            if a.islower() and b.isupper():
                cost += 4.0
            elif left == right == "LATIN":
                cost += 1.2
        elif {left, right} != {"ASCII", "CJK"}:
            cost += 4.0
    return cost


class Plausibility:
    """Cost of text by the kinds of neighbouring characters and by how often the corpus has them so."""

    def __init__(self, chars: dict[str, int], pairs: dict[str, int], total: int | None = None, known: frozenset[str] = frozenset()) -> None:
        """``total``: all pairs of the corpus, also those left out; ``known``: words that it has also beside a question mark."""
        self.chars, self.pairs, self.known = chars, pairs, known
        self.total = max(1, sum(pairs.values()) if total is None else total)
        self.least = max(1.0, LEAST_SHARE * sum(chars.values()))
        self.kinds = Counter()  # how often each kind of the code points that don't count by themselves occurs
        for form, n in pairs.items():
            b = form.split("\0")[1]
            if len(b) > 1:
                self.kinds[b] += n
        self.cost_of: dict[tuple[str, str], float] = {}
        self.words: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.plain = {p for p in (tuple(k.split("\0")) for k in pairs) if len(p[0]) == len(p[1]) == 1 and self.pair(*p) <= ODD}

    def symbol(self, ch: str) -> str:
        return ch if ch in self.chars else _kind(ch)

    def pair(self, a: str, b: str) -> float:
        known = self.cost_of.get((a, b))
        if known is None:
            x, y = self.symbol(a), self.symbol(b)
            n = self.pairs.get(x + "\0" + y, 0)
            for kind in (x, y):
                if len(kind) > 1 and n:  # one of its kind, and has no more than the least share
                    n *= min(1.0, self.least / max(1, self.kinds[kind]))
            rare = WEIGHT * (-math.log((n + 0.05) / self.total) - USUAL)
            known = _shape(a, b) + min(MOST, max(0.0, rare))
            if b not in self.chars and _place(b) == "CJK":
                known += SELDOM
            self.cost_of[a, b] = known
        return known

    def text(self, text: str) -> float:
        total = 0.0
        for run in _runs(text):
            total += sum(map(self.pair, run, run[1:]))
            if "a" <= run[0] <= "z" and "a" <= run[-1] <= "z" and len(run) > 2 and any(_place(c) == "CJK" for c in run):
                total += UNREADABLE  # a Latin word isn't written with such letters inside
        if ESCAPED.search(text):
            total += 4.0 * sum(html.unescape(m) != m or m[0] != "&" for m in ESCAPED.findall(text))
        return total + self.marks(text)

    def marks(self, text: str) -> float:
        """Cost of the question marks of ``text`` that stand for letters."""
        if BEFORE_SMALL.search(text) is None:
            return 0.0
        return UNREADABLE * sum(not self._asks(text, m) for m in LOST.finditer(text))

    def _asks(self, text: str, m: re.Match) -> bool:
        """Whether a question mark before a small letter is one: in an address, or between words of their own."""
        begin = max(text.rfind(c, 0, m.start()) for c in " \n\t\u00a0") + 1
        ends = [e for c in " \n\t\u00a0" if (e := text.find(c, m.end())) >= 0]
        if IN_ADDRESS.search(text, begin, min(ends, default=len(text))):
            return True
        before, after = BEFORE.search(text[begin : m.start()]), AFTER.match(text, m.end())
        return after.group().lower() in self.known and (before.group().lower() in self.known if before else len(after.group()) > 1)

    def lost(self, text: str) -> bool:
        """Whether characters of ``text`` are lost: it has marks for them that cost too much to be meant."""
        return "�" in text or self.marks(text) > ODD

    def odd(self, text: str) -> bool:
        """Whether ``text`` is implausible enough for a search."""
        if SEQUENCE.search(text):
            return True
        for run in _runs(text):
            if not self.plain.issuperset(zip(run, run[1:])) and any(self.pair(a, b) > ODD for a, b in zip(run, run[1:])):
                return True
        return False


def _steps(state: str, seen: set[int]) -> Iterator[tuple[tuple[str, ...], str]]:
    """The texts not seen yet that one unescape, or one encode and one decode, lead to from ``state``."""
    for name, new in _unescape(state):
        if hash(new) not in seen:
            seen.add(hash(new))
            yield (name,), new
    lost = "�" in state
    for read in READ_AS:
        data = _encode(state, read)
        if data is None or hash((read, data)) in seen:
            continue
        seen.add(hash((read, data)))
        for codec in WRITTEN_IN:
            # a lost character is a byte that only UTF-8 is sure not to have
            other = not lost and (codec in MULTI and read == "windows-1252" or (read, codec) in SINGLE)
            if codec != read and (codec == "utf-8" or other):
                new = _decode(data, codec)
                if new is not None and hash(new) not in seen:
                    seen.add(hash(new))
                    yield (read, codec), new


def restore(text: str, model: Plausibility, gain: float = GAIN) -> tuple[str, tuple[str, ...]]:
    """The cheapest text reachable from ``text`` and the operations that lead there; itself and () if none is better."""
    start = model.text(text)
    best, best_path, best_cost = text, (), start
    other = len(OTHER.findall(text))
    heap: list[tuple[float, int, str, tuple[str, ...]]] = [(start, 0, text, ())]
    seen = {hash(text)}
    order = 0
    while heap:
        cost, _, state, path = heapq.heappop(heap)
        if best_path and not model.odd(best):
            break
        if STEP * (len(path) + 1) >= best_cost:
            continue  # the steps alone cost as much as the best
        for names, new in _steps(state, seen):
            to = (*path, *names)
            price = model.text(new) + STEP * len(to)
            # valid UTF-8 is evidence by itself; a second round of other encodings, or a letter or two of another
            # script, needs more
            utf8 = names[-1] == "utf-8"
            few = not utf8 and 0 < len(OTHER.findall(new)) - other < 3
            least = gain / 2 if utf8 else gain * (4 if few or len(to) > 2 and "utf-8" not in to else 1)
            if price < best_cost and price < start - least:
                best, best_path, best_cost = new, to, price
                if utf8 and not model.odd(new):
                    return best, best_path  # nothing is left to be doubted
            if price <= cost + SLACK:
                order += 1
                heapq.heappush(heap, (price, order, new, to))
    return best, best_path


def _word(word: str, model: Plausibility) -> tuple[str, tuple[str, ...]]:
    """``restore`` of a word, remembered if it is short: names and signs come again."""
    if len(word) > 40:
        return restore(word, model, GAIN / 2)
    known = model.words.get(word)
    if known is None:
        if len(model.words) > 100_000:
            model.words.clear()
        known = model.words[word] = restore(word, model, GAIN / 2)
    return known


def repair(text: str, model: Plausibility) -> tuple[str, list[str], bool]:
    """Restored text, the distinct operation paths used, and whether characters are lost in ``text``."""
    lost = model.lost(text)
    escaped = any(x in text for x in "&\\%=") and ESCAPED.search(text) is not None
    if not escaped and (text.isascii() or not model.odd(text)):
        return text, [], lost
    out, paths = [], []
    for line in text.split("\n"):
        if escaped and ESCAPED.search(line):
            done, path = restore(line, model)
        elif line.isascii() or not any(_word(w, model)[1] for w in line.split(" ") if not w.isascii() and model.odd(w)):
            done, path = line, ()
        else:
            # a word of the line is garbled, so perhaps all of it
            done, path = restore(line, model)
            if not path or model.odd(done):
                again = []
                for word in done.split(" "):
                    new, own = restore(word, model) if not word.isascii() and model.odd(word) else (word, ())
                    again.append(new)
                    if own:
                        paths.append(">".join(own))
                done = " ".join(again)
        if path:
            paths.append(">".join(path))
        out.append(done)
    return "\n".join(out), sorted(set(paths)), lost


def fit(docs: DataFrame, col: str = "text", least_share: float = LEAST_SHARE) -> Plausibility:
    """The plausibility of a corpus, counted over all its texts.

    Collected are the code points with ``least_share`` of the characters (at most 1 / ``least_share``, and no more than
    are assigned), the pairs of them and of the kinds of the rest whose count changes what they cost (at most
    ``exp(USUAL + MOST / WEIGHT)``, some 6 million in theory), and the words beside question marks with that share.
    """
    every = docs.select(F.col(col).alias("_t"))
    texts = every.filter(F.col("_t").rlike(r"[^\x00-\x7f]"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b["_t"]:
                for run in _runs(t):
                    n.update(zip(run, run[1:]))
            if len(n) > 500_000:
                yield pd.DataFrame([(x, y, k) for (x, y), k in n.items()], columns=["a", "b", "n"])
                n = Counter()
        yield pd.DataFrame([(x, y, k) for (x, y), k in n.items()], columns=["a", "b", "n"])

    # one pass over the texts; what follows is over pairs of code points
    raw = cut(texts.mapInPandas(count, "a STRING, b STRING, n BIGINT").groupBy("a", "b").agg(F.sum("n").alias("n")))
    foreign = F.col("b").rlike(r"[^\x00-\x7f]")
    sums = raw.agg(F.sum("n").alias("pairs"), F.sum(F.when(foreign, F.col("n"))).alias("chars")).first()
    total, least = sums["pairs"] or 0, (sums["chars"] or 0) * least_share
    chars = raw.filter(foreign).groupBy("b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = {r["b"]: r["n"] for r in bounded_rows(chars, 300_000, "code points")}
    top |= {chr(c): 1 for c in range(128)}
    known = frozenset(top)

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol = lru_cache(maxsize=1 << 16)(lambda ch: ch if ch in known else _kind(ch))
        for b in batches:
            yield pd.DataFrame({"form": [symbol(x) + "\0" + symbol(y) for x, y in zip(b["a"], b["b"])], "n": b["n"]})

    pairs = raw.mapInPandas(symbols, "form STRING, n BIGINT").groupBy("form").agg(F.sum("n").alias("n"))
    pairs = pairs.filter(F.col("n") + 0.05 > total * math.exp(-USUAL - MOST / WEIGHT))  # the others cost what an unseen one does
    found = {r["form"]: r["n"] for r in bounded_rows(pairs, 6_000_000, "pairs")}
    return Plausibility(top, found, total, _words_beside_marks(every, least_share))


def _words_beside_marks(texts: DataFrame, least_share: float) -> frozenset[str]:
    """The words that stand before or after a question mark without a blank, and more often by themselves.

    ``least_share`` is of what stands between blanks.
    """
    tokens = F.filter(F.split("_t", r"\s+"), lambda x: x.rlike(r"\?\p{Ll}") & ~x.rlike(ADDRESS))
    asked = texts.filter(F.col("_t").rlike(r"\?\p{Ll}")).select(F.explode(tokens).alias("_x"))
    sides = F.concat(F.regexp_extract_all("_x", F.lit(r"(\p{L}+)\?+(?=\p{Ll})"), F.lit(1)), F.regexp_extract_all("_x", F.lit(r"\?+(\p{Ll}\p{L}*)"), F.lit(1)))
    asked = cut(asked.select(F.explode(sides).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("beside")))
    if asked.isEmpty():
        return frozenset()
    own = texts.select(F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"(?<![\p{L}?])\p{L}+(?![\p{L}?])"), F.lit(0))).alias("word"))
    # only words that are asked for are counted, so nothing else is shuffled
    counts = own.join(asked.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    least = (texts.agg(F.sum(F.size(F.split("_t", r"\s+")))).first()[0] or 0) * least_share
    usual = counts.join(asked, "word").filter((F.col("n") >= F.greatest(F.lit(3), F.col("beside"))) & (F.col("n") >= least))
    return frozenset(r["word"] for r in bounded_rows(usual.select("word"), 1_000_000, "words"))


_MODELS: dict[str, Plausibility] = {}


def _model(name: str, state: tuple) -> Plausibility:
    """The model of a name, built once in a worker."""
    if name not in _MODELS:
        if len(_MODELS) > 1:
            _MODELS.clear()
        _MODELS[name] = Plausibility(*state)
    return _MODELS[name]


def repair_documents(docs: DataFrame, model: Plausibility, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, text, restored, operations, garbled, lost): every document with its restored text.

    ``garbled``: some part was decoded with a wrong encoding, also if it can't be restored; ``lost``: characters
    were lost in it. Null and empty texts stay as they are and are not garbled; repeated rows stay; other columns
    aren't read. Python gets null in place of texts without any suspicious character.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.chars, model.pairs, model.total, model.known))
    name = uuid.uuid4().hex

    @F.pandas_udf("restored STRING, operations ARRAY<STRING>, lost BOOLEAN")
    def run(text: pd.Series) -> pd.DataFrame:
        m = _model(name, shared.value)
        rows = [(None, [], False) if t is None else repair(t, m) for t in text]
        return pd.DataFrame({"restored": [r[0] for r in rows], "operations": [r[1] for r in rows], "lost": [r[2] for r in rows]})

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    suspicious = F.col("text").rlike(r"[^\x00-\x7f]|&#?\w+;|\\u[0-9a-fA-F]{4}|%[0-9A-Fa-f]{2}%|=[0-9A-F]{2}=|\?[a-z]")
    rows = rows.withColumn("_r", run(F.when(suspicious, F.col("text"))))
    return rows.select(
        id_col,
        "text",
        F.coalesce("_r.restored", "text").alias("restored"),
        F.col("_r.operations").alias("operations"),
        ((F.size("_r.operations") > 0) | F.col("_r.lost")).alias("garbled"),
        F.col("_r.lost").alias("lost"),
    )
