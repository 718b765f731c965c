"""One form for text that looks the same.

Every code point and base-with-marks string of the corpus is counted. Relations between them (width, style and
presentation variants; split and whole letters; letters of different scripts that look alike) are joined by
union-find, so classes are transitive. The representative of a class in a script is its most frequent member
there. A multi-pattern automaton finds members that are not the usual ones, longest match first, and rewrites
them; the word and its neighbours tell in which script its letters should stand, and the automaton of that script
rewrites those of others.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

# Letters of Latin, Cyrillic, Greek, Armenian and Cherokee that look alike, one group a word.
ALIKE = (
    "aаα AАΑᎪ BВΒᏴ cсϲ CСϹᏟ dԁ DᎠ eе EЕΕᎬ FϜ gɡց GᏀ hһհ HНΗᎻ iіι IІΙ jјϳ JЈͿᎫ kкκ KКΚᏦ lӏ LԼᏞ MМΜᎷ nո NΝ oоοօ OОΟՕ pрρ PРΡᏢ qԛզ RᎡ sѕ "
    "SЅՏᏚ TТΤᎢ uυս UՍ vѵν VᏙ wԝ WԜᎳ xхχ XХΧ yуγ YУΥ ZΖᏃ"
).split()
# Arabic letters written in two ways, the Persian one first.
ARABIC = ("یي", "کك", "ہه")
PERSIAN = set("یکگچپژ")
# Code points without a width or with no ink that are no format characters.
BLANKS = "ᅟᅠㅤﾠ͏឴឵⠀"

JOINERS = "‌‍"
#: Strings that a presentation form can stand for: those of Latin, Armenian and lam-alef ligatures.
LIGATED = sorted({unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB18), *range(0xFEF5, 0xFEFD)) if unicodedata.category(chr(c)) != "Cn"})
MARKS = regex.compile(r"[\p{L}\p{N}]\p{M}+|[ｦ-ﾝ][ﾞﾟ]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
LETTER = {
    "Latin": regex.compile(r"\p{Latin}"),
    "Cyrillic": regex.compile(r"\p{Cyrillic}"),
    "Greek": regex.compile(r"\p{Greek}"),
    "Arabic": regex.compile(r"\p{Arabic}"),
    "Armenian": regex.compile(r"\p{Armenian}"),
    "Cherokee": regex.compile(r"\p{Cherokee}"),
}
CROSSING = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
#: Texts without anything unusual.
PLAIN = re.compile(r"[\n\x20-\x7e]*\Z")
TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter as far as it matters here; style variants belong to that of their plain form."""
    for name, p in LETTER.items():
        if p.match(ch):
            return name
    plain = unicodedata.normalize("NFKC", ch)[:1]
    return script(plain) if plain and plain != ch else ""


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (y := self.up.setdefault(root, root)) != root:
            root = y
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def _variant(ch: str) -> str | None:
    """The plain form of a width, style or presentation variant of letters or digits."""
    if unicodedata.category(ch)[0] not in "LN" or ch == "µ":
        return None
    parts = unicodedata.decomposition(ch)
    if not parts:
        return None
    if parts[0] == "<" and not parts.startswith(TAGS):
        return None
    plain = unicodedata.normalize("NFKC" if parts[0] == "<" else "NFC", ch)
    return plain if plain != ch and all(unicodedata.category(x)[0] in "LMN" for x in plain) else None


def build_classes(counts: dict[str, int]) -> Classes:
    """Classes of the counted strings and of what they are related to."""
    out = Classes()
    seen = set(counts)
    for s in list(seen):
        if len(s) == 1:
            plain = _variant(s)
            if plain:
                out.union(s, plain)
                seen.add(plain)
            whole = unicodedata.normalize("NFD", s)
            if len(whole) > 1 and whole != s:
                out.union(s, whole)  # also for letters that the composed form excludes
        else:
            for form in ("NFC", "NFKC"):
                whole = unicodedata.normalize(form, s)
                if whole != s:
                    out.union(s, whole)
                    seen.add(whole)
    for group in (*ALIKE, *ARABIC):
        for other in group[1:]:
            out.union(group[0], other)
    # letters with the same marks on letters that look alike
    marked: dict[tuple[str, str], str] = {}
    for s in sorted(seen):
        apart = unicodedata.normalize("NFD", s)
        if len(apart) > 1 and len(s) == 1 and apart[0] in out.up and script(apart[0]) in CROSSING:
            key = (out.find(apart[0]), apart[1:])
            out.union(marked.setdefault(key, s), s)
    return out


@lru_cache(maxsize=1 << 16)
def _wholes(marked: str) -> tuple[str, ...]:
    """Of a base with marks and of the base with the first of them, what has a whole form."""
    return tuple(s for s in {marked, marked[:2]} if len(unicodedata.normalize("NFKC", s)) == 1)


def count_forms(texts: DataFrame, col: str) -> DataFrame:
    """(form, n): how often each code point and each base with marks that has a whole form occurs.

    Of a base with more marks than a whole form has, what its first mark makes whole is counted, so there are no more forms
    than code points and decompositions, whatever the texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter()
            for t in b["_t"]:
                n.update(t)
                for s in LIGATED:
                    n[s] += t.count(s)
                if not t.isascii():
                    n.update(s for m in MARKS.findall(t) for s in _wholes(m))
            yield pd.DataFrame([(s, k) for s, k in n.items() if k], columns=["form", "n"])

    only = texts.select(F.col(col).alias("_t")).filter("_t is not null")
    return only.mapInPandas(run, "form STRING, n BIGINT").groupBy("form").agg(F.sum("n").alias("n"))


class Rewriter:
    """Rewrites text to representatives; built from the counts of a whole corpus."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.classes = build_classes(counts)
        members: dict[str, list[str]] = {}

        def often(s: str) -> int:
            """How often a form occurs; of an uncounted string, how often it can at most."""
            return counts[s] if s in counts else min(counts.get(c, 0) for c in s)

        for s in self.classes.up:
            members.setdefault(self.classes.find(s), []).append(s)
        self.best: dict[tuple[str, str], str] = {}  # (class, script) -> representative
        self.usual: dict[str, str] = {}  # form -> representative in its own script
        self.across: dict[str, dict[str, str]] = {}  # letter -> script -> representative
        for root, forms in members.items():
            by: dict[str, list[str]] = {}
            for s in forms:
                by.setdefault(script(s[0]), []).append(s)
            for name, own in by.items():
                # ties go to the composed, then the shorter form
                best = max(own, key=lambda s: (often(s), unicodedata.normalize("NFKC", s) == s, -len(s), s))
                self.best[root, name] = best
                for s in own:
                    self.usual[s] = best
            reach = {name: self.best[root, name] for name in by if name in CROSSING}
            if len(reach) > 1:
                for s in forms:
                    self.across[s] = reach
        for a, b in ((g[0], x) for g in ARABIC for x in g[1:]):  # both are usual, each in its languages
            for s in (a, b):
                self.usual.pop(s, None)
        for s in list(self.usual):
            if self.usual[s] == s:
                del self.usual[s]
        self.spaces = {s for s in counts if len(s) == 1 and s != " " and (unicodedata.category(s)[0] == "Z" or s in "\t\v\f\x1c\x1d\x1e\x1f\x85")}
        self.hidden = {s for s in counts if len(s) == 1 and (unicodedata.category(s) == "Cf" or s in BLANKS or "︀" <= s <= "️")}
        self.hidden -= {s for s in self.hidden if "؀" <= s <= "؅" or s in "۝"}
        self.automaton = ahocorasick.Automaton()
        for s in {*self.usual, *self.spaces, *self.hidden}:
            self.automaton.add_word(s, s)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.odd = set("".join(self.usual)) | self.spaces | self.hidden
        self.into = {}  # script -> automaton of the letters of others that have a fellow there
        for name in CROSSING:
            foreign = {s: reach[name] for s, reach in self.across.items() if name in reach and script(s[0]) != name}
            self.into[name] = ahocorasick.Automaton()
            for s, best in foreign.items():
                self.into[name].add_word(s, (len(s), best))
            if foreign:
                self.into[name].make_automaton()
        self.crossing = {s: script(s) for s in counts if len(s) == 1 and script(s) in CROSSING}
        self.persian = {g[1]: g[0] for g in ARABIC[:2]}

    def _joined(self, text: str, at: int) -> bool:
        """Whether the spelling of the script needs the joiner at ``at``."""
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if not before or not after:
            return False
        if unicodedata.combining(before) == 9 or unicodedata.combining(text[at - 2 : at - 1] or " ") == 9:
            return True  # after a virama
        return script(before) == "Arabic" == script(after) and bool(PERSIAN & set(text))

    def _plain(self, text: str) -> str:
        out, done = [], 0
        for end, s in self.automaton.iter_long(text):
            start = end - len(s) + 1
            if s in self.spaces:
                new = " "
            elif s in self.hidden:
                if s in JOINERS and self._joined(text, start) or s == "️" and start and unicodedata.category(text[start - 1]) == "So":
                    continue
                new = ""
            else:
                new = self.usual[s]
            out += (text[done:start], new)
            done = end + 1
        return "".join(out) + text[done:]

    def _stacked(self, text: str) -> str:
        """Marks in one order, and whole as far as there is a whole form, on letters with several of them."""
        out, done = [], 0
        for m in MARKS.finditer(text):
            if m.end() - m.start() > 2:
                new = unicodedata.normalize("NFC", m.group())
                out += (text[done : m.start()], self.usual.get(new, new))
                done = m.end()
        return "".join(out) + text[done:]

    def _across(self, word: str, name: str) -> str:
        """``word`` with the letters of other scripts replaced by their fellows in script ``name``."""
        out, done = [], 0
        for end, (size, best) in self.into[name].iter_long(word):
            out += (word[done : end - size + 1], best)
            done = end + 1
        return "".join(out) + word[done:]

    def _words(self, text: str) -> str:
        """Letters of another script replaced in the words they stand in."""
        words = [(m.start(), m.group()) for m in WORD.finditer(text)]
        sure: list[str] = []  # script that the word must have, "" where its letters don't tell
        lean: list[str] = []  # the same, or the script of most of its letters
        for _, w in words:
            own = {self.crossing[c] for c in w if c in self.crossing and c not in self.across}
            every = Counter(self.crossing[c] for c in w if c in self.crossing).most_common(2)
            sure.append(own.pop() if len(own) == 1 else "mixed" if own else "")
            most = every[0][0] if len(every) == 2 and every[0][1] > every[1][1] else ""
            lean.append(sure[-1] or most)
        out, done = [], 0
        for k, (at, w) in enumerate(words):
            kinds = Counter(self.crossing[c] for c in w if c in self.crossing)
            if not kinds:
                continue
            want = sure[k]
            if want == "mixed":
                want = kinds.most_common(1)[0][0]
            elif not want:
                near = self._near(lean, k)
                want = near if near and (near in kinds or len(kinds) == 1) else kinds.most_common(1)[0][0]
            # the script it should have, else the others of its letters, if all that are foreign then have a fellow there
            for script_ in dict.fromkeys((want, *kinds)):
                foreign = [c for c in w if self.crossing.get(c, script_) != script_]
                if not foreign:
                    break
                if all(script_ in self.across.get(c, ()) for c in foreign):
                    out += (text[done:at], self._across(w, script_))
                    done = at + len(w)
                    break
        return "".join(out) + text[done:]

    @staticmethod
    def _near(sure: list[str], k: int) -> str:
        """The script of the nearest words on both sides that have one, if it is the same."""
        sides = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(sure) and not sure[j]:
                j += step
            sides.append(sure[j] if 0 <= j < len(sure) else "")
        a, b = sides
        same = a if a == b or not b else b if not a else ""
        return same if same in CROSSING else ""

    def rewrite(self, text: str | None) -> str | None:
        if not text or PLAIN.match(text):
            return text
        seen = set()
        while hash(text) not in seen:  # what one step brings together may be odd again
            seen.add(hash(text))
            chars = set(text)
            if chars & self.odd:
                text = self._plain(text)
                chars = set(text)
            if len({self.crossing[c] for c in chars if c in self.crossing}) > 1:
                text = self._words(text)
            if not unicodedata.is_normalized("NFC", text):
                text = self._stacked(text)
        chars = set(text)
        if chars & PERSIAN and chars & set(self.persian) and sum(map(text.count, PERSIAN)) > 2 * sum(map(text.count, "يكةى")):
            for arabic, persian in self.persian.items():
                text = text.replace(arabic, persian)
        return text


def fit(texts: DataFrame, col: str = "text") -> Rewriter:
    """The rewriter of a corpus; its counts are at most one row for each code point and each composed letter."""
    return Rewriter({r["form"]: r["n"] for r in bounded_rows(count_forms(texts, col), 400_000, "forms")})


def class_table(rewriter: Rewriter) -> list[tuple]:
    """(class, script, form, n, representative) of every class with more than one counted form."""
    counts, rows = rewriter.counts, []
    for s in counts:
        if s in rewriter.classes.up:
            root = rewriter.classes.find(s)
            rows.append((root, script(s[0]), s, counts[s], rewriter.usual.get(s, s)))
    many = Counter(r[0] for r in rows)
    return sorted(r for r in rows if many[r[0]] > 1)


def normalize(df: DataFrame, rewriter: Rewriter, cols: Iterable[str] = ("text",), suffix: str = "_form") -> DataFrame:
    """``df`` with the consistent form of each text column in ``<column><suffix>``.

    Null stays null, empty stays empty; repeated rows stay; texts without any unusual character stay as they
    are. A column of an added name is replaced. Python gets null in place of plain ASCII texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(rewriter.counts)  # bounded by the assigned code points
    name = uuid.uuid4().hex

    @F.pandas_udf("string")
    def form(text: pd.Series) -> pd.Series:
        r = _restore(name, shared.value)
        return pd.Series([r.rewrite(t) for t in text], dtype=object)

    for c in cols:
        plain = F.col(c).isNull() | ~F.col(c).rlike(r"[^\x0a\x20-\x7e]")
        df = df.withColumn(c + suffix, F.coalesce(form(F.when(~plain, F.col(c))), F.col(c)))
    return df


_REWRITERS: dict[str, Rewriter] = {}


def _restore(name: str, counts: dict[str, int]) -> Rewriter:
    """The rewriter of a name, built once in a worker."""
    if name not in _REWRITERS:
        if len(_REWRITERS) > 3:
            _REWRITERS.clear()
        _REWRITERS[name] = Rewriter(counts)
    return _REWRITERS[name]


def evidence_values(page_text: DataFrame, queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(field, record_id, citation_index, text): every value that is to be compared; repeated rows stay."""

    def part(df: DataFrame, field: str, key: str, text: str, index=F.lit(0)) -> DataFrame:
        return df.select(F.lit(field).alias("field"), F.col(key).alias("record_id"), index.alias("citation_index"), F.col(text).alias("text"))

    cited = answers.select("query_id", F.explode("citations").alias("c"))
    cited = cited.select("query_id", F.col("c.citation_index").alias("citation_index"), F.col("c.excerpt").alias("excerpt"))
    return (
        part(page_text, "page_text.text", "page_id", "text")
        .unionByName(part(queries, "queries.query", "query_id", "query"))
        .unionByName(part(cited, "answers.citations.excerpt", "query_id", "excerpt", F.col("citation_index")))
        .filter("text is not null")
    )


def changed(values: DataFrame, rewriter: Rewriter) -> DataFrame:
    """(field, record_id, citation_index) of the values that aren't in the consistent form, each once."""
    form = normalize(values, rewriter)
    return form.filter("text_form <> text").select("field", "record_id", "citation_index").distinct()
