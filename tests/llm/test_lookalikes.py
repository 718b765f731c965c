import unicodedata
from collections import Counter

import pytest

from quirewright.llm import lookalikes

CLEAN = (
    "The quick brown fox is fine at 12 of 30; Zebra Kilo Tango Item Before Every ",
    "Быстрая лиса и механизм крупный отчёт городской пока отдел Зорина резервуар ",
    "Größe für Übung, déjà près où été ñandú São ",
    "می‌شود گزارش قدیمی کتاب یک ",
    "مدير كبير في الجسر على ",
    "カタログとポンプですが、これはペンで、記録「ガ」 ",
    "नक्शा क्‍ष पुराना डॉ ",
)


def rewriter(*extra):
    n = Counter()
    for t in [*CLEAN] * 20 + list(extra):
        n.update(t)
        for s in lookalikes.LIGATED:
            n[s] += t.count(s)
        n.update(s for s in lookalikes.MARKS.findall(t) if len(unicodedata.normalize("NFKC", s)) < len(s))
    return lookalikes.Rewriter(+n)


@pytest.mark.parametrize(
    "odd,plain",
    [
        ("Ｔｈｅ 𝐪𝐮𝐢𝐜𝐤 𝖿𝗈𝗑", "The quick fox"),
        ("ﬁne １２", "fine 12"),
        ("Größe déjà", "Größe déjà"),
        ("Tае quісk", "Tae quick"),
        ("Βrοwn Κilο", "Brown Kilo"),
        ("мехaнизм кpупный", "механизм крупный"),
        ("NIКО", "NIKO"),
        ("a​b⁠c﻿d­e", "abcde"),
        ("a b c　d e", "a b c d e"),
        ("ｶﾀﾛｸﾞ", "カタログ"),
        ("が", "が"),
        ("اصﻻح کتاب", "اصلاح کتاب"),
        ("كبير‌في", "كبيرفي"),
        ("The о fox", "The o fox"),
        ("u​̈ber", "über"),
        ("a\fb\vc\x1dd", "a b c d"),
        ("quiсk fօх", "quick fox"),
        ("Ꮓebra Ꭲango", "Zebra Tango"),
    ],
)
def test_rewrites(odd, plain):
    r = rewriter(odd)
    assert r.rewrite(odd) == plain and r.rewrite(plain) == plain


@pytest.mark.parametrize(
    "text",
    ["می‌شود", "क्‍ष", "Ω = 7, λ and Δ", "“ok” – «ja», «№ 5» 你好，世界！", "Tekst: Быстрая лиса и отчёт. End", "m² 5 °C µm n° ª", "Łęgrzyn Þórdal Ångvalla", "a\nb", ""],
)
def test_leaves_alone(text):
    assert rewriter(text).rewrite(text) == text


def test_classes_are_transitive_and_follow_frequency():
    r = rewriter("ａ а α 𝐚")
    assert len({r.classes.find(c) for c in "aａаα𝐚"}) == 1
    often = lookalikes.Rewriter(Counter({"ड़": 3, "ड़": 90, "ड": 5}))
    assert often.rewrite("ड़") == "ड़"
    assert lookalikes.Rewriter(Counter({"ड़": 90, "ड़": 3})).rewrite("ड़") == "ड़"


def test_tables(spark):
    rows = [("a", "Ｔhe", 1), ("b", "The", 2), ("b", "The", 2), ("b", "The", 2), ("c", None, 3), ("d", "", 4), ("a", "Ｔhe", 1)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, text_form INT")
    out = lookalikes.normalize(df, lookalikes.fit(df))
    assert sorted((r.id, r.text_form or "-") for r in out.collect()) == [("a", "The"), ("a", "The"), ("b", "The"), ("b", "The"), ("b", "The"), ("c", "-"), ("d", "-")]
    empty = spark.createDataFrame([], "text STRING")
    assert lookalikes.normalize(empty, lookalikes.fit(empty)).count() == 0
    again = lookalikes.normalize(out.select("id", out.text_form.alias("text")), lookalikes.fit(df))
    assert again.filter("text <> text_form").count() == 0


def test_stacked_marks_are_bounded_and_read_alike(spark):
    marks = [chr(c) for c in range(0x300, 0x340)]
    texts = ["e" + "".join(marks[(k * j + j) % 64] for j in range(1, 12)) for k in range(500)] + ["ẹ́ e\u0301\u0323 e\u0323\u0301 é\u0323"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    counted = lookalikes.count_forms(df, "text").filter("length(form) > 1").count()
    assert counted < 64
    r = lookalikes.fit(df)
    assert len(set(r.rewrite(texts[-1]).split())) == 1


def test_long_chains_become_stable():
    odd = "u" + "\u200b\u200d" * 50 + "\u0308ber " + "Ｔ\u200bｈ\u200bｅ"
    assert rewriter(odd).rewrite(odd) == "über The"
