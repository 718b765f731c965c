import pytest

from quirewright.llm import sentences


def units(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    "expected",
    [
        ["Mr. Smith met Dr. Jones at 5 p.m.", "They paid 3.50 crowns, i.e. too much.", "See Fig. 3 and pp. 4–5."],
        ["The meeting began at 6 a.m. in town.", "Item No. 4 lists J. K. Rowan & Co. as sellers."],
        ["“Has it been moved?” asked Mr. Hill while waiting.", "Nobody knew!", "It weighed 5 kg.", "The end"],
        ["Am 5. Dezember kam z. B. Herr Dr. Weber.", "Etwa 3 Prozent, d. h. 14.500 Stück, fehlen.", "Der Vermerk lautet: „Das Haus bleibt.“", "Abschnitt 3 gilt."],
        ["„Wurde das Tor geprüft?“, fragte Frau Klein.", "Das Fass (vgl. Abb. 2, S. 5) bleibt."],
        ["« Le four est-il livré? » demanda Mme Noël.", "La note dit: « Ne bougez pas. »", "Le prix reste fixe, c.-à-d. bas."],
        ["Según el Sr. Ruiz, todo va bien.", "¿Por qué?", "¡Nadie lo sabe!", "Véase la pág. 2, núm. 27."],
        ["Около 5 шт., т. е. мало, пришло в 1950 г. в город.", "«Где мост?» — спросил он.", "Никто не знал."],
        ["由于资料不足，重量是5.6公斤。", "“合同在哪里？”职员问。", "为什么？", "没有人知道！"],
        ["札には「動かすな。」と書いてあり、同じだった。", "なぜ？", "重さは5.1kgだ。"],
        ["डॉ. वरेल ने कहा।", "“सूची कहाँ है?” लिपिक ने पूछा।", "क्यों नहीं?"],
        ["قال د. فاريل إن الجسر جاهز.", "لماذا؟", "نحو 4.8 في المئة."],
        ["ውል ተላከ።", "ፋብሪካ ለምን አልደረሰም?", "በ2 ቀን ተለካ።"],
    ],
)
def test_languages(expected):
    for gap in (" ", "\n", "  \n") if ord(expected[0][0]) < 0x3000 else ("\n", ""):
        assert units(gap.join(expected)) == expected


def test_beginnings_inside_sentences():
    assert units("art. 26 applies. It is new.") == ["art. 26 applies.", "It is new."]
    assert units(". 26, sobre el horno.") == [". 26, sobre el horno."]
    assert units("!\nEtwa so.") == ["!", "Etwa so."]
    assert units("第7.1\n9节说明。") == ["第7.1\n9节说明。"]


def test_odd_characters_keep_their_offsets():
    text = "u.　a. in ​Town ok. Next ｏne."
    spans = sentences.sentence_spans(text)
    assert [text[a:b] for a, b in spans] == [text[: text.index("Next") - 1], text[text.index("Next") :]]


def test_nothing():
    assert sentences.sentence_spans(None) == sentences.sentence_spans("") == sentences.sentence_spans(" \n　") == []


def test_very_long_text_and_spans():
    text = "This is one sentence. " * 20_000
    spans = sentences.sentence_spans(text)
    assert len(spans) == 20_000 and all(text[a:b] == "This is one sentence." for a, b in spans)


def test_table(spark):
    rows = [("a", "One. Two.", 5), ("b", None, 6), ("c", "", 7), ("a", "One. Two.", 5)]
    out = sentences.split_sentences(spark.createDataFrame(rows, "id STRING, text STRING, sentence_index INT"))
    got = sorted((r.id, r.sentence_index, r.sentence_start, r.sentence_end, r.sentence) for r in out.collect())
    assert got == sorted([("a", 1, 0, 4, "One."), ("a", 2, 5, 9, "Two.")] * 2)
    assert sentences.split_sentences(spark.createDataFrame([], "text STRING")).count() == 0


@pytest.mark.parametrize(
    "expected",
    [
        ["Ինչո՞ւ եկար։", "Նա չգիտի։"],
        ["Πού είναι η γέφυρα;", "Ο δρ. Παππάς δεν ξέρει.", "Είναι 5 μ. περίπου."],
        ["ကျွန်တော် သွားမယ်။", "သူ မသွားဘူး။"],
        ["ខ្ញុំទៅផ្សារ។", "គាត់មិនទៅទេ។"],
        ["བཀྲ་ཤིས།", "བདེ་ལེགས།"],
        ["ฉันไปตลาด", "เขาไม่ไป"],
        ["ຂ້ອຍໄປຕະຫຼາດ", "ລາວບໍ່ໄປ"],
        ["یہ کتاب ہے۔", "وہ نہیں آیا۔"],
    ],
)
def test_other_scripts(expected):
    assert units(" ".join(expected)) == expected


def test_thai_blanks_inside_sentences():
    assert units("เขาวิ่งเร็ว ๆ ทุกวัน") == ["เขาวิ่งเร็ว ๆ ทุกวัน"] and units("มา 3 คน และ กลับ") == ["มา 3 คน และ กลับ"]


def test_rules_see_the_whole_text():
    filler = "»" * 60
    assert units(f"Nobody came.{filler} Next one.") == [f"Nobody came.{filler}", "Next one."]
    assert units("of. Next we go.") == ["of.", "Next we go."]


def test_languages_change_inside_a_text():
    german, english = "Der Bau kam am 5. Dezember und das ist nicht der 12. Oktober für die Stadt. ", "It was in the year of the 15. The house is by the river and that was it. "
    got = units(german * 12 + english * 12)
    assert got.count(german.strip()) == 12 and got.count("It was in the year of the 15.") >= 11
