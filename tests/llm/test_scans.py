import pytest

from quirewright.llm import scans

DDL = "page_id STRING, page_number INT, text STRING, line_index STRING"


def page(doc, n, *lines):
    return (f"{doc}-page-{n:06d}", n, "\n".join(lines), "clash")


def body(n):
    """Lines of a common vocabulary, so that words are frequent."""
    return [
        f"The register was measured before {n} July 1980 and the second-hand machine was",
        "repaired although the weather remained unfavourable. The committee approved the",
        "permanent department because the earlier figures were incomplete near Maledaham.",
    ]


@pytest.fixture(scope="module")
def found(spark):
    rows = [page(f"d{k}", 1, *body(k % 28 + 1)) for k in range(60)]
    rows += [
        page("x", 1, "Report on the bridge", *body(3), "- 7 -"),
        page("x", 2, "Report on tbe bridge", "The permaneut register was repaired. The second-", "hand machine was mea-", "sured before 12 Ju1y", "57", "The committee approved it.", "- 8 -"),
        page("x", 3, "[9]", "Report on the bridge", "near Maledabam the weath-", "er was cost1y and unfavourab-", "- 9 -"),
        page("x", 4, "Report on the bridge · 10", "le for the machiue.", "- 10 -"),
    ]
    rows += [rows[-1], (None, 1, "a", "c"), ("y-page-000001", 1, None, "c"), ("y-page-000002", 2, "", "c"), ("z-page-000001", None, "xx\n\n" + "word " * 30_000, "c")]
    df = spark.createDataFrame(rows, DDL)
    s = scans.Scans(df)
    return s, {(r.page_id[0] + r.page_id[-1], r.line_index, r.noise) for r in s.noise().collect() if r.page_id[0] == "x"}


def test_edges(found):
    got = {x for x in found[1] if x[2] in ("header", "page_number")}
    assert got == {
        ("x1", 5, "page_number"), ("x2", 1, "header"), ("x2", 7, "page_number"), ("x3", 1, "page_number"), ("x3", 2, "header"), ("x3", 5, "page_number"),
        ("x4", 1, "header"), ("x4", 3, "page_number"),
    }


def test_divided_words(found):
    assert {x for x in found[1] if x[2] == "hyphenation"} == {("x2", 3, "hyphenation"), ("x3", 3, "hyphenation"), ("x3", 4, "hyphenation")}


def test_misread_words(found):
    assert {x for x in found[1] if x[2] == "misread"} == {("x2", 2, "misread"), ("x2", 4, "misread"), ("x3", 3, "misread"), ("x3", 4, "misread"), ("x4", 2, "misread")}


def test_paragraphs(found):
    rows = [r for r in found[0].paragraphs().collect() if r.document_id == "x"]
    text = " ".join(r.text for r in sorted(rows, key=lambda r: (r.page_id, r.paragraph_index)))
    for part in ("second-hand machine was measured before 12", "the weather was", "unfavourable for the machine.", "The permanent register"):
        assert part in text
    assert "- 8 -" not in text and text.count("Report on the bridge") == 1


def test_paragraphs_go_on_over_pages(spark):
    full = "The register was measured before the machine was repaired by the clerk of the"
    rows = [
        page("a", 1, "A short title", full, full, "town, asked Mr."),
        page("a", 2, "Smith before it closed in", full + " end.", "So it ended."),
        page("a", 3, "A new one begins here and is", "quite short."),
        page("a", 5, "after a gap this begins.", "x"),
        page("b", 255, "one " + full, "two " * 15, "red " * 15 + "and"),
        page("b", 256, "blue " * 14 + "or", "green " * 11, "and here it ends."),
    ]
    got = {(r.page_id, r.paragraph_index): r.text for r in scans.Scans(spark.createDataFrame(rows, DDL)).paragraphs().collect()}
    assert got["a-page-000001", 1] == "A short title" and got["a-page-000001", 2].endswith("asked Mr. Smith before it closed in " + full + " end. So it ended.")
    assert got["a-page-000003", 1].startswith("A new one") and ("a-page-000002", 1) not in got and ("a-page-000005", 1) in got
    assert got["b-page-000255", 1].startswith("one The") and got["b-page-000255", 1].endswith("green and here it ends.") and ("b-page-000256", 1) not in got


WHOLE = "The register was measured before the machine was repaired by the clerk."


def headers(spark, rows):
    kinds = scans.edge_kinds(scans.documents_pages(spark.createDataFrame(rows, DDL)))
    return {(int(r.page_id[-6:]), r.line_index) for r in kinds.filter("kind = 'header'").collect()}


def test_copies_of_a_page_count_once(spark):
    rows = [page("f", n, *[WHOLE] * 3, "Printed for the county archive") for n in range(1, 31)]
    assert headers(spark, rows + rows[4:5] * 299) == {(n, 4) for n in range(1, 31)}


@pytest.mark.parametrize("of", [100, 305])
def test_titles_of_chapters(spark, of):
    heads = {n: ["Remarks upon the several harbours"] for n in range(3, of, 50)} | {n: ["The drainage of the marshes"] for n in range(41, 61)}
    rows = [page("g", n, *heads.get(n, []), *[WHOLE] * 3) for n in range(1, of + 1)]
    assert headers(spark, rows) == {(n, 1) for n in range(41, 61)}


def kinds(spark, rows):
    found = scans.edge_kinds(scans.documents_pages(spark.createDataFrame(rows, DDL)))
    return {(int(r.page_id[-6:]), r.line_index, r.kind) for r in found.collect()}


def test_words_like_numbers_and_long_numbers_need_a_sequence(spark):
    rows = [page("r", n, *[WHOLE] * 3, x) for n, x in ((1, "mix"), (2, "i"), (3, "ii"), (4, "iii"), (5, "civil"), (6, "20150312"), (7, "vii"))]
    assert kinds(spark, rows) == {(2, 4, "page_number"), (3, 4, "page_number"), (4, 4, "page_number"), (7, 4, "page_number")}
    long = [page("s", n, *[WHOLE] * 3, str(7_000_000 + n)) for n in range(1, 5)]
    assert len(kinds(spark, long)) == 4


def test_long_titles_and_number_lines(spark):
    title = "Proceedings of the commission appointed to inquire into the drainage of the marshes and the several harbours of the county"
    rows = [page("t", n, *([title] if n > 1 else [title, WHOLE]), *[WHOLE] * 3, "-" * 40 + f" Page {n} of 7 " + "-" * 40) for n in range(1, 8)]
    got = kinds(spark, rows)
    assert {(n, 1, "header") for n in range(2, 8)} <= got and {n for n, _, k in got if k == "page_number"} == set(range(1, 8))


def test_hot_documents_are_joined_apart(spark, monkeypatch):
    rows = [page("f", n, "Printed for the county archive", *[WHOLE] * 3, str(n)) for n in range(1, 31)] + [page("g", 1, WHOLE, WHOLE, "5")]
    want = kinds(spark, rows)
    monkeypatch.setattr(scans, "HOT", 20)
    assert kinds(spark, rows) == want and len(want) > 50


@pytest.mark.parametrize("words", [("東京大阪", "の"), ("ကျောင်း", "သား"), ("안녕", "하세요"), ("прави", "тельство"), ("😀😀", "wort")])
def test_divided_words_of_any_script(spark, words):
    rows = [page("c", 1, WHOLE, words[0] + "-", words[1] + " " + WHOLE)] + [page(f"d{k}", 1, words[0] + words[1]) for k in range(4)]
    s = scans.Scans(spark.createDataFrame(rows, DDL))
    got = {(r.line_index, r.noise) for r in s.noise().collect() if r.page_id.startswith("c")}
    assert got == ({(2, "hyphenation")} if words[0] != "😀😀" else set())
    assert s.paragraphs().count() == 5


def test_other_scripts_and_long_words_are_read(spark):
    long = "Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetzes"
    rows = [page(f"d{k}", 1, f"{long} правительство сообщило about the machine") for k in range(30)]
    rows += [page("w", 1, long.replace("wachung", "wacbung"), "правительст8о", "правитепьство", "пра8ительство", "правительств0 сообщило")]
    got = {r.line_index for r in scans.Scans(spark.createDataFrame(rows, DDL)).noise().collect() if r.page_id.startswith("w")}
    assert {1, 5} <= got


def test_paragraphs_of_any_length(spark):
    full = "the register was measured before the machine was repaired by the clerk of the"
    own = lambda n, k: "".join("dgjkpqrwxz"[int(c)] for c in f"{n * 7919 % 1000:03d}{k}{n:03d}") * 3 + " " + full
    rows = [page("p", n, *[own(n, k) for k in range(3)]) for n in range(5, 300)] + [page("p", 300, own(300, 1), "end."), page("q", 1, full)]
    for block in (16, 4096):
        old, scans.PAGES_PER_BLOCK = scans.PAGES_PER_BLOCK, block
        out = [r for r in scans.Scans(spark.createDataFrame(rows, DDL)).paragraphs().collect() if r.document_id == "p"]
        scans.PAGES_PER_BLOCK = old
        assert [(r.page_id[-3:], r.paragraph_index) for r in out] == [("005", 1)] and out[0].text.count("register") == 295 * 3 + 1


def test_nothing(spark):
    s = scans.Scans(spark.createDataFrame([], DDL))
    assert s.noise().count() == 0 and s.paragraphs().count() == 0


@pytest.mark.parametrize("line,n", [("Page 63 of 64", 63), ("- 357 -", 357), ("[273]", 273), ("S. 2", 2), ("· 24 ·", 24), ("xiv", 14), ("2/4", 2), ("Seite 1 von 5", 1), ("5 2", 52), ("- l2 -", 12), ("第12页", 12), ("Página 4 de 7", 4)])
def test_page_numbers(line, n):
    assert scans.page_number_line(line) == n


@pytest.mark.parametrize("line", ["5,886", "p.m.", "1937.", "The end", "12 crowns were", "", "4 July"])
def test_no_page_numbers(line):
    assert scans.page_number_line(line) is None


def test_impossible_characters():
    for line in ("dama9ed", "the rechtzei+ig", "6S.12 m", "in l924", "8.l8 regelt", "I+em No"):
        assert scans._suspects(line)
    for line in ("97.73kg", "the 2nd of May", "c.-à-d. l'eau", "SPQC2XAP49LNG7C", "Il a dit: A 5", "7 a.m."):
        assert not scans._suspects(line)


def test_corrections_by_hash(spark):
    lexicon = [("damaged", 100), ("darnaged", 1), ("granary", 50), ("gronory", 1), ("la", 500), ("lo", 90), ("specimen", 40), ("spccimen", 2), ("weil", 30), ("vveil", 1)]
    df = spark.createDataFrame(lexicon, "word STRING, n BIGINT")
    got = {r.word: r.right for r in scans.corrections(df, df).collect()}
    assert got == {"darnaged": "damaged", "gronory": "granary", "spccimen": "specimen", "vveil": "weil"}
    one = spark.createDataFrame([("tie", 1)], "word STRING, n BIGINT")
    assert scans.corrections(one.limit(0), df).count() == 0
