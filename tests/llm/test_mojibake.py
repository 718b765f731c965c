from collections import Counter

import pytest

from quirewright.llm import mojibake

CLEAN = [
    "Le réservoir était déjà près de l'élève: « où êtes-vous? » demanda-t-il à Noël. Le catalogue fut vérifié.",
    "Größe für das Öllager, „wurde geprüft“, fragte die Ärztin über Straßen. Das Gewölbe.",
    "¿Está el señor Núñez? ¡El cañón dañado es pequeño! Según la comisión, el almacén está aquí.",
    "Почему прежний механизм так и не был проверен? Объект номер пять стоит сто крон, а каталог дороже.",
    "由于资料不足，设备和机器都被核对过。大约一半的图纸在这里。",
    "なぜ倉庫の古い機械は届かなかったのか？札には「動かすな。」と書いてあり、新しい橋も同じだった。",
    "The clerk wrote “Do not move” – 20 °C, Łęgrzyn, Ðarvik and Ñandoro. Â, ¤, ß + Å: names.",
]


@pytest.fixture(scope="module")
def model():
    n = Counter()
    for t in CLEAN * 60:
        for run in mojibake._runs(t):
            n.update(zip(run, run[1:]))
    chars = Counter()
    for (_, b), k in n.items():
        chars[b] += k
    return mojibake.Plausibility(dict(chars) | {chr(c): 1 for c in range(128)}, {a + "\0" + b: k for (a, b), k in n.items()})


def bad(text, written, read, twice=False):
    out = text.encode(written).decode(read, "replace")
    return bad(out, "utf-8", "cp1252") if twice else out


@pytest.mark.parametrize(
    "k,written,read",
    [(0, "utf-8", "latin-1"), (1, "utf-8", "mac_roman"), (2, "utf-8", "cp437"), (3, "utf-8", "latin-1"), (3, "cp1251", "latin-1"), (3, "koi8-r", "cp1251"),
     (3, "utf-8", "cp1251"), (4, "gb18030", "latin-1"), (5, "utf-8", "latin-1"), (2, "latin-1", "cp1250"), (6, "utf-8", "latin-1"),
     (6, "cp1252", "latin-1")],
)
def test_round_trips(model, k, written, read):
    text = CLEAN[k].replace("„", '"').replace("“", '"').replace("–", "-") if written in ("latin-1",) else CLEAN[k]
    text = text if written == "utf-8" else text.encode(written, "ignore").decode(written)
    got, paths, _ = mojibake.repair(bad(text, written, read), model)
    assert got == text and paths


def test_twice_and_in_part(model):
    text = CLEAN[0]
    twice = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert mojibake.repair(twice, model)[0] == text
    mixed = CLEAN[3] + "\n" + bad(CLEAN[0], "utf-8", "latin-1") + "\n" + CLEAN[1]
    assert mojibake.repair(mixed, model)[0] == "\n".join((CLEAN[3], CLEAN[0], CLEAN[1]))


def test_clean_text_stays(model):
    for t in (*CLEAN, "", "plain ASCII? yes", "\n".join(CLEAN)):
        assert mojibake.repair(t, model) == (t, [], False)


def test_lost_characters(model):
    for t in ("pp. 1�15", "the town of ?ebrov is", "le lev� illisible"):
        assert mojibake.repair(t, model)[2]
    assert not mojibake.repair("What? yes. (Why?) ok", model)[2]


def test_a_frequent_sequence_is_still_seen(model):
    assert mojibake.repair("Temperatures of 20 Â°C were", model)[0] == "Temperatures of 20 °C were"


def test_escapes(model):
    assert mojibake.repair("d&eacute;j&agrave;", model)[0] == "déjà"


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN * 30)] + [(900, bad(CLEAN[0], "utf-8", "latin-1"), "x"), (901, None, "x"), (902, "", "x"), (900, bad(CLEAN[0], "utf-8", "latin-1"), "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, restored STRING")
    out = mojibake.repair_documents(df, mojibake.fit(df))
    assert out.count() == len(rows)
    got = out.filter("garbled").collect()
    assert [(r.doc_id, r.restored) for r in got] == [(900, CLEAN[0])] * 2
    assert {r.restored for r in out.filter("doc_id in (901, 902)").collect()} == {None, ""}
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert mojibake.repair_documents(empty, mojibake.fit(empty)).count() == 0


def test_question_marks_that_are_none(spark):
    words = "really no way the page is unknown but cost and item here naive"
    rows = [(i, t) for i, t in enumerate(CLEAN * 10 + [words] * 40 + ["see https://x.org/a?page=2 and www.y.org?item", "really?no way", "the cost ?unknown here"])]
    rows += [(1000, "G?nther asked"), (1001, "die T?r f?r uns"), (1002, "(?ber das"), (1003, "a \ufffd b")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    model = mojibake.fit(docs)
    got = {r.doc_id for r in mojibake.repair_documents(docs, model).filter("garbled").collect()}
    assert got == {1000, 1001, 1002, 1003}


def test_search_ends_by_cost_alone(model):
    text = CLEAN[0]
    for _ in range(4):
        text = text.encode("utf-8").decode("latin-1")
    assert mojibake.repair(text, model)[0] == CLEAN[0]
    odd = "".join(chr(0x80 + k * 37 % 2000) for k in range(3000))
    mojibake.repair(odd, model)


def test_what_is_kept_changes_a_cost(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN * 20)], "doc_id BIGINT, text STRING")
    model = mojibake.fit(docs)
    pruned = mojibake.Plausibility(model.chars, {k: n for k, n in model.pairs.items() if n > 5}, model.total, model.known)
    assert model.total == sum(model.pairs.values()) and pruned.total == model.total


def test_escaped_pairs_and_halves(model):
    pair, half = "ok \\ud83d\\ude00 end", "ok \\ud83d end"
    steps = dict(mojibake._unescape(pair))
    assert steps["backslash"] == "ok \U0001f600 end"
    for text in (pair, half):
        assert mojibake.repair(text, model)[0].encode()  # nothing that no encoding has
