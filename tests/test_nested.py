import json

import pytest

from quirewright.operators import nested

DDL = "record_id BIGINT, payload STRING, child STRING"


def rows(spark, *payloads):
    data = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, p in enumerate(payloads)]
    out = nested.children(spark.createDataFrame(data, DDL))
    return out, {(r.record_id, r.child, r.idx1, r.idx2, r.idx3, r.idx4) for r in out.collect()}


PAGE = {
    "page_number": 2,
    "page_id": "p2",
    "spans": [{"span_index": 1, "text": "a", "bounding_box": [1, 2, 3, 4]}, {"span_index": 2, "text": None}],
    "tables": [{"table_id": "t", "cells": {"row_index": 1, "column_index": 2}}, {"table_index": 7, "cells": None}, {"cells": []}],
}


def test_children_of_every_shape(spark):
    doc = {"pages": [PAGE, None, {"page_number": 3}]}
    _, got = rows(spark, doc, {"artifact": {"pages": PAGE}, "delivery": {"tags": []}})
    page = {("page", 2, 0, 0, 0), ("span", 2, 1, 0, 0), ("span", 2, 2, 0, 0), ("table", 2, 1, 0, 0), ("table", 2, 7, 0, 0), ("table", 2, 3, 0, 0), ("cell", 2, 1, 1, 2)}
    assert got == {(0, *x) for x in page | {("page", 3, 0, 0, 0)}} | {(1, *x) for x in page}


def test_qa_results_and_links(spark):
    qa = {"query_id": "q", "answer_id": "a", "retrieval": {"hits": {"rank": 1, "page_number": 9, "chunk_id": "c"}}, "citations": [{"citation_index": 1, "retrieval_rank": 4}]}
    out, got = rows(spark, qa)
    assert got == {(0, "hit", 1, 0, 0, 0), (0, "citation", 1, 4, 0, 0)}
    assert {r.parent for r in out.collect()} == {"retrieval", "qa_result"} or {r.parent for r in out.collect()} == {"qa_result"}


def test_unreadable_missing_and_empty(spark):
    _, got = rows(spark, None, "", "{", "[]", "3", {}, {"pages": None}, {"pages": []}, "NaN")
    assert got == set()
    assert nested.children(spark.createDataFrame([], DDL)).count() == 0


def test_null_id_and_repeats(spark):
    data = [(None, json.dumps({"pages": {"page_number": 1}}), "x")] * 2
    out = nested.children(spark.createDataFrame(data, DDL))
    assert out.count() == 2 and out.filter("record_id is null").count() == 2


def test_subtypes_and_variants(spark):
    out, _ = rows(spark, {"pages": [PAGE]})
    records = spark.createDataFrame([(0, json.dumps({"pages": [PAGE]}), "x")], DDL)
    spans = {r.idx2: r for r in nested.subtype_table(records, "span").collect()}
    assert spans[1].bounding_box.x1 == 3.0 and spans[1].parent == "page" and spans[1].parent_idx1 == 2 and spans[2].text is None
    cell = nested.subtype_table(records, "cell").first()
    assert (cell.parent, cell.parent_idx1, cell.parent_idx2) == ("table", 2, 1)
    kinds = {r.variant for r in nested.variants(out).collect()}
    assert any(v.startswith("span{bounding_box:[number]") for v in kinds)


def test_automaton_tells_shapes_apart():
    a = nested.Automaton()

    def shape(value):
        state, possible, variant, _ = a.read(value)[id(value)]
        return a.names[state], possible, variant

    assert shape({"rank": 1, "page_number": 2, "page_id": "x"})[:2] == ("hit", {"hit", "page"})
    assert shape({"page_number": 2})[0] == "page"
    assert shape({"row_index": 1, "column_index": 1, "text": "x"})[2] != shape({"row_index": 1, "column_index": 1})[2]
    assert shape({"a": {"b": [{"rank": 1}]}})[0] == "wrapper" and shape({"a": {"b": [1]}})[0] == "object"


def test_children_at_unknown_keys_go_where_their_shape_says(spark):
    page = {"page_number": 2, "layout": {"lines": [{"span_index": 1, "note": {"page_number": 9}}]}, "grids": [[{"table_index": 3, "content": [{"row_index": 1, "column_index": 1}]}]]}
    _, got = rows(spark, {"artifact": {"content": {"pages": [page]}}}, {"answer_id": "a", "found": {"list": [{"rank": 4, "page_number": 1}]}, "retrieval": {"results": [{"rank": 5}]}})
    assert got == {(0, "page", 2, 0, 0, 0), (0, "span", 2, 1, 0, 0), (0, "table", 2, 3, 0, 0), (0, "cell", 2, 3, 1, 1), (1, "hit", 5, 0, 0, 0)}


def test_rejects(spark):
    far = {"pages": [{"page_number": 3_000_000_000, "spans": [{"span_index": 1}]}]}
    payloads = [None, "", "{", "[]", {"a": 1}, far, {"pages": []}, "[" * 100_000 + "]" * 100_000, "[" * 100_000]
    data = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads)]
    records = spark.createDataFrame(data, DDL)
    got = {(r.record_id, r.reason, r.child) for r in nested.rejects(records).collect()}
    none = {(i, "no known type", None) for i in (3, 4, 7)}
    assert got == {(0, "missing", None), (1, "missing", None), (2, "unreadable", None), (5, "index out of range", "page"), (8, "unreadable", None)} | none
    assert {(r.child, r.idx1, r.idx2) for r in nested.children(records).collect()} == {("page", None, 0), ("span", None, 1)}


def test_deep_texts_read_like_flat_ones():
    for text in ('{"a": [1, "x\\u00e9", null, {"b": {}}], "c": []}', "[]", "3", '"s"', "[1,2.5e3,true,-1]", "NaN"):
        assert str(nested._parsed_deep(text)) == str(json.loads(text))
    for text in ("", "[", "[1,]", '{"a"}', '{"a":}', "[1 2]", "{]", "1 2", '{"a":1,}', "nul"):
        with pytest.raises(ValueError):
            nested._parsed_deep(text)
    inner = '{"pages": [{"page_number": 7}], "x": ' + '{"n": [' * 50_000 + "]}" * 50_000 + "}"
    found, rejected = nested.flatten(inner, nested.Automaton())
    assert [k[:2] for k, _ in found] == [("page", 7)] and rejected == []


def test_tables_written_in_one_pass(spark, tmp_path):
    records = spark.createDataFrame([(0, json.dumps({"pages": [PAGE]}), "x"), (1, None, "x")], DDL)
    nested.write_tables(records, str(tmp_path / "out"))
    for child in ("page", "span", "table", "cell"):
        mine = nested.subtype_table(records, child).drop("child")
        stored = nested.read_table(spark, str(tmp_path / "out"), child).drop("child").select(*mine.columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, mine.collect()))


def test_long_and_deep(spark):
    deep = "[" * 5000 + "]" * 5000
    nested_note = {}
    for _ in range(700):
        nested_note = {"note": nested_note}
    inside = {"pages": {"page_number": 1, "note": nested_note, "spans": {"span_index": 2, "text": "x"}}}
    assert len(rows(spark, inside)[1]) == 2
    many = {"pages": [{"page_number": i, "spans": [{"span_index": 1, "text": "x" * 100_000}]} for i in range(30)]}
    _, got = rows(spark, deep, many)
    assert len(got) == 60


def test_children_in_strings(spark):
    qa = {"answer_id": "a", "retrieval": json.dumps({"query_tokens": ["ü"], "hits": [{"rank": 1}, {"rank": 2}]}), "citations": "not {json"}
    page = PAGE | {"spans": json.dumps(PAGE["spans"]), "tables": [json.dumps(t) for t in PAGE["tables"]]}
    twice = {"artifact": json.dumps(json.dumps({"pages": page}))}
    out, got = rows(spark, qa, twice, json.dumps(json.dumps({"pages": [PAGE]})), {"answer_id": "b", "retrieval": "[" * 5000}, {"pages": ["3", '"x"', "null"]})
    _, plain = rows(spark, {"pages": PAGE})
    assert got == {(0, "hit", 1, 0, 0, 0), (0, "hit", 2, 0, 0, 0)} | {(k, *x[1:]) for k in (1, 2) for x in plain}
    found = {(r.record_id, r.child, r.idx4 or r.idx2): (r.variant, r.parent) for r in out.collect()}
    assert found[0, "hit", 0] == ("text:hit{rank:number}", "qa_result")
    assert all(found[k, "page", 0][0].startswith("text:page{") for k in (1, 2))
    assert found[1, "span", 1][0].startswith("text:span{") and found[2, "span", 1][0].startswith("span{") and found[1, "cell", 2][0].startswith("cell{")
    boxed = json.dumps({"pages": PAGE | {"spans": {"span_index": 1, "bounding_box": "[1, 2, 3, 4]"}}})
    assert nested.subtype_table(spark.createDataFrame([(0, boxed, "x")], DDL), "span").first().bounding_box.x1 == 3.0


def test_halves_of_pairs_and_odd_numbers(spark):
    text = '{"pages": [{"page_number": 1, "k\\ud800": 1, "page_id": "a\\ud800b", "width": 1e999, "height": ' + "9" * 400 + ', "spans": [{"span_index": 1.5, "confidence": NaN, "text": {"t": "\\udfff"}}]}]}'
    records = spark.createDataFrame([(1, text, "x")], DDL)
    page = nested.subtype_table(records, "page").first()
    assert page.page_id == "a?b" and "k?" in page.variant and page.width == float("inf") and page.height is None
    assert nested.subtype_table(records, "span").first().idx2 == 1 and nested.children(records).count() == 2
