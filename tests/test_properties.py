"""Invariants on generated inputs."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quirewright.functions.text import canonical_json, strict_json, tokenize
from quirewright.operators.answers import fill
from quirewright.operators.chunking import Packer
from quirewright.operators.evaluation import edits
from quirewright.operators.nested import Automaton, _parsed_deep, flatten

plain = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["pages", "page_number", "spans", "span_index", "tables", "cells", "rank", "hits", "retrieval", "citations", "artifact", "citation_index", "row_index", "column_index"]), x, max_size=5), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(plain)
def test_flattening_never_fails_and_links_to_what_it_gave(value):
    rows, rejects = flatten(json.dumps(value), Automaton())
    assert all(len(r) == 3 and r[0] for r in rejects)
    for (child, i1, i2, _, _, parent, p1, p2, variant), body in rows:
        assert child in ("page", "span", "table", "cell", "hit", "citation") and isinstance(body, dict) and variant
        if child in ("span", "table"):
            assert parent == "page" and p1 == i1
        if child == "cell":
            assert parent == "table" and (p1, p2) == (i1, i2)


@settings(max_examples=200, deadline=None)
@given(plain)
def test_canonical_json_is_stable(value):
    text = canonical_json(value)
    assert canonical_json(strict_json(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ocr_line", "embedded_word"]), st.text("ab é倉", min_size=1, max_size=9)), max_size=6), st.integers(1, 7), st.integers(1, 4))
def test_packing_keeps_every_character(spans, limit, fragments):
    items = [(str(i), s, t) for i, (s, t) in enumerate(spans)]
    back = {i: "" for i, _, _ in items}
    for text, marks in Packer(limit, fragments).pack(items):
        assert 0 < len(text) <= limit and len(marks) <= fragments
        for span, _, a, b, c, d in marks:
            assert len(back[span]) == a and b - a == d - c
            back[span] += text[c:d]
    assert back == {i: t for i, _, t in items}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits_is_a_metric(a, b, c):
    assert edits(a, b) == edits(b, a) and edits(a, a) == 0
    assert edits(a, c) <= edits(a, b) + edits(b, c) and abs(len(a) - len(b)) <= edits(a, b) <= max(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab .", min_size=1, max_size=12), max_size=6), st.integers(1, 3), st.integers(1, 20))
def test_evidence_fits(texts, items, characters):
    found = [{"sentence": t, "matched_terms": ["a"], "coverage": 0.5, "rank": 1, "chunk_id": "c", "start": 0} for t in texts if "a" in tokenize(t)]
    got = fill(found, ["a", "b"], items, characters, 0.25, "\n")
    assert len(got) <= items and len("\n".join(c["excerpt"] for c in got)) <= characters
    for c in got:
        assert c["excerpt"] and c["matched_terms"] and c["query_term_coverage"] >= 0.25


@settings(max_examples=300, deadline=None)
@given(plain | st.floats(allow_nan=False), st.sampled_from([None, 1]))
def test_the_parser_of_deep_texts_reads_what_the_other_does(value, indent):
    text = json.dumps(value, indent=indent)
    assert _parsed_deep(text) == json.loads(text)


@settings(max_examples=300, deadline=None)
@given(st.text("[]{}:,\"a1 ", max_size=12))
def test_both_parsers_refuse_the_same(text):
    try:
        want = json.loads(text)
    except ValueError:
        want = ValueError
    try:
        got = _parsed_deep(text)
    except ValueError:
        got = ValueError
    assert got == want
