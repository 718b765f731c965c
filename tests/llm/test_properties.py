"""Invariants on generated texts."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quirewright.llm import lookalikes, packing, scans, sentences, splitting

parts = st.sampled_from([*"ab .!?\n\r,é倉。「」निТ-1", "\u0301", "\u200b", "Dr. ", "p. ", "x" * 9])
texts = st.lists(parts, max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 14))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = splitting.cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, e), (s, e2) in zip(pieces, pieces[1:]):
        assert s == max(0, e - min(overlap, limit - 1)) and e2 > e
    assert all(e - s <= limit for s, e in pieces)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_sentences_hold_every_visible_character(text):
    spans = sentences.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(b <= a for (_, b), (a, _) in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).split() == text.split() or "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=4))
def test_forms_are_stable(values):
    n = Counter()
    for t in values:
        n.update(t)
    r = lookalikes.Rewriter(n)
    for t in values:
        once = r.rewrite(t)
        assert r.rewrite(once) == once and not set(once or "") & {"\u200b"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 4)), max_size=30), st.integers(1, 12))
def test_bins_hold_what_fits(items, capacity):
    sizes = {c: s for s, c in items}
    items = [(sizes[c], c) for _, c in items]
    placed = packing.best_fit([s for s, _ in items], [-1] * len(items), [c for _, c in items], capacity)
    fill, whole = Counter(), Counter()
    for i, _, _, tokens, b in placed:
        fill[b] += tokens
        whole[i] += tokens
    assert all(v <= capacity for v in fill.values()) and all(whole[i] == s for i, (s, _) in enumerate(items))


@settings(max_examples=200, deadline=None)
@given(texts, st.lists(st.integers(1, 6), max_size=3, unique=True))
def test_paragraphs_keep_the_lines(text, edges):
    kinds = [{"line_index": i, "kind": "header"} for i in edges]
    text = text.replace("1", "")  # letters beside digits are read as digits
    parts = scans.page_parts(text, [], kinds, [])
    lines = [x for i, x in enumerate(text.split("\n"), 1) if i not in edges]
    want = Counter(c for x in lines for c in x if c.isalpha())
    assert Counter(c for p in parts for c in p["text"] if c.isalpha()) == want
