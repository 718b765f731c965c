import random

import pytest

from quirewright.llm import splitting

BOX = "STRUCT<x0: DOUBLE, top: DOUBLE, x1: DOUBLE, bottom: DOUBLE>"
FRAGMENT = f"STRUCT<fragment_index: INT, span_id: STRING, span_index: INT, source: STRING, source_start: INT, source_end: INT, chunk_start: INT, chunk_end: INT, bounding_box: {BOX}>"
CHUNKS = f"chunk_id STRING, corpus_id STRING, config_id INT, page_id STRING, page_number INT, text STRING, fragments ARRAY<{FRAGMENT}>, piece_index STRING"
CONFIGS = "config_id INT, max_characters_per_chunk INT, overlap_characters INT"


def sample(n, seed):
    r = random.Random(seed)
    parts = ["the quick. ", "été, là ", "倉庫を動かす。", "\n\n", "line\n", "x" * 37, "á" * 9, "नक्शा "]
    return "".join(r.choice(parts) for _ in range(n))


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s2 == max(0, e - min(overlap, limit - 1)) and e2 > e
    assert all(0 < e - s <= limit for s, e in pieces) or not text


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 9), (50, 7), (300, 50), (7, 100), (1, 0)])
def test_pieces_cover_the_text(limit, overlap):
    for seed in range(20):
        text = sample(60, seed)
        check(text, splitting.cuts(text, limit, overlap), limit, overlap)


def ranged(text, limit, overlap, size):
    """The pieces as ranges of ``size`` characters give them, each with no more than its halo."""
    overlap = max(0, min(overlap, limit - 1))
    before, after = splitting.halo(limit, overlap)
    entry, out = 0, []
    for at in range(0, len(text), size):
        low, end = max(0, at - before), min(len(text), at + size)
        window = text[low : end + after]
        starts = splitting.entries(window, at - low, limit, overlap) if at else [0]
        table = splitting.crossings(starts, splitting.chains(window, at - low, end - low, starts, limit, overlap), at - low, end - low)
        out += [(s + low, e + low) for s, e in splitting._pieces(window, at - low + entry, end - low, limit, overlap)]
        entry, pieces = splitting.crossed(table, entry)
        assert pieces <= len(out)
    assert entry == 0
    return out


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 9), (50, 7), (300, 50), (1, 0), (40, 39)])
def test_ranges_of_any_size_give_the_same_pieces(limit, overlap):
    r = random.Random(limit)
    for seed in range(12):
        text = sample(120, seed) + " " * r.randint(0, 90) + sample(30, seed) + "x" * r.randint(0, 400) + "\n" * 9 + sample(5, seed)
        want = splitting.cuts(text, limit, overlap)
        for size in (1, 7, limit, 3 * limit + 1, 500):
            assert ranged(text, limit, overlap, size) == want


def test_natural_boundaries():
    text = "One sentence here. Another, longer sentence follows it now. End"
    assert splitting.cuts(text, 60, 0)[0] == (0, len("One sentence here. Another, longer sentence follows it now. "))
    text = "para one is here\n\npara two. It goes on and on"
    assert text[: splitting.cuts(text, 30, 0)[0][1]] == "para one is here\n\n"
    assert splitting.cuts("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]
    assert splitting.cuts("ab" + "é" * 4, 5, 0)[0] == (0, 4)


def chunks(spark, *rows):
    return spark.createDataFrame([(i, "c", c, "p", 1, t, f, "clash") for i, c, t, f in rows], CHUNKS)


def test_chunks(spark):
    configs = spark.createDataFrame([(1, 10, 2), (2, None, None), (1, 10, 2), (None, 5, 0)], CONFIGS)
    box = (0.0, 0.0, 1.0, 1.0)
    marks = [(1, "s1", 1, "ocr_line", 5, 12, 0, 7, box), (2, "s2", 2, "ocr_line", 0, 8, 8, 16, box)]
    rows = [("a", 1, "abcdefg\nhijklmno", marks), ("b", 1, "short", None), ("c", None, "y" * 4001, None), ("d", 2, "y" * 4001, []), ("e", 1, None, None), ("f", 1, "", None), ("a", 1, "abcdefg\nhijklmno", marks), ("g", 99, "z" * 11, None)]
    out = splitting.split_chunks(chunks(spark, *rows), configs)
    got = out.collect()
    assert {r.chunk_id for r in splitting.oversized(out).collect()} == {"a", "c", "d"}
    a = sorted({(r.piece_index, r.piece_start, r.piece_end, r.text) for r in got if r.chunk_id == "a"})
    assert [x[3] for x in a] == ["abcdefg\n", "g\nhijklmno"] and sum(r.chunk_id == "a" for r in got) == 4
    texts = {"s1": "01234abcdefg", "s2": "hijklmno"}
    for r in got:
        assert r.text is None or len(r.text) == r.character_count <= r.limit_characters
        for f in r.fragments or []:
            assert texts[f.span_id][f.source_start : f.source_end] == r.text[f.chunk_start : f.chunk_end]
    assert [r.text for r in got if r.chunk_id in "ef"] == [None, ""] and [r for r in got if r.chunk_id == "b"][0].fragments is None
    none = spark.createDataFrame([], CHUNKS)
    assert splitting.split_chunks(none, configs).count() == 0


def test_cells_of_many_ranges(spark):
    configs = spark.createDataFrame([(1, 20, 3), (2, 30, 0)], CONFIGS)
    texts = [sample(400, 1), sample(300, 2), "short"]
    rows = [(f"{k}{c}", c, t, None) for k, t in enumerate(texts) for c in (1, 2)] + [("01", 1, texts[0], None)]
    for many in (1, 3, 512):
        out = splitting.split_chunks(chunks(spark, *rows), configs, limits_per_range=many).collect()
        for k, t in enumerate(texts):
            for c, (limit, overlap) in ((1, (20, 3)), (2, (30, 0))):
                got = sorted((r.piece_start, r.piece_end) for r in out if r.chunk_id == f"{k}{c}")
                assert got == sorted(splitting.cuts(t, limit, overlap) * (2 if (k, c) == (0, 1) else 1))


def test_files_read_by_ranges(spark, tmp_path):
    text = sample(20_000, 5)
    (tmp_path / "big.txt").write_text(text, newline="")
    (tmp_path / "small.txt").write_text("just this", newline="")
    (tmp_path / "empty.txt").write_text("")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "length")
    want = splitting.cuts(text, 100, 10)
    for size, group in ((8000, 3), (1 << 20, 1024), (2500, 7)):
        out = splitting.split_files(spark, files.unionAll(files), limit=100, overlap=10, range_bytes=size, ranges_per_group=group).collect()
        big = sorted((r.piece_index, r.piece_start, r.piece_end, r.text) for r in out if r.path.endswith("big.txt"))
        assert [b[0] for b in big] == list(range(1, len(big) + 1))
        assert [(s, e) for _, s, e, _ in big] == want
        assert all(text[s:e] == t for _, s, e, t in big)
        assert [r.text for r in out if r.path.endswith("small.txt")] == ["just this"] and not [r for r in out if r.path.endswith("empty.txt")]


def test_undecodable_bytes(spark, tmp_path):
    data = random.Random(4).randbytes(3000) + "é倉😀 ".encode() * 300
    (tmp_path / "odd.bin").write_bytes(data)
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "length")
    out = splitting.split_files(spark, files, limit=50, overlap=0, range_bytes=701).collect()
    text = "".join(r.text for r in sorted(out, key=lambda r: r.piece_index))
    assert text.endswith("é倉😀 " * 300) and "\ufffd" in text
