import random
from collections import defaultdict
from math import ceil

from quirewright.llm import mixing

DOCS = "doc_id BIGINT, text STRING, source STRING, copy STRING"
TARGETS = "mix_id INT, source STRING, target_share DOUBLE, max_copies INT, budget_fraction DOUBLE"


def test_schedule_keeps_every_source_within_a_quantum():
    random.seed(3)
    for _ in range(100):
        quanta = [random.randint(0, 50) for _ in range(random.randint(1, 8))]
        slots, total = mixing.pfair(quanta), sum(quanta)
        assert sorted(t for s in slots for t in s) == list(range(total)) and [len(s) for s in slots] == quanta
        assert all(s == sorted(s) for s in slots)
        for t in range(total):
            for s, w in zip(slots, quanta):
                assert abs(sum(x <= t for x in s) - (t + 1) * w / total) < 1


def test_frames_join_to_one_schedule_within_a_block():
    random.seed(5)
    for _ in range(60):
        many = random.randint(1, 12)
        quanta = [random.choice([0, 1, 2, random.randint(0, 30), random.randint(0, 900)]) for _ in range(many)]
        total, frame = sum(quanta), random.choice([16, 48, 100])
        whole = max(frame, 4 * many)
        rows = [r for f in range(ceil(total / whole)) for r in mixing.frame_slots(quanta, f, frame)]
        assert [slot for _, _, slot in sorted(rows, key=lambda r: r[2])] == list(range(total))
        assert sorted((s, k) for s, k, _ in rows) == [(s, k) for s, n in enumerate(quanta) for k in range(n)]
        done = [0] * many
        for s, k, slot in sorted(rows, key=lambda r: r[2]):
            assert k == done[s]  # in the stream's order
            done[s] += 1
            for n, d in zip(quanta, done):
                assert abs(d - (slot + 1) * n / total) < 2 + many / 2


def make(spark, docs, targets, **options):
    return mixing.Mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **options)


def test_shares_copies_and_order(spark):
    docs = [(i, "x" * 100, "big", "z") for i in range(300)] + [(1000 + i, "y" * 50, " SMALL ", "z") for i in range(20)] + [(5000, "q" * 700, None, "z")]
    mix = make(spark, docs, [(1, "big", 0.5, 1, 0.5), (1, "small", 0.5, 3, 0.5)], block=400, frame=16, rows_per_range=16)
    rows = mix.mixture().collect()
    total = 300 * 100 + 20 * 50 + 700
    report = {r.source: r for r in mix.report().collect()}
    assert report["small"].short and not report["big"].short
    assert report["small"].tokens == 3 * 20 * 50 and report["small"].copies == 3
    assert report["big"].tokens == ceil(total / 4)
    assert abs(report["big"].share + report["small"].share - 1) < 1e-6
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id, r.copy].append((r.part_start, r.tokens))
    cut = 0
    for (doc, _), p in parts.items():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
        cut += sum(n for _, n in p) != (50 if doc >= 1000 else 100)
    assert cut <= 1  # only the document at the end of the allotment of ``big``
    assert {c for d, c in parts if d < 1000} == {1} and {c for d, c in parts if d >= 1000} == {1, 2, 3}
    worst = {r.source: r.worst for r in mix.deviation().collect()}
    assert set(worst) == {"big", "small"} and 0 < max(worst.values()) < 1
    sums, far = defaultdict(int), 0
    for r in sorted(rows, key=lambda r: (r.slot, r.stream_start)):
        sums[r.source] += r.tokens
        far = max(far, abs(sums["small"] - (sums["big"] + sums["small"]) * 3000 / (3000 + ceil(total / 4))))
    assert abs(far / 400 - max(worst.values())) < 1e-9


def test_deviation_of_unequal_sources_and_long_documents(spark):
    random.seed(8)
    docs = [(i, "x" * random.choice([1, 30, 4000]), random.choice("aaaaaabbbcd"), "z") for i in range(400)]
    targets = [(1, s, w, 3, 0.7) for s, w in zip("abcd", (0.61, 0.3, 0.085, 0.005))] + [(2, s, 0.25, 1, 1.0) for s in "abcd"]
    mix = make(spark, docs, targets, block=6000, frame=32)
    assert all(r.worst < 1 for r in mix.deviation().collect())


def test_positions_are_a_prefix_sum(spark):
    docs = [(i, "x" * (i % 9), "s", "z") for i in range(200)]
    got = sorted((r._start, r._tokens) for r in make(spark, docs, [(1, "s", 1.0, 1, 1.0)], rows_per_range=7).positions().collect())
    at = 0
    for start, tokens in got:
        assert start == at
        at += tokens
    assert at == sum(i % 9 for i in range(200))


def test_repeats_nulls_and_nothing(spark):
    docs = [(1, "abcd", "s", "z")] * 50 + [(None, "ab", "s", "z"), (None, "cd", "s", "z"), (2, None, "s", "z"), (3, "", "s", "z")]
    mix = make(spark, docs, [(1, "s", 1.0, 2, 1.0), (1, "absent", 0.1, 1, 1.0), (2, None, 0.5, 1, 1.0), (3, "s", None, 1, 1.0), (1, "s", 1.0, 2, 1.0)])
    assert mix.total == 8 and mix.supply == {"s": 8}
    report = {(r.mix_id, r.source): r for r in mix.report().collect()}
    assert report[1, "s"].tokens == 8 and report[1, "absent"].short and report[1, "absent"].tokens == 0
    assert report[3, "s"].tokens == 0
    empty = mixing.Mix(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "s", 1.0, 1, 1.0)], TARGETS))
    assert empty.mixture().count() == 0 and empty.report().first().tokens == 0
