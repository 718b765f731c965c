import random
from collections import defaultdict

from quirewright.llm import packing

DDL = "doc_id BIGINT, text STRING, source STRING, tokens STRING"


def settings(spark, *caps):
    return spark.createDataFrame(list(enumerate(caps, 1)), "setting_id INT, capacity_tokens INT")


def check(items, placed, capacity, conflicts=True):
    """Every byte is placed once, in order; bins hold no more than the capacity and no two copies."""
    fill, held, pieces = defaultdict(int), defaultdict(list), defaultdict(list)
    for i, piece, start, tokens, b in placed:
        fill[b] += tokens
        if tokens:
            held[b].append((i, items[i][1]))
        pieces[i].append((piece, start, tokens))
    assert all(v <= capacity for v in fill.values())
    for i, (size, _) in enumerate(items):
        at = 0
        for k, (piece, start, tokens) in enumerate(sorted(pieces[i])):
            assert piece == k and start == at
            at += tokens
        assert at == size and (len(pieces[i]) == 1 or size > capacity)
        assert all(t == capacity for _, _, t in sorted(pieces[i])[:-1])
    if conflicts:
        for b, inside in held.items():
            texts = [c for i, c in set(inside)]
            assert len(texts) == len(set(texts))
    return len(fill)


def brute_best_fit(items, capacity, apart=()):
    """Best fit decreasing by looking at every bin; items are (size, cluster, source)."""
    bins = []
    for size, cluster, source in sorted(items, key=lambda x: (-x[0], x[1])):
        bad = {b for a, b in apart if a == source} | {a for a, b in apart if b == source}
        fits = [b for b in bins if b[0] >= size and cluster not in b[1] and not bad & b[2]]
        b = min(fits, key=lambda b: (b[0], b[3]), default=None)
        if b is None:
            bins.append(b := [capacity, set(), set(), len(bins)])
        b[0] -= size
        b[1].add(cluster)
        b[2].add(source)
    return len(bins)


def test_best_fit_against_brute_force():
    random.seed(7)
    for _ in range(200):
        capacity = random.randint(5, 30)
        items = []
        for k in range(random.randint(0, 40)):
            c = random.randint(0, 8) if random.random() < 0.4 else 100 + k
            items.append((random.Random(c).randint(0, capacity * 2) if random.random() < 0.2 else 1 + random.Random(c).randint(0, capacity - 1), c))
        sizes = {c: s for s, c in reversed(items)}
        items = [(sizes[c], c) for _, c in items]
        got = packing.best_fit([s for s, _ in items], [-1] * len(items), [c for _, c in items], capacity)
        n = check(items, got, capacity)
        if all(0 < s <= capacity for s, _ in items):
            assert n == brute_best_fit([(s, c, 0) for s, c in items], capacity)


def test_sources_kept_apart_against_brute_force():
    random.seed(9)
    for _ in range(200):
        capacity, pairs = random.randint(5, 30), [(0, 1), (1, 2), (0, 3)][: random.randint(1, 3)]
        apart = {}
        for a, b in pairs:
            apart[a], apart[b] = apart.get(a, 0) | 1 << b, apart.get(b, 0) | 1 << a
        items = [(random.randint(1, capacity), k, random.randint(0, 4)) for k in range(random.randint(0, 40))]
        got = packing.best_fit([x[0] for x in items], [x[2] for x in items], [x[1] for x in items], capacity, apart)
        held = defaultdict(set)
        for i, *_, b in got:
            held[b].add(items[i][2])
        assert not any({a, b} <= h for h in held.values() for a, b in pairs)
        assert check([x[:2] for x in items], got, capacity) == brute_best_fit(items, capacity, pairs)


def test_placements_dont_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 3)
    rows = [(i % 60, "x" * (i % 60 % 17), "ab"[i % 60 % 2], "clash") for i in range(150)] + [(7, "x" * 7, "b", "clash")] * 10
    df = spark.createDataFrame(rows, DDL)
    every = [sorted(map(str, packing.pack(d, settings(spark, 20), rows_per_group=25).collect())) for d in (df, df.repartition(7), df.orderBy("text"))]
    assert every[0] == every[1] == every[2] and len(every[0]) == 160


def test_given_clusters(spark):
    rows = [(1, "aaa", "s", "near"), (2, "aab", "s", "near"), (3, "aab", "s", None), (4, "aab", "s", None)]
    placed = packing.pack(spark.createDataFrame(rows, DDL), settings(spark, 100), cluster_col="tokens").collect()
    of = {r.doc_id: r.container_id for r in placed}
    assert of[1] != of[2] and of[3] != of[4] and len(set(of.values())) == 2


def test_hot_cluster_takes_one_bin_each():
    got = packing.best_fit([3] * 5000 + [1] * 10, [-1] * 5010, [1] * 5000 + list(range(2, 12)), 100)
    assert len({b for *_, b in got}) == 5000


def test_kept_apart(spark):
    rows = [(i, "x" * 10 + str(i), "A" if i % 2 else " b ", "clash") for i in range(20)]
    placed = packing.pack(spark.createDataFrame(rows, DDL), settings(spark, 1000), keep_apart=[("a", "b")])
    assert all(len(r.sources) == 1 for r in packing.containers(placed).collect())
    assert placed.select("container_id").distinct().count() == 2


def test_nulls_empties_repeats_and_groups(spark):
    rows = [(1, None, None, "x"), (2, "", "s", "x"), (3, "é" * 8, "s", "x"), (3, "é" * 8, "s", "x"), (None, "abc", "s", "x"), (5, "y" * 25, None, "x")]
    df = spark.createDataFrame(rows, DDL)
    placed = packing.pack(df, settings(spark, 10, None, 0), rows_per_group=2).collect()
    assert {r.setting_id for r in placed} == {1}
    whole = defaultdict(int)
    for r in placed:
        whole[r.doc_id] += r.tokens
    assert dict(whole) == {1: 0, 2: 0, 3: 32, None: 3, 5: 25}
    assert {(r.setting_id, r.doc_id) for r in packing.oversized(packing.pack(df, settings(spark, 10))).collect()} == {(1, 3), (1, 5)}
    assert packing.pack(spark.createDataFrame([], DDL), settings(spark, 10)).count() == 0


def test_fill_report(spark):
    df = spark.createDataFrame([(i, "z" * (1 + i % 7) + str(i), "s", "x") for i in range(500)], DDL)
    r = packing.fill_report(packing.pack(df, settings(spark, 50))).first()
    assert r.containers >= r.least_containers and r.unused_share < 0.05
    assert r.tokens == sum(len("z" * (1 + i % 7) + str(i)) for i in range(500))
