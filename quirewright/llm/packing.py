"""Filling fixed-capacity containers: conflict-constrained best fit, largest items first.

Items are dealt to groups of a bounded size by a hash of their id, text and number among equal rows, so no source,
key or cluster of copies can make one group large, and a scan that is repeated or read in other parts gives the same
groups. Each group is packed on its own. Every bin carries two bitmaps: the sources and the clusters of copies it
holds. Bins are kept ordered by residual capacity, those with the same sources that matter in one order, so orders
with a source that must be kept apart from the item's are passed over as a whole. In the others the successor search
starts at the smallest residual that is large enough and goes on until a bin is found that holds no copy of the
item; the tightest of these bins takes it. Only ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Sequence
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

#: Items packed together; the loss is about one container of each size a group.
ROWS_PER_GROUP = 20_000
#: Equal rows that one task makes items of.
COPIES = 10_000


def best_fit(
    sizes: Sequence[int],
    sources: Sequence[int],
    clusters: Sequence[int],
    capacity: int,
    apart: dict[int, int] | None = None,
) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, start, tokens, bin) of every piece.

    ``sources``: small ints, -1 for none. ``clusters``: equal for copies. ``apart``: source -> bitmap of sources
    that may not share a bin with it. Items over ``capacity`` are cut into full pieces and a rest.
    """
    apart = apart or {}
    many = Counter(clusters)
    bit = {c: k for k, c in enumerate(c for c, n in many.items() if n > 1)}
    placed: list[tuple[int, int, int, int, int]] = []
    holds: dict[int, tuple[int, int]] = {}  # bin -> bitmaps of sources and clusters
    rest: list[tuple[int, int, int, int, int]] = []  # -size, cluster, item, piece, start
    empty: list[int] = []
    bins = 0
    for i, size in enumerate(sizes):
        if size == 0:
            empty.append(i)
            continue
        piece = start = 0
        while size - start > capacity:
            placed.append((i, piece, start, capacity, bins))
            holds[bins] = (1 << sources[i] if sources[i] >= 0 else 0, 0)
            bins, piece, start = bins + 1, piece + 1, start + capacity
        rest.append((start - size, clusters[i], i, piece, start))
    rest.sort()
    matter = 0
    for bitmap in apart.values():
        matter |= bitmap
    orders: dict[int, list[int]] = {}  # bitmap of the sources that matter -> residual << 32 | bin, in order
    last, after = None, {}
    for minus, cluster, i, piece, start in rest:
        size = -minus
        source = sources[i]
        own = 1 << bit[cluster] if cluster in bit else 0
        bad = apart.get(source, 0)
        if (cluster, size, source) != last:
            last, after = (cluster, size, source), {}
        best = None
        for sign, order in orders.items():
            if sign & bad:
                continue
            # copies follow one another: bins before the last one looked at hold a copy and still do
            at = bisect_left(order, max(size << 32, after.get(sign, 0)))
            while own and at < len(order) and holds[order[at] & 0xFFFFFFFF][1] & own:
                at += 1
            if own:
                after[sign] = order[at] if at < len(order) else capacity + 1 << 32
            if at < len(order) and (best is None or order[at] < best[0]):
                best = order[at], sign, at
        if best is None:
            found, residual = bins, capacity
            bins += 1
            holds[found] = (0, 0)
        else:
            found, residual = best[0] & 0xFFFFFFFF, best[0] >> 32
            del orders[best[1]][best[2]]
        s, c = holds[found]
        s |= 1 << source if source >= 0 else 0
        holds[found] = (s, c | own)
        placed.append((i, piece, start, size, found))
        if residual > size:
            insort(orders.setdefault(s & matter, []), (residual - size) << 32 | found)
    # empty items need no room, only a bin without a source that is kept apart from theirs
    where: dict[int, int] = {}
    for i in empty:
        source = sources[i]
        if source not in where:
            bad = apart.get(source, 0)
            b = next((b for b in range(bins - 1, -1, -1) if not holds.get(b, (0, 0))[0] & bad), bins)
            bins = max(bins, b + 1)
            s, c = holds.get(b, (0, 0))
            holds[b] = (s | (1 << source if source >= 0 else 0), c)
            where[source] = b
        placed.append((i, 0, 0, 0, where[source]))
    return placed


def pack(
    items: DataFrame,
    settings: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    keep_apart: Iterable[tuple[str, str]] = (),
    rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """Placement of every item in a container of each setting's capacity.

    Result (setting_id, capacity_tokens, container_id, ``id_col``, source, piece, pieces, token_start, tokens):
    one row for each piece; ``pieces`` is 1 unless the item alone exceeds the capacity, then all but the last
    are full. Size is in tokens, one for each UTF-8 byte. Copies never share a container: items of one ``cluster_col``, as
    a near-duplicate detection gives, or, where it is null or not given, of equal texts. Nor do
    sources of a pair in ``keep_apart``. Null texts count as empty; empty items take no room and join a
    container of their group. Each input row is an item, also a repeated row or one with a null id; null
    sources conflict with none. Settings with a null or non-positive capacity give no containers. Other columns
    of the input are not read. Container ids are unique within a setting.
    """
    rows = bounded_rows(settings.select("setting_id", "capacity_tokens").distinct(), 1000, "settings")
    capacities = sorted({(r[0], r[1]) for r in rows if r[1] is not None and r[1] > 0 and r[0] is not None})
    pairs = [tuple(p) for p in keep_apart]
    names = sorted({x for p in pairs for x in p})
    bits = {x: k for k, x in enumerate(names)}
    apart: dict[int, int] = {}
    for a, b in pairs:
        apart[bits[a]] = apart.get(bits[a], 0) | 1 << bits[b]
        apart[bits[b]] = apart.get(bits[b], 0) | 1 << bits[a]
    groups = max(1, ceil(items.select(id_col).count() / rows_per_group))
    text = F.coalesce(F.col(text_col), F.lit(""))
    equal = F.xxhash64(text)
    cluster = equal if cluster_col is None else F.when(F.col(cluster_col).isNull(), equal).otherwise(F.xxhash64(F.lit("cluster"), F.col(cluster_col)))
    keys = ["_id", "_size", "_cluster", "_text", "_source"]
    rows = items.select(
        F.col(id_col).alias("_id"),
        F.octet_length(text).alias("_size"),
        cluster.alias("_cluster"),
        equal.alias("_text"),
        F.lower(F.trim(F.col(source_col))).alias("_source"),
    ).groupBy(*keys).agg(F.count("*").alias("_rows"))
    # each of equal rows is an item; very many of them are made in several tasks
    few = rows.filter(F.col("_rows") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    blocks = rows.filter(F.col("_rows") > COPIES).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_rows") - 1) / COPIES))))
    many = blocks.repartition("_id", "_text", "_block").withColumn(
        "_copy", F.explode(F.sequence(F.col("_block") * COPIES + 1, F.least(F.col("_rows"), (F.col("_block") + 1) * COPIES)))
    )
    narrow = few.unionByName(many.drop("_block")).drop("_rows").withColumn("_group", F.pmod(F.xxhash64(*keys, "_copy"), F.lit(groups)))
    id_type = items.schema[id_col].dataType.simpleString()

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_text", "_id", "_source", "_copy"])  # the same whatever came first
        codes, known = pd.factorize(g["_source"])
        places = {k: bits.get(x, len(bits) + k) for k, x in enumerate(known)}
        sources = [places.get(c, -1) for c in codes]
        sizes, clusters = g["_size"].tolist(), g["_cluster"].tolist()
        out = []
        for setting, capacity in capacities:
            got = pd.DataFrame(
                best_fit(sizes, sources, clusters, capacity, apart),
                columns=["i", "piece", "token_start", "tokens", "bin"],
            )
            pick = got["i"].to_numpy()
            got["setting_id"], got["capacity_tokens"] = setting, capacity
            got["container_id"] = got["bin"] + (int(key[0]) << 32)
            got["_id"] = g["_id"].to_numpy()[pick]
            got["source"] = g["_source"].to_numpy()[pick]
            got["pieces"] = got.groupby("i")["piece"].transform("size")
            out.append(got)
        columns = ["setting_id", "capacity_tokens", "container_id", "_id", "source", "piece", "pieces", "token_start", "tokens"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    ddl = (
        f"setting_id INT, capacity_tokens INT, container_id BIGINT, _id {id_type}, source STRING, "
        "piece INT, pieces INT, token_start BIGINT, tokens BIGINT"
    )
    return narrow.groupBy("_group").applyInPandas(run, ddl).withColumnRenamed("_id", id_col)


def containers(placed: DataFrame) -> DataFrame:
    """One row for each container: its fill, items and sources."""
    return placed.groupBy("setting_id", "container_id").agg(
        F.max("capacity_tokens").alias("capacity_tokens"),
        F.sum("tokens").alias("tokens"),
        F.count("*").alias("items"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def fill_report(placed: DataFrame) -> DataFrame:
    """How well each setting's containers are filled, against the least number possible."""
    each = placed.groupBy("setting_id", "container_id").agg(
        F.max("capacity_tokens").alias("capacity_tokens"), F.sum("tokens").alias("tokens")
    )
    total = each.groupBy("setting_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens")
    )
    return total.select(
        "*",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


def oversized(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(setting_id, id) of the items that had to be divided."""
    return placed.filter((F.col("pieces") > 1) & (F.col("piece") == 0)).select("setting_id", id_col)
