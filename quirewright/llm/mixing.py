"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form one stream in a random but fixed order, repeated up to the allowed number of copies and
cut where its allotment ends. Streams are divided into quanta, equal parts of a block of a fixed size. A quantum k
of a source with weight w has the release time floor(k/w) and the deadline ceil((k+1)/w); earliest-deadline-first
over the released quanta gives every quantum its slot.

The schedule is made frame by frame, each in its own row of a table of frames, so neither the driver nor any task
holds more than a frame, and the block needn't grow with the data. What each source is due up to a frame's begin is
its share of the slots before, rounded so that all add up; inside a frame the weights are the quanta due in it, so
a frame begins and ends without lag. In quanta, a source is less than one from its frame's line by Pfair; the line
less than 1 + m/2 from the weights by the rounding, of m sources; and the quanta that end the streams, which are not
full, shift it by less than m + 1. A block has 4 + 2m quanta, so every source is at any slot less than one block from
its share. A document that spans quanta is given in parts, so slots are exactly full.

Positions in a stream are prefix sums on two levels over hash ranges of the documents. No source is gathered in
one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_rows, cut

#: Tokens of a block.
BLOCK = 1 << 18
#: Slots of a frame.
FRAME = 4096
#: Documents in a hash range, and rows that a prefix sum takes together.
ROWS_PER_RANGE, GROUP = 20_000, 1000


def pfair(quanta: list[int]) -> list[list[int]]:
    """Slots of the quanta of each task: ``out[s][k]`` is the slot of quantum k of source s.

    ``quanta``: of each source; its weight is its share of them. Ties go to the source with the lower number.
    """
    total = sum(quanta)
    slots: list[list[int]] = [[] for _ in quanta]
    waiting = [(0, s) for s, n in enumerate(quanta) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // quanta[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        k = len(slots[s])
        if k < quanta[s]:
            heapq.heappush(waiting, (k * total // quanta[s], s))
    return slots


def due(quanta: list[int], slots: int, frame: int = FRAME) -> list[int]:
    """Quanta of each source due in the first ``slots`` slots; they add up to ``slots`` and only grow from frame to frame.

    Sources with less than two quanta a frame are due at the middle of each; the others share the rest, the largest
    remainders rounded up.
    """
    total = sum(quanta)
    out = [(2 * slots * n + total) // (2 * total) if n * frame < 2 * total else 0 for n in quanta]
    large = [s for s, n in enumerate(quanta) if n * frame >= 2 * total]
    weight, rest = sum(quanta[s] for s in large), slots - sum(out)
    for s in large:
        out[s] = rest * quanta[s] // weight
    left = slots - sum(out)
    for s in sorted(large, key=lambda s: (-(rest * quanta[s] % weight), s))[:left]:
        out[s] += 1
    return out


def frame_slots(quanta: list[int], number: int, frame: int = FRAME) -> Iterator[tuple[int, int, int]]:
    """(source, quantum, slot) of frame ``number``."""
    frame = max(frame, 4 * len(quanta))
    begin, end = number * frame, min((number + 1) * frame, sum(quanta))
    before, after = due(quanta, begin, frame), due(quanta, end, frame)
    for s, own in enumerate(pfair([b - a for a, b in zip(before, after)])):
        for k, slot in enumerate(own):
            yield s, before[s] + k, begin + slot


def _key(col: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _before(df: DataFrame, keys: list[str], index: str, value: str, group: int = GROUP) -> DataFrame:
    """``df``, one row for each of ``keys`` and ``index``, with ``before``: the sum of ``value`` at lower indexes.

    ``group`` neighbouring indexes are added up first, so a window holds that many rows, or one for each group.
    """
    df = df.withColumn("_group", F.floor(F.col(index) / group))
    rows = Window.unboundedPreceding, -1
    sums = df.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*keys).orderBy("_group").rowsBetween(*rows)
    sums = sums.select(*keys, "_group", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*keys, "_group").orderBy(index).rowsBetween(*rows)
    df = df.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, [*keys, "_group"]).withColumn("before", F.col("before") + F.col("_above")).drop("_group", "_above")


class Mix:
    """The mixture of ``docs`` after ``targets``.

    docs: id, text, source; targets: mix_id, source, target_share, max_copies, budget_fraction. Sources match
    ignoring case and outer blanks; a null or unknown source belongs to no target, but its tokens count in the
    total. Null texts have no tokens, and what has none isn't in the mixture. Rows equal in id, source and text are
    one document. Repeated target rows count once; a target with a null field gets no documents. A source whose
    copies do not reach its target gives all it has; the other sources keep their targets, and ``report`` gives the
    shares reached.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        *,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        seed: int = 42,
        block: int = BLOCK,
        frame: int = FRAME,
        rows_per_range: int = ROWS_PER_RANGE,
    ) -> None:
        self.id_col, self.seed, self.block, self.frame = id_col, seed, block, frame
        self.spark = docs.sparkSession
        names = ["mix_id", "source", "target_share", "max_copies", "budget_fraction"]
        self.targets = [
            r.asDict()
            for r in bounded_rows(targets.select(*names, _key(F.col("source")).alias("key")).distinct(), 10_000, "targets")
        ]
        text = F.coalesce(F.col(text_col), F.lit(""))
        each = docs.select(
            F.col(id_col).alias("_id"),
            _key(F.col(source_col)).alias("_source"),
            F.octet_length(text).cast("long").alias("_tokens"),
            F.xxhash64(text).alias("_text"),
        )
        # exact copies of a row collapse; partial aggregation keeps a hot one from being shuffled
        self.docs = cut(each.groupBy("_id", "_source", "_tokens", "_text").agg(F.count("*").alias("_rows")))
        known = sorted({t["key"] for t in self.targets if t["key"] is not None})
        sums = (
            self.docs.groupBy(F.when(F.col("_source").isin(known), F.col("_source")).alias("_source"))
            .agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n"))
            .collect()
        )  # at most one row for each target source and one for the rest
        self.total = sum(r["tokens"] or 0 for r in sums)
        self.supply = {r["_source"]: r["tokens"] or 0 for r in sums if r["_source"] is not None}
        self.ranges = max(1, ceil(sum(r["n"] for r in sums) / rows_per_range))
        self.plan = self._plan()

    def _plan(self) -> list[dict]:
        plan = []
        for t in self.targets:
            whole = None not in (t["mix_id"], t["key"], t["target_share"], t["max_copies"], t["budget_fraction"])
            have = self.supply.get(t["key"], 0)
            target = t["target_share"] * t["budget_fraction"] * self.total if whole else 0.0
            reach = max(0, t["max_copies"]) * have if whole else 0
            plan.append(t | {"have": have, "target": target, "allot": min(max(0, ceil(target)), reach)})
        for mix in {p["mix_id"] for p in plan}:
            of = [p for p in plan if p["mix_id"] == mix and p["allot"] > 0]
            size = max(1, self.block // (4 + 2 * len(of)))
            for p in of:
                p |= {"quantum": size, "quanta": -(-p["allot"] // size)}
        return plan

    def positions(self) -> DataFrame:
        """Every document of a target source with the tokens before it in its source's stream."""
        docs = self.docs.filter(F.col("_source").isin(list(self.supply)) & (F.col("_tokens") > 0)).withColumn(
            "_order", F.xxhash64(F.lit(self.seed), "_id", "_text")
        )
        docs = docs.withColumn("_range", F.pmod(F.col("_order"), F.lit(self.ranges)))
        sums = docs.groupBy("_source", "_range").agg(F.sum("_tokens").alias("_in"))
        sums = _before(sums, ["_source"], "_range", "_in").drop("_in")
        inside = (
            Window.partitionBy("_source", "_range")
            .orderBy("_order", "_id", "_text")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        docs = docs.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
        return docs.join(sums, ["_source", "_range"]).select(
            "_id", "_source", "_tokens", (F.col("before") + F.col("_inside")).alias("_start")
        )

    def _of(self, mix: object) -> list[dict]:
        return [p for p in self.plan if p["mix_id"] == mix and p["allot"] > 0]

    def _slots(self, mix: object) -> int:
        """Slots of a frame of a mix: no frame has fewer than four a source."""
        return max(self.frame, 4 * len(self._of(mix)))

    def _frames(self) -> DataFrame:
        """(mix_id, number) of every frame."""
        mixes = [(m, ceil(sum(p["quanta"] for p in self._of(m)) / self._slots(m))) for m in {p["mix_id"] for p in self.plan if p["allot"] > 0}]
        return self.spark.createDataFrame(mixes, "mix_id INT, frames LONG").select(
            "mix_id", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("number")
        )

    def schedule(self) -> DataFrame:
        """(mix_id, _source, _k, slot): the slot of every quantum, each frame made on its own."""
        keys = {}  # bounded by the target rows
        for p in self.plan:
            if p["allot"] > 0:
                names, quanta = keys.setdefault(p["mix_id"], ([], []))
                names.append(p["key"])
                quanta.append(p["quanta"])
        frame = self.frame

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for mix, number in b[["mix_id", "number"]].itertuples(index=False):
                    names, quanta = keys[mix]
                    rows = [(mix, names[s], k, slot) for s, k, slot in frame_slots(quanta, number, frame)]
                    yield pd.DataFrame(rows, columns=["mix_id", "_source", "_k", "slot"])

        return self._frames().repartition("mix_id", "number").mapInPandas(run, "mix_id INT, _source STRING, _k LONG, slot LONG")

    def mixture(self) -> DataFrame:
        """(mix_id, slot, source, id, copy, part_start, tokens, stream_start): every mix in its order.

        Order by (slot, stream_start) to read a mix. ``copy`` counts from 1; a row is the part of a document's copy that
        lies in one slot, from token ``part_start`` on. The last document of a source is cut where its allotment ends.
        """
        asked = [
            (p["mix_id"], p["key"], p["source"], p["allot"], p["have"], ceil(p["allot"] / p["have"]), p["quantum"])
            for p in self.plan
            if p["allot"] > 0
        ]
        ask_ddl = "mix_id INT, _source STRING, source STRING, _allot LONG, _have LONG, _copies INT, _size LONG"
        ask = F.broadcast(self.spark.createDataFrame(asked, ask_ddl))  # bounded by the target rows (10,000)
        taken = (
            self.positions()
            .join(ask, "_source")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .withColumn("_from", (F.col("copy") - 1) * F.col("_have") + F.col("_start"))
            .withColumn("_to", F.least(F.col("_from") + F.col("_tokens"), F.col("_allot")))
            .filter(F.col("_from") < F.col("_to"))
            .withColumn("_k", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_size")), F.floor((F.col("_to") - 1) / F.col("_size")))))
            .withColumn("stream_start", F.greatest(F.col("_from"), F.col("_k") * F.col("_size")))
        )
        return taken.join(self.schedule(), ["mix_id", "_source", "_k"]).select(
            "mix_id",
            "slot",
            "source",
            F.col("_id").alias(self.id_col),
            "copy",
            (F.col("stream_start") - F.col("_from")).alias("part_start"),
            (F.least(F.col("_to"), (F.col("_k") + 1) * F.col("_size")) - F.col("stream_start")).alias("tokens"),
            "stream_start",
        )

    def report(self, mixture: DataFrame | None = None) -> DataFrame:
        """For every target row: what was asked, what the mixture holds, and the share reached.

        ``short``: the mixture holds less than what was asked.
        """
        got = (self.mixture() if mixture is None else mixture).groupBy("mix_id", "source").agg(
            F.sum("tokens").alias("tokens"), F.max("copy").alias("copies")
        )
        ddl = "mix_id INT, source STRING, target_share DOUBLE, max_copies INT, budget_fraction DOUBLE, target_tokens DOUBLE"
        names = [x.split()[0] for x in ddl.split(", ")]
        rows = [tuple((p | {"target_tokens": p["target"]})[n] for n in names) for p in self.plan]
        mine = Window.partitionBy("mix_id")  # rows of ``targets``
        return (
            self.spark.createDataFrame(rows, ddl)
            .join(got, ["mix_id", "source"], "left")
            .fillna(0, ["tokens", "copies"])
            .withColumn("short", F.col("tokens") < F.col("target_tokens"))
            .withColumn("share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(mine)), 9))
        )

    def deviation(self, mixture: DataFrame | None = None) -> DataFrame:
        """(mix_id, source, worst): how far each source ever is from its share of what was given so far, in blocks.

        Between two slots it is between what it is at them, for only one source goes on.
        """
        mixture = self.mixture() if mixture is None else mixture
        block = self.block
        names = {m: [p["source"] for p in self._of(m)] for m in {p["mix_id"] for p in self.plan if p["allot"] > 0}}
        allot = {m: [p["allot"] for p in self._of(m)] for m in names}
        if not names:
            return self.spark.createDataFrame([], "mix_id INT, source STRING, worst DOUBLE")
        size = F.create_map(*(F.lit(x) for m in names for x in (m, self._slots(m))))[F.col("mix_id")]
        slots = mixture.groupBy("mix_id", "slot", "source").agg(F.sum("tokens").alias("tokens")).withColumn("frame", F.floor(F.col("slot") / size))
        # every source at every frame's begin; as many rows as frames times the sources of a mix
        each = self._frames().withColumn("source", F.explode(F.create_map(*(x for m, n in names.items() for x in (F.lit(m), F.array(*map(F.lit, n)).cast("array<string>"))))[F.col("mix_id")]))
        sums = each.withColumnRenamed("number", "frame").join(slots.groupBy("mix_id", "frame", "source").agg(F.sum("tokens").alias("given")), ["mix_id", "frame", "source"], "left")
        sums = _before(sums.fillna(0, ["given"]), ["mix_id", "source"], "frame", "given")
        start = sums.groupBy("mix_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("source", "before"))).alias("before"))

        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            of, shares = names[key[0]], np.array(allot[key[0]], dtype=float)
            g = g.sort_values("slot")
            begin = dict(g["before"].iloc[0])
            given = np.zeros((len(g), len(of)))
            given[np.arange(len(g)), [of.index(s) for s in g["source"]]] = g["tokens"]
            given = np.vstack([np.zeros(len(of)), given.cumsum(axis=0)]) + np.array([begin.get(s, 0) for s in of])
            far = np.abs(given - given.sum(axis=1, keepdims=True) * shares / shares.sum()).max(axis=0) / block
            return pd.DataFrame({"mix_id": key[0], "source": of, "worst": far})

        each = slots.join(start, ["mix_id", "frame"]).groupBy("mix_id", "frame").applyInPandas(run, "mix_id INT, source STRING, worst DOUBLE")
        return each.groupBy("mix_id", "source").agg(F.max("worst").alias("worst"))
