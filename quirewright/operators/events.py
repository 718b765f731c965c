"""Analytics over an append-only event log: pages by key, counters, what a purge would take, and states folded from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_page(events: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """The next ``limit`` events after a key, in order: a keyset page."""
    return events.filter(F.col("event_id") > after).orderBy("event_id").limit(limit)


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def purge_preview(events: DataFrame, cutoff: str) -> DataFrame:
    """Per event type: how many events lie before the cutoff and how many would stay."""
    old = F.col("ts") < F.lit(cutoff).cast("timestamp")
    return events.groupBy("event_type").agg(F.count_if(old).alias("eligible"), F.count_if(~old).alias("kept"))


def purge(events: DataFrame, cutoff: str) -> DataFrame:
    """The log without what lies before the cutoff; events without a time stay."""
    return events.filter(F.coalesce(F.col("ts") >= F.lit(cutoff).cast("timestamp"), F.lit(True)))


#: Transitions of a state machine: (state, event type, state after it); what isn't named leaves the state as it is.
Transitions = tuple[tuple[str, str, str], ...]


def state_names(transitions: Transitions, start: str) -> list[str]:
    """The states of a machine, the start first."""
    return list(dict.fromkeys([start, *(x for a, _, b in transitions for x in (a, b))]))


def _step(transitions: Transitions, names: list[str]) -> Column:
    """What each event type makes of each state, as an array over the states."""
    same = F.array(*(F.lit(k) for k in range(len(names))))
    out = same
    for kind in sorted({e for _, e, _ in transitions}):
        goes = {names.index(a): names.index(b) for a, e, b in transitions if e == kind}
        out = F.when(F.col("event_type") == kind, F.array(*(F.lit(goes.get(k, k)) for k in range(len(names))))).otherwise(out)
    return out


def folded_states(events: DataFrame, transitions: Transitions, start: str, key: str = "user_id", bucket: str = "1 day") -> DataFrame:
    """(``key``, state, events, last_at): the state each key's events lead to from ``start``, in the order of ts and event_id.

    An event is a map of states, and maps are composed in any grouping: first those of a key's ``bucket`` of time, then the
    buckets', so no key is gathered as a whole. Repeated events count once, events without a time or key not at all.
    All in the JVM.
    """
    names = state_names(transitions, start)
    rows = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(key, "event_id", "ts", "event_type").distinct()
    rows = rows.select(key, "event_id", "ts", _step(transitions, names).alias("map"), F.window("ts", bucket).start.alias("_bucket"))
    same = F.array(*(F.lit(k) for k in range(len(names))))

    def composed(maps: Column) -> Column:
        return F.aggregate(maps, same, lambda acc, m: F.transform(acc, lambda s: F.get(m.getField("map"), s)))

    first = rows.groupBy(key, "_bucket").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "map"))).alias("maps"), F.count("*").alias("n"), F.max("ts").alias("last")
    )
    first = first.select(key, "_bucket", composed(F.col("maps")).alias("map"), "n", "last")
    whole = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_bucket", "map"))).alias("maps"), F.sum("n").alias("events"), F.max("last").alias("last_at"))
    known = F.array(*(F.lit(n) for n in names))
    return whole.select(key, F.get(known, F.get(composed(F.col("maps")), F.lit(0))).alias("state"), "events", "last_at")
