"""Bytes between workloads."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dimension, in_order, stored
from .running import running, sessions

SERIES = ("host", "protocol", "address_family", "direction", "source_namespace", "source_owner_name", "source_owner_type", "destination_namespace", "destination_owner_name", "destination_owner_type")
#: Series kept, idle nanoseconds after which a series begins anew, and the name of what is over the cap.
MAX_SERIES, IDLE, OTHER = 4096, 15 * 60 * 1_000_000_000, "__other__"


def _known(flows: DataFrame) -> DataFrame:
    return flows.where(" and ".join(f"{c} is not null" for c in SERIES[4:]))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def _renamed(df: DataFrame, keys: Sequence[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], *rest)


def peer_sessions(flows: DataFrame, idle: int = IDLE) -> DataFrame:
    """Flows with all parts of both identities, with ``session``: the series' number after idle gaps.

    A row of zero bytes keeps a series alive but never begins one.
    """
    rows = stored(sessions(_known(flows), SERIES, ("ts", "seq"), "ts", idle))
    keys = (*SERIES, "session")
    first = rows.where("bytes > 0").groupBy(*keys).agg(F.min(F.struct("ts", "seq")).alias("_first"))
    begun = _renamed(first, keys, "_first")
    return rows.join(begun, _same(rows, begun, keys)).where(F.struct("ts", "seq") >= F.col("_first")).select(*rows.columns)


def _sweep(most: int, idle: int):
    """The series alive, in order of time: (feed, end). ``feed`` returns (sid, ts, seq) where a session gets a place."""
    live: set = set()
    ends: list = []

    def feed(ts, seq, sid, end, given):
        while ends and ends[0][0] <= ts:
            live.discard(heapq.heappop(ends)[1])
        if sid in live or not (given or len(live) < most):
            return []
        live.add(sid)
        heapq.heappush(ends, (end + idle, sid))
        return [(sid, ts, seq)]

    return feed, lambda: []


def _crowded(found: DataFrame, scope: Sequence[str], most: int, idle: int) -> DataFrame:
    """(sid, cluster) of the sessions that are alive when more than ``most`` of their scope would be; clusters of overlapping ones are independent of each other."""
    born = found.select(*scope, "sid", F.col("_first.ts").alias("t"), F.lit(1).alias("step"), F.col("_first.seq").alias("seq"))
    gone = found.select(*scope, "sid", (F.col("end") + idle).alias("t"), F.lit(-1).alias("step"), F.lit(-1).cast("long").alias("seq"))
    order = ("t", "step", "seq", "sid")  # at equal times places are freed first
    alive = stored(running(born.unionByName(gone), scope, order, {"alive": ("sum", "step")}))
    over = alive.withColumn("over", F.when((F.col("step") == 1) & (F.col("alive") > most), 1).otherwise(0))
    met = stored(running(over, scope, order, {"met": ("sum", "over")}))
    # a session is alive at such a moment if it makes one itself, or one comes before its end
    crowd = met.groupBy(*scope, "sid").agg((F.max(F.when(F.col("step") == -1, F.col("met"))) > F.max(F.when(F.col("step") == 1, F.col("met") - F.col("over")))).alias("crowded")).where("crowded").select("sid")
    mine = stored(running(born.unionByName(gone).join(crowd, "sid"), scope, order, {"alive": ("sum", "step")}))
    opens = mine.withColumn("opens", F.when((F.col("step") == 1) & (F.col("alive") == 1), 1).otherwise(0))
    return running(opens, scope, order, {"cluster": ("sum", "opens")}).where("step = 1").select("sid", "cluster")


def admitted(flows: DataFrame, keys: Sequence[str], scope: Sequence[str], most: int, idle: int = IDLE, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flows (keys, ts, seq, bytes) with ``born`` and ``overflow``, and the series that are alive after them: keys, born, end.

    Of each ``scope`` (some of ``keys``) at most ``most`` series are alive at a time. A series gets a place with its first bytes while one is free, keeps it as long as it isn't silent for ``idle``, and
    then frees it; ``born`` is when it got it. Without a place bytes are ``overflow``, and the series tries again with its next bytes. Flows without bytes keep a
    series alive, and are left out where it isn't. ``live`` are series alive from before: flows come behind them in time.

    Only where more series would be alive than there are places does order matter beyond a key. Those stretches are found with running sums, in slices; each stretch of overlapping sessions is then
    swept in order by one task, which holds the ``most`` series alive. All other sessions get their place at once.
    """
    rows = flows.withColumns({"_given": F.lit(False), "_born": F.lit(None).cast("long")})
    if live is not None:
        given = live.select(*keys, F.col("end").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("_given"), F.col("born").alias("_born"))
        rows = rows.unionByName(given, allowMissingColumns=True)
    rows = stored(sessions(rows, keys, ("ts", "seq"), "ts", idle, "_session"))
    key = (*keys, "_session")
    starts = F.when((F.col("bytes") > 0) | F.col("_given"), F.struct("ts", "seq"))
    found = stored(rows.groupBy(*key).agg(F.min(starts).alias("_first"), F.max("ts").alias("end"), F.min("_born").alias("_born")).where("_first is not null").withColumn("sid", F.monotonically_increasing_id()))
    crowd = stored(_crowded(found, scope, most, idle))
    named = _renamed(found, key, "sid", "_first", "end", F.col("_born").alias("_was"))
    tries = rows.where("bytes > 0 or _given").join(named, _same(rows, named, key)).join(crowd, "sid").select(*scope, "cluster", "ts", "seq", "sid", "end", "_given")
    # the types of the scope's columns, then a number that cluster and sid have
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in scope)
    places = in_order(tries, (*scope, "cluster"), ("ts", "seq"), lambda: _sweep(most, idle), f"{kinds}, cluster long, sid long, ts long, seq long")
    placed = places.select(F.col("sid").alias("_sid"), F.struct("ts", "seq").alias("_place"))
    marked = found.join(crowd.select(F.col("sid").alias("_c"), F.lit(True).alias("_crowded")), F.col("sid") == F.col("_c"), "left").join(placed, F.col("sid") == F.col("_sid"), "left")
    place = F.when(F.col("_crowded"), F.col("_place")).otherwise(F.col("_first"))
    got = stored(marked.select(*key, "end", place.alias("_place"), F.coalesce("_born", place["ts"]).alias("born")))
    mine = _renamed(got, key, "_place", "born")
    out = rows.where("not _given").join(mine, _same(rows, mine, key), "left").withColumn("overflow", F.col("_place").isNull() | (F.struct("ts", "seq") < F.col("_place")))
    kept = out.where("not overflow or bytes > 0").withColumn("born", F.when(~F.col("overflow"), F.col("born")))
    last = rows.agg(F.max("ts")).first()[0]
    alive = got.where(F.col("_place").isNotNull() & (F.col("end") + idle > F.lit(last))).select(*keys, "born", "end")
    return kept.select(*flows.columns, "born", "overflow"), alive


def _totals(rows: DataFrame, keys: Sequence[str], overflow: Column) -> DataFrame:
    """Sums by series; what is over the cap has no host and no names."""
    named = [F.when(overflow, F.lit(None)).otherwise(F.col(k)).alias(k) if k in ("host", "born") else F.when(overflow, F.lit(OTHER)).otherwise(F.col(k)).alias(k) if k in SERIES[4:] else F.col(k) for k in keys]
    return rows.select(*named, overflow.alias("overflow"), "value", "window_start", "window_end").groupBy(*keys, "overflow").agg(F.sum("value").alias("value"), F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"))


def peer_flow_bytes(flows: DataFrame, most: int = MAX_SERIES, idle: int | None = None) -> DataFrame:
    """Bytes by pair of workloads.

    At most ``most`` series keep their names; bytes of the rest go to one ``__other__`` series for each protocol, family and direction. Without ``idle`` the first
    ``most`` series of the table stay for good. With it the cap holds for the series of a host that are alive at a time, and a series is counted from when it got its place (``born``).
    """
    sums = (F.sum("bytes").alias("value"), F.min("interval_start").alias("window_start"), F.max("ts").alias("window_end"))
    if idle is not None:
        rows, _ = admitted(_known(flows), SERIES, ("host",), most, idle)
        keys = (*SERIES, "born")
        return _totals(rows.groupBy(*keys, "overflow").agg(*sums), keys, F.col("overflow"))
    # one row for each series first; only those are ranked
    series = _known(flows).where("bytes > 0").groupBy(*SERIES).agg(*sums, F.min(F.struct("ts", "seq")).alias("_first"))
    live = _renamed(series.orderBy("_first", *SERIES).limit(most), SERIES, F.lit(True).alias("_live"))
    marked = series.join(dimension(live, most), [series[k] == live[f"_{k}"] for k in SERIES], "left")
    return _totals(marked, SERIES, F.col("_live").isNull())
