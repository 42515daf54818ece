"""Stream operators: request routing and rate-limited events per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.scalars import display_title, is_pdf_uri, resolve_uri
from quire.operators.pages import action_lookup

#: Every third completion, at least 90 seconds after the last one shown.
EVERY = 3
GAP_S = 90
#: Events above which a key is cut into pieces of time, and about how many a piece has.
HOT_EVENTS = 1 << 20
PIECE_EVENTS = 1 << 18
#: Stands for the time of the last emission where there was none.
NEVER = -(2**63)


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def route_requests(requests: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Requests for documents with path, title, action and target; others are left out.

    Stateless, for tables and streams alike: a filter, expressions and a join
    with a lookup of three rows.
    """
    stamp = F.lit(0) if stamp is None else stamp
    name = F.regexp_extract("uri", r"([^/]*)$", 1)
    named = requests.filter(is_pdf_uri(F.col("uri"))).withColumn("path", resolve_uri(F.col("uri"), name, stamp)).filter("path IS NOT NULL")
    routed = action_lookup(named.withColumn("title", display_title(F.col("path"))))
    target = F.when(F.col("action") == "merge", "tab 0").when(F.col("action") == "split", "tab 2").otherwise("viewer")
    return routed.select("request_id", "ts", "user_id", "path", "title", "action", target.alias("target"))


class Throttle:
    """State of a key: events so far and the time of the last one emitted."""

    def __init__(self, every: int, gap_s: int, n: int = 0, last: int = NEVER):
        self.every, self.gap, self.n, self.last = every, gap_s * 1_000_000, n, last

    def emits(self, at: int, free: bool) -> bool:
        self.n += 1
        shown = self.n > 1 and self.n % self.every == 0 and free and (self.last == NEVER or at - self.last >= self.gap)
        if shown:
            self.last = at
        return shown


def _steps(times: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """What a piece makes of the emission before it: (latest first emission, last emission), by time.

    An emission before the piece is no later than its first candidate, so the
    piece's first emission is among the candidates up to the first one a gap after
    that. First emissions that end alike are one step.
    """
    after = np.searchsorted(times, times + gap)
    end = np.where(after < len(times), after, np.arange(len(times)))
    while (end[end] != end).any():
        end = end[end]
    last = times[end[: int(np.searchsorted(times, times[0] + gap)) + 1]]
    turns = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
    return list(zip(times[turns].tolist(), last[turns].tolist(), strict=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of equal keys of a sorted stream; a key that spans batches comes in several."""
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], b.slice(start, i - start)
                start = i


def _with_pieces(rows: DataFrame, hot_events: int, piece_events: int) -> DataFrame:
    """Rows with ``piece``, by time for users with many events and 0 for others, and ``hot``."""
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("at").alias("low"), F.max("at").alias("high")).filter(F.col("events") > hot_events)
    many = F.call_function("div", F.col("events"), F.lit(piece_events).cast("long")) + 1
    hot = sizes.select(F.col("user_id").alias("hot_user"), "low", (F.call_function("div", F.col("high") - F.col("low"), many) + 1).alias("width"))
    piece = F.coalesce(F.call_function("div", F.col("at") - F.col("low"), F.col("width")), F.lit(0).cast("long"))
    dealt = rows.join(hot, rows["user_id"].eqNullSafe(hot["hot_user"]), "left")
    return dealt.select(*rows.columns, piece.alias("piece"), F.col("width").isNotNull().alias("hot"))


def _entries(hot: DataFrame, every: int, gap_s: int) -> DataFrame:
    """hot_user, hot_piece, before (events of the user in earlier pieces), last (the user's last emission in them)."""
    gap, user = gap_s * 1_000_000, hot.schema["user_id"].dataType.simpleString()
    counts = hot.groupBy("user_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("user_id", "piece", F.coalesce(F.sum("n").over(W.partitionBy("user_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    known = before.select(F.col("user_id").alias("hot_user"), F.col("piece").alias("hot_piece"), "before")
    same = hot["user_id"].eqNullSafe(known["hot_user"]) & (hot["piece"] == known["hot_piece"])

    def steps(batches):
        key, n, times = None, 0, []

        def out():
            rows = _steps(np.array(times, np.int64), gap) if times else []
            return pa.record_batch([pa.array([x] * len(rows), t) for x, t in zip(key, kinds, strict=True)] + [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["user_id", "piece", "upto", "last"])

        for own, b in _groups(batches, ("user_id", "piece")):
            kinds = (b.column("user_id").type, pa.int64())
            if own != key:
                if key is not None:
                    yield out()
                key, n, times = own, b.column("before")[0].as_py(), []
            for at, free in zip(b.column("at").to_pylist(), b.column("free").to_pylist(), strict=True):
                n += 1
                if n > 1 and n % every == 0 and free:
                    times.append(at)
        if key is not None:
            yield out()

    def walk(batches):
        user_id, piece, last, done = None, None, NEVER, True
        for (who, which), b in _groups(batches, ("user_id", "piece")):
            kind = b.column("user_id").type
            if piece is None or who != user_id:
                user_id, last, piece = who, NEVER, None
            if which != piece:
                piece, done = which, False
                yield pa.record_batch([pa.array([who], kind), pa.array([which], pa.int64()), pa.array([last], pa.int64())], names=["hot_user", "hot_piece", "last"])
            for upto, end in zip(b.column("upto").to_pylist(), b.column("last").to_pylist(), strict=True):
                if not done and upto is not None and (last == NEVER or upto >= last + gap):
                    last, done = end, True

    ordered = hot.join(known, same).select("user_id", "piece", "before", "at", "event_id", "free").repartition("user_id", "piece").sortWithinPartitions("user_id", "piece", "at", "event_id")
    made = ordered.mapInArrow(steps, f"user_id {user}, piece long, upto long, last long")
    # pieces without a candidate have no step but take part in the walk
    made = made.unionByName(counts.select("user_id", "piece", F.lit(None).cast("long").alias("upto"), F.lit(None).cast("long").alias("last")))
    walked = made.repartition("user_id").sortWithinPartitions("user_id", "piece", "upto").mapInArrow(walk, f"hot_user {user}, hot_piece long, last long")
    counted = known.withColumnsRenamed({"hot_user": "u", "hot_piece": "p"})
    return walked.join(counted, walked["hot_user"].eqNullSafe(counted["u"]) & (F.col("hot_piece") == F.col("p"))).select("hot_user", "hot_piece", "before", "last")


def throttle_events(events: DataFrame, every: int = EVERY, gap_s: int = GAP_S, available: Column | None = None, hot_events: int = HOT_EVENTS, piece_events: int = PIECE_EVENTS) -> DataFrame:
    """Events that are emitted: each ``every``-th of a key but never its first, at least ``gap_s`` after the last emitted.

    The gap counts from the last *emitted* event, so a key's events are taken in
    order of time and id. They are sorted by Spark and streamed through the task
    of their key, which holds the key's state only. A key with over ``hot_events``
    is cut into pieces of time: counts by piece give each event's number; each
    piece tells as a step function where the emissions would end for each first one;
    one task walks through a key's steps, which tells the state at the start of each
    piece; then pieces are streamed like keys.

    Defined cases: events without a time are left out and not counted; times may lie
    before 1970; null keys are one key; rows that are equal count each.
    """
    free = F.lit(True) if available is None else F.coalesce(available, F.lit(False))
    rows = events.select("user_id", "event_id", "ts", _micros().alias("at"), free.alias("free")).filter("at IS NOT NULL")
    schema = rows.select("user_id", "event_id", "ts").schema.add("n", "long")
    dealt = _with_pieces(rows, hot_events, piece_events)
    entries = _entries(dealt.filter("hot").drop("hot", "ts"), every, gap_s)
    same = dealt["user_id"].eqNullSafe(entries["hot_user"]) & (F.col("piece") == F.col("hot_piece"))
    started = dealt.join(entries, same, "left").select(*rows.columns, "piece", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("last", F.lit(NEVER)).alias("last"))

    def fold(batches):
        key, state = None, Throttle(every, gap_s)
        for b in batches:
            keys = list(zip(b.column("user_id").to_pylist(), b.column("piece").to_pylist(), strict=True))
            times, can = (b.column(c).to_pylist() for c in ("at", "free"))
            keep, numbers = [], []
            for i, own in enumerate(keys):
                if own != key:
                    key, state = own, Throttle(every, gap_s, b.column("before")[i].as_py(), b.column("last")[i].as_py())
                if state.emits(times[i], can[i]):
                    keep.append(i)
                    numbers.append(state.n)
            yield pa.record_batch([*(b.column(c).take(pa.array(keep, pa.int64())) for c in ("user_id", "event_id", "ts")), pa.array(numbers, pa.int64())], names=["user_id", "event_id", "ts", "n"])

    return started.repartition("user_id", "piece").sortWithinPartitions("user_id", "piece", "at", "event_id").mapInArrow(fold, schema)


def throttle_stream(events: DataFrame, every: int = EVERY, gap_s: int = GAP_S, available: Column | None = None, delay: str | None = None) -> DataFrame:
    """``throttle_events`` on a stream: the state of a key is its count and last emission.

    Without ``delay`` rows are ordered within each micro-batch, and late rows never
    emit again. With it (``"10 minutes"``) the stream equals the table whatever the
    order of rows within the delay: events wait in their key's state until the
    watermark has passed them, are then taken in order of time and id, and a timer
    of event time takes those of keys without new rows. What a key holds is its events of
    the last ``delay``; rows that come later still are left out. Events without a
    time are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    free = F.lit(True) if available is None else F.coalesce(available, F.lit(False))
    result, columns = "user_id long, event_id long, at long, n long", ["user_id", "event_id", "at", "n"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Throttle(every, gap_s, *(state.get if state.exists else ()))
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = [(key[0], event_id, at, own.n) for at, event_id, free in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["free"].tolist(), strict=True) if own.emits(at, free)]
        state.update((own.n, own.last))
        yield pd.DataFrame(out, columns=columns)

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, *held = state.get if state.exists else (0, NEVER, [], [], [])
        own, mark = Throttle(every, gap_s, n, last), state.getCurrentWatermarkMs() * 1000
        waiting = list(zip(*map(list, held), strict=True))
        for f in frames:
            waiting += zip(f["at"].tolist(), f["event_id"].tolist(), f["free"].tolist(), strict=True)
        waiting.sort()
        ready = sum(1 for at, *_ in waiting if at < mark)
        out = [(key[0], event_id, at, own.n) for at, event_id, free in waiting[:ready] if own.emits(at, free)]
        rest = waiting[ready:]
        state.update((own.n, own.last, *([r[i] for r in rest] for i in range(3))))
        if rest:  # the timer fires when the watermark is past the first that waits
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=columns)

    timed = events if delay is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = timed.select("user_id", "event_id", "ts", _micros().alias("at"), free.alias("free")).filter("at IS NOT NULL")
    if delay is None:
        emitted = keyed.drop("ts").groupBy("user_id").applyInPandasWithState(step, result, "n long, last long", "append", GroupStateTimeout.NoTimeout)
    else:
        held = "n long, last long, ats array<long>, ids array<long>, frees array<boolean>"
        emitted = keyed.groupBy("user_id").applyInPandasWithState(wait, result, held, "append", GroupStateTimeout.EventTimeTimeout)
    return emitted.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "n")
