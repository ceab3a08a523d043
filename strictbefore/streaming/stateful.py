"""Operators with state on a stream: events of a key in the order of event time, a cache whose entries expire, ratings.

State is kept by transformWithState. What a batch brings of a key is sorted and kept as a run, in parts of bounded size that are one state value each, with the instant a run
goes on at beside it. A timer of the key's earliest instant wakes it when the watermark has passed that; then the runs' parts that hold due events are merged, in whole instants, and
handed on as tables. So a batch touches the keys it has rows of and the parts that fall due, and an event costs a share of a part and no state call of its own.
Rows behind the watermark are dropped by Spark, so the result doesn't depend on how the rows were dealt to batches. A restart from the checkpoint goes on with the state it finds;
checkpoints of before this layout, with a state value an instant, can't be read.

A key's events are handled by one task at a time, in order; that is what the operators mean. In memory are a part of each run that falls due and the events of one instant.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strictbefore.functions.model import START_RATING
from strictbefore.operators.elo import update

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events, and bytes, of a run's part; parts that a run may have before it is written.
PART, PART_BYTES, RUN_PARTS = 10_000, 2**22, 10
TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
MOST = 2**63 - 1
#: Before 1700 and from 2200 on, event time goes a thousandth as fast on the watermark's scale: frames have no times before 1677 or after 2262.
EARLY, LATE, SLOWER = -8_520_336_000_000_000, 7_258_118_400_000_000, 1024


def micros(ts: dt.datetime) -> int:
    return round((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def scaled(at: int) -> int:
    """A microsecond since 1970 on the watermark's scale; the same for all but far times, and never in another order."""
    return LATE + (at - LATE) // SLOWER if at > LATE else EARLY - (EARLY - at) // SLOWER if at < EARLY else at


def reached(mark: int) -> int:
    """The last microsecond that is ``mark`` or less on the watermark's scale."""
    return LATE + (mark - LATE) * SLOWER + SLOWER - 1 if mark >= LATE else EARLY - (EARLY - mark) * SLOWER if mark < EARLY else mark


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def in_order(rows: pa.Table) -> pa.Table:
    """By time, then number, then whatever tells two events apart."""
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names], null_placement="at_start")).combine_chunks()


def times(rows: pa.Table) -> np.ndarray:
    return rows["at"].to_numpy()


class InOrder(StatefulProcessor):
    """Hands a key's events to ``apply`` as tables in the order of their time, then of their number; all events of an instant are in one table.

    ``EVENT`` names an event's fields as DDL; the first two are ``at long``, microseconds since 1970, and a number that tells events of an instant apart.
    """

    EVENT = "at long, id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(name, TYPES[kind]) for name, kind in (x.split() for x in self.EVENT.split(", "))])
        self.runs = handle.getMapState("runs", "run long", "at long, part int, parts int")
        self.waiting = handle.getMapState("waiting", "run long, part int", "events binary")
        self.last = handle.getValueState("last", "run long, due long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare what else is kept by key."""

    def apply(self, key: tuple, events: pa.Table) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def passed(self, key: tuple, watermark: int) -> None:
        """All events up to the end of the microsecond ``watermark`` have been handled."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, due = self.last.get() if self.last.exists() else (-1, None)
        held: list[pa.Table] = []
        first = MOST
        for frame in rows:
            held.append(self.table(frame))
            if sum(t.num_rows for t in held) >= RUN_PARTS * PART or sum(t.nbytes for t in held) >= RUN_PARTS * PART_BYTES:
                run, first, held = run + 1, min(first, self.keep(run + 1, held)), []
        if held:
            run, first = run + 1, min(first, self.keep(run + 1, held))
        self.last.update((run, self.wake(first, due)))
        return iter(())

    def table(self, frame: pd.DataFrame) -> pa.Table:
        """A batch's rows with their nulls, which came as columns of their own: a frame would make doubles of longs with nulls."""
        arrays = []
        for f in self.schema:
            null = frame[f"no_{f.name}"].to_numpy(dtype=bool) if f"no_{f.name}" in frame else None
            arrays.append(pa.array(frame[f.name].tolist() if f.type == pa.string() else frame[f.name].to_numpy(), f.type, mask=null))
        return pa.Table.from_arrays(arrays, schema=self.schema)

    def keep(self, run: int, tables: list[pa.Table]) -> int:
        """Write a run in parts; its first instant."""
        rows = in_order(pa.concat_tables(tables))
        size = max(1, min(PART, PART_BYTES * rows.num_rows // max(rows.nbytes, 1)))
        for part, at in enumerate(range(0, rows.num_rows, size)):
            self.waiting.updateValue((run, part), (packed(rows.slice(at, size).combine_chunks()),))
        first = int(times(rows)[0])
        self.runs.updateValue((run,), (first, 0, -(-rows.num_rows // size)))
        return first

    def wake(self, at: int, due: int | None) -> int | None:
        """Have a timer for the end of the millisecond that microsecond ``at`` is in, unless an earlier one is set: that of ``due``."""
        if at == MOST:
            return due
        instant = -(-scaled(at) // 1000)
        if due is not None and due <= instant:
            return due
        self.handle.registerTimer(instant)
        return instant

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        watermark = reached(1000 * mark)
        runs = {run: list(state) for (run,), state in self.runs.iterator()}
        for events in self.due({run: state for run, state in runs.items() if state[0] <= watermark}, watermark):
            yield from self.apply(key, events)
        left = [at for at, part, parts in (self.runs.getValue((run,)) if runs[run][0] <= watermark else runs[run] for run in runs if self.runs.containsKey((run,)))]
        run, due = self.last.get()
        self.last.update((run, self.wake(min(left, default=MOST), due if due is not None and due > mark else None)))
        self.passed(key, watermark)

    def due(self, runs: dict[int, list], watermark: int) -> Iterator[pa.Table]:
        """Take the events up to ``watermark`` out of these runs, in order and in whole instants: a merge that holds a part a run."""
        heads: dict[int, pa.Table] = {}

        def more(run: int) -> None:
            part = runs[run][1]
            rows = unpacked(self.waiting.getValue((run, part))[0])
            self.waiting.removeKey((run, part))
            runs[run][1] += 1
            heads[run] = pa.concat_tables([heads[run], rows]) if run in heads else rows

        while runs:
            for run in runs:
                if run not in heads:
                    more(run)
            ends = {run: int(times(heads[run])[-1]) for run, (_, part, parts) in runs.items() if part < parts}
            upto = min([watermark, *(at - 1 for at in ends.values())])
            counts = {run: int(np.searchsorted(times(rows), upto, "right")) for run, rows in heads.items()}
            if any(counts.values()):
                yield in_order(pa.concat_tables([heads[run].slice(0, n) for run, n in counts.items() if n]))
            elif upto < watermark:  # one instant fills the parts: all of it is needed
                for run, at in ends.items():
                    if at == upto + 1:
                        more(run)
            for run, n in counts.items():
                heads[run] = heads[run].slice(n)
                at, part, parts = runs[run]
                if heads[run].num_rows and upto == watermark:  # what is left goes back in the part's place
                    self.waiting.updateValue((run, part - 1), (packed(heads[run].combine_chunks()),))
                    self.runs.updateValue((run,), (int(times(heads[run])[0]), part - 1, parts))
                    del runs[run], heads[run]
                elif not heads[run].num_rows:
                    del heads[run]
                    if part == parts:
                        self.runs.removeKey((run,))
                        del runs[run]

    def close(self) -> None:
        pass


def ordered(rows: DataFrame, processor: InOrder, out: str, late: str, *keys: str) -> DataFrame:
    """A stream of rows with ``ts`` and a processor's fields but ``at``, through the processor by key.

    Keys go as text, and a field that isn't text as its value or zero and a column that says which: frames have no nulls of other kinds.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cols: list[Column] = []
    for name, kind in (x.split() for x in processor.EVENT.split(", ")[1:]):
        value = F.col(name).cast(kind)
        cols += [value.alias(name)] if kind == "string" else [F.coalesce(value, F.lit(0).cast(kind)).alias(name), value.isNull().alias(f"no_{name}")]
    at = F.col("at")
    mark = F.when(at > LATE, LATE + F.expr(f"(at - {LATE}) div {SLOWER}")).when(at < EARLY, EARLY - F.expr(f"({EARLY} - at) div {SLOWER}")).otherwise(at)
    slim = rows.filter("ts is not null").withColumn("at", F.unix_micros("ts")).withColumn("ts", F.timestamp_micros(mark)).withWatermark("ts", late).select(*[F.col(k).cast("string").alias(k) for k in keys], "ts", "at", *cols)
    return slim.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "EventTime")


class Cache(InOrder):
    """An entry per key: a put replaces it, a get finds it up to and including the instant it expires at.

    The entry's own expiry decides what a get finds; the timer set for the time after it then takes the entry out of the state,
    in the next batch where the watermark was past it already.
    """

    EVENT = "at long, id long, put boolean, payload string, ttl_ms long"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "payload string, fetched long, expires long")

    def apply(self, key: tuple, events: pa.Table) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        at, put = times(events), events["put"].fill_null(False).to_numpy()
        payload, fetched, expires = held or (None, 0, None)
        # the entry of before is number 0, the event n a get may find is number n + 1
        found = np.maximum.accumulate(np.where(put, np.arange(1, len(at) + 1), 0))
        ttl = events["ttl_ms"]
        ends = np.where(ttl.is_null().to_numpy(), MOST, at + 1000 * np.minimum(ttl.fill_null(0).to_numpy(), (MOST - np.maximum(at, 0)) // 1000))
        ends, since = np.concatenate([[MOST if expires is None else expires], ends]), np.concatenate([[fetched], at])
        hit = ((found > 0) | (held is not None)) & (ends[found] >= at)
        gets = np.flatnonzero(~put)
        if len(gets):
            hits, of = hit[gets], found[gets]
            payloads = pa.chunked_array([pa.array([payload], pa.string()), *events["payload"].chunks]).take(pa.array(of, mask=~hits))
            ids = events["id"].take(pa.array(gets))
            yield pd.DataFrame({
                "id": pd.arrays.IntegerArray(ids.fill_null(0).to_numpy().copy(), ids.is_null().to_numpy()), "hit": hits, "payload": pd.Series(payloads.to_pylist(), dtype=object),
                "age_ms": pd.arrays.IntegerArray(np.where(hits, (at[gets] - since[of]) // 1000, 0), ~hits),
            })
        if found[-1]:
            k = int(found[-1])
            end = int(ends[k])
            self.entry.update((events["payload"][k - 1].as_py(), int(since[k]), None if end == MOST else end))

    def passed(self, key: tuple, watermark: int) -> None:
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[2] is not None:
            if held[2] <= watermark:
                self.entry.clear()
            else:
                self.handle.registerTimer(scaled(held[2]) // 1000 + 1)


def cache_lookups(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """What a cache answers to each get of a stream of puts and gets (keys, ts, id, put, payload, ttl_ms): id, hit, payload, age_ms.

    A ttl of null never expires. Events of one instant count by id.
    """
    return ordered(events, Cache(), "id long, hit boolean, payload string, age_ms long", late, *keys)


class Ratings(InOrder):
    """Elo ratings of a cohort's teams, one state entry a team; those of the teams that play are read and written once for all that falls due."""

    def __init__(self, *cohort: str) -> None:
        self.cohort = cohort

    EVENT = "at long, fixture_id long, home_id long, away_id long, home_goals long, away_goals long"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team long", "rating double")
        self.now: dict[int, float] = {}

    def rating(self, team: int) -> float:
        if team not in self.now:
            self.now[team] = self.ratings.getValue((team,))[0] if self.ratings.containsKey((team,)) else START_RATING
        return self.now[team]

    def apply(self, key: tuple, events: pa.Table) -> Iterator[pd.DataFrame]:
        instant, before, out = None, {}, []
        columns = (events[c].to_pylist() for c in ("at", "home_id", "away_id", "home_goals", "away_goals"))
        for at, home, away, home_goals, away_goals in zip(*columns, strict=True):
            # matches of one instant don't see each other: what an instant found is remembered until the next
            if at != instant:
                instant, before = at, {}
            h, a = self.rating(home), self.rating(away)
            out.append((before.setdefault(home, h), before.setdefault(away, a)))
            self.now[home], self.now[away] = update(h, a, home_goals, away_goals)
        ids = events["fixture_id"]
        yield pd.DataFrame({**dict(zip(self.cohort, key, strict=True)), "fixture_id": pd.arrays.IntegerArray(ids.fill_null(0).to_numpy().copy(), ids.is_null().to_numpy()), "at": times(events), "home_rating": [r[0] for r in out], "away_rating": [r[1] for r in out]})

    def passed(self, key: tuple, watermark: int) -> None:
        for team, rating in self.now.items():
            self.ratings.updateValue((team,), (rating,))
        self.now = {}


def live_ratings(found: DataFrame, late: str = "1 day", cohort: tuple[str, ...] = ("league_id",)) -> DataFrame:
    """Ratings before each match of a stream of finished matches, per cohort as a match moves two teams of it."""
    kinds = {n: t for n, t in found.dtypes}
    got = ordered(found, Ratings(*cohort), f"{', '.join(f'{c} string' for c in cohort)}, fixture_id long, at long, home_rating double, away_rating double", late, *cohort)
    return got.select(*[F.col(c).cast(kinds[c]).alias(c) for c in cohort], "fixture_id", F.timestamp_micros("at").alias("ts"), "home_rating", "away_rating")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its sources hold and read what it wrote; run again with the same folders it goes on from there."""
    spark: SparkSession = stream.sparkSession
    running = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
