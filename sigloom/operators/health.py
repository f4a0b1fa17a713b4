"""Keyed state machines over each key's events in order.

Events are dealt by key, sorted within each task, and walked with one small state at a time: no key's history is ever
gathered, however long it is.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Minutes of back-off by consecutive failures; failures that degrade and quarantine a source.
BACKOFF = (0, 2, 5, 15, 60, 180, 360)
DEGRADED, QUARANTINED = 2, 8
#: Calls for an account a day at first, more for a clean day, and the bounds; hours that an open circuit rests.
BUDGET, MORE, LEAST, MOST, REST_HOURS = 30, 4, 6, 120, 6

KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}


def walk(rows: DataFrame, key: str, columns: list[str], start: tuple, step: Callable[..., tuple], out: str) -> DataFrame:
    """A row of ``key`` and the first fields of the last state, as ``out`` names them, for each key.

    ``step`` takes the state, the time and the columns of an event and gives the next state.  Events of one time come in
    the order of their ids; a null key is a key of its own; no rows give none."""
    names = [x.split() for x in out.split(", ")]
    kind = rows.schema[key].dataType.simpleString()
    types = [KINDS[kind], *(KINDS[k] for _, k in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, start, False
        for batch in batches:
            done: list[tuple] = []
            for name, time, _, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or name != at:
                    if begun:
                        done.append((at, *state[: len(names)]))
                    at, state, begun = name, start, True
                state = step(state, time, *rest)
            yield table(done)
        if begun:
            yield table([(at, *state[: len(names)])])

    def table(found: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([r[k] for r in found], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(arrays, names=[key, *(n for n, _ in names)])

    ordered = rows.select(key, "at", "event_id", *columns).repartition(key).sortWithinPartitions(key, "at", "event_id")
    return ordered.mapInArrow(run, f"{key} {kind}, {out}")


def health_states(rows: DataFrame) -> DataFrame:
    """rows (source, at, event_id, ok, latency).  A success heals; the n-th failure in a row backs off and may degrade or
    quarantine, which only a success undoes; the latency is a mean of old and new of 0.7 and 0.3, in whole units."""

    def step(state: tuple, at: dt.datetime, ok: bool | None, latency: float | None) -> tuple:
        failures, name, mean, _ = state
        if ok:
            return 0, "healthy", None if latency is None else math.floor(latency if mean is None else 0.7 * mean + 0.3 * latency), None
        failures += 1
        if failures >= QUARANTINED or name == "quarantined":
            name = "quarantined"
        elif failures >= DEGRADED or name == "degraded":
            name = "degraded"
        return failures, name, mean, at + dt.timedelta(minutes=BACKOFF[min(failures, len(BACKOFF) - 1)])

    return walk(rows, "source", ["ok", "latency"], (0, "healthy", None, None), step, "failures int, state string, latency bigint, until timestamp_ntz")


def account_states(rows: DataFrame) -> DataFrame:
    """rows (account, at, event_id, ok).  A day without failure raises the budget, a failure halves it and opens the
    circuit; after its rest the next call is a probe that closes it or opens it again."""

    def step(state: tuple, at: dt.datetime, ok: bool | None) -> tuple:
        budget, circuit, opened, refused, day, clean = state
        new_day = day is None or at.date() > day
        if day is not None and new_day and clean:
            budget = min(budget + MORE, MOST)
        refuses = circuit == "open" and not (opened is not None and at >= opened + dt.timedelta(hours=REST_HOURS))
        fails = not ok and not refuses
        if fails:
            budget = max(budget // 2, LEAST)
        circuit = "open" if fails or refuses else "closed"
        opened = at if fails else opened if refuses else None
        return budget, circuit, opened, refused + refuses, at.date(), (new_day or clean) and not fails

    return walk(rows, "account", ["ok"], (BUDGET, "closed", None, 0, None, True), step, "budget int, circuit string, opened timestamp_ntz, refused int")


def pacing(rows: DataFrame, interval: int, patience: int) -> DataFrame:
    """rows (host, at, event_id).  Every call takes the host's next free slot, ``interval`` seconds after the last; a
    call that would wait longer than ``patience`` is skipped."""

    def step(state: tuple, at: dt.datetime) -> tuple:
        following, taken, skipped = state
        slot = at if following is None else max(at, following)
        if slot > at + dt.timedelta(seconds=patience):
            return following, taken, skipped + 1
        return slot + dt.timedelta(seconds=interval), taken + 1, skipped

    return walk(rows, "host", [], (None, 0, 0), step, "next timestamp_ntz, taken int, skipped int")
