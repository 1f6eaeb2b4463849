"""The lifecycle as carried state: events are judged as they arrive, against what their key has accepted so far."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = frozenset("initialized adopted trial_requested refit_failed challenger_fitted trial_decided trial_cancelled promoted".split())
OF_A_CYCLE = frozenset("refit_failed challenger_fitted trial_decided trial_cancelled promoted".split())  # refused before the cycle was requested
REFITS, CLOSING = frozenset(("refit_failed", "challenger_fitted")), frozenset(("trial_cancelled", "promoted"))
MOST_REFITS = 2
JUDGED = "sequence long, key string, cycle_id string, kind string, as_of timestamp_ntz, outcome string"
STATE = "last long, cycles string"  # microseconds of the last accepted event, and refits by open cycle


def judge(events: Iterable[tuple], last: int, cycles: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(outcome, last) of each event in order of arrival; cycles is brought up to date.

    events: cycle_id, kind, as_of in microseconds. Refused are kinds that are not known, events before the last accepted
    one (time never runs back), events of a cycle that is not open, and refits beyond two a cycle. What is refused
    changes nothing. A cycle that was cancelled or promoted is closed and leaves the state, so that it stays small.
    """
    for cycle, kind, at in events:
        if kind not in KINDS:
            outcome = "unknown"
        elif at < last:
            outcome = "late"
        elif kind in OF_A_CYCLE and cycle not in cycles:
            outcome = "no_cycle"
        elif kind in REFITS and cycles[cycle] >= MOST_REFITS:
            outcome = "too_many_refits"
        else:
            outcome, last = "accepted", at
            if kind == "trial_requested":
                cycles.setdefault(cycle, 0)
            elif kind in REFITS:
                cycles[cycle] += 1
            elif kind in CLOSING:
                del cycles[cycle]
        yield outcome, last


def _judged(frame: pd.DataFrame, last: int, cycles: dict[str, int]) -> tuple[pd.DataFrame, int]:
    frame = frame.sort_values("sequence", kind="stable")
    times = frame["as_of"].to_numpy("datetime64[us]").astype("int64").tolist()
    found = list(judge(zip(frame["cycle_id"], frame["kind"], times, strict=True), last, cycles))
    return frame.assign(outcome=[o for o, _ in found])[[c.split()[0] for c in JUDGED.split(", ")]], found[-1][1] if found else last


def judged_stream(events: DataFrame) -> DataFrame:
    """Each arriving event with its outcome. events: sequence, key, cycle_id, kind, as_of; a stream. Within a micro-batch a
    key's events are taken by sequence; what comes with a later batch comes later."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, cycles = state.get if state.exists else (-(2**62), "{}")
        held = json.loads(cycles)
        out, last = _judged(pd.concat(list(frames)), last, held)
        state.update((last, json.dumps(held)))
        yield out

    return events.groupBy("key").applyInPandasWithState(step, JUDGED, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame) -> DataFrame:
    """The same of a journal that is there as a whole: one replay a key."""
    return events.groupBy("key").applyInPandas(lambda frame: _judged(frame, -(2**62), {})[0], JUDGED)
