"""The book queue as a pure state machine, replayed over batches; and the same step for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "user_id long, waiting long, running long, ready long, stopped long, powered boolean"


class State(NamedTuple):
    """Books by state; one runs at most. ``powered``: the queue starts the next by itself."""

    waiting: int = 0
    running: int = 0
    ready: int = 0
    stopped: int = 0
    powered: bool = True


def step(state: State, event: str) -> State:
    """One tick: a signup queues a book, a purchase finishes the running one, an error stops it, a click pauses it and the queue, a view
    powers the queue again. After each, a powered queue without a running book starts the next; an empty one powers off."""
    if event == "signup":
        state = state._replace(waiting=state.waiting + 1)
    elif event == "view":
        state = state._replace(powered=True, waiting=state.waiting + 1)
    elif state.running:
        if event == "purchase":
            state = state._replace(running=0, ready=state.ready + 1)
        elif event == "error":
            state = state._replace(running=0, stopped=state.stopped + 1)
        elif event == "click":
            state = state._replace(running=0, waiting=state.waiting + 1, powered=False)
    if state.powered and not state.running:
        state = state._replace(waiting=state.waiting - 1, running=1) if state.waiting else state._replace(powered=False)
    return state


def replay(events: pd.DataFrame) -> pd.DataFrame:
    state = State()
    for event in events.sort_values(["ts", "event_id"])["event_type"]:
        state = step(state, event)
    return pd.DataFrame([(int(events["user_id"].iloc[0]), *state)], columns=["user_id", *State._fields])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    state = State(*held.get) if held.exists else State()
    rows = pd.concat(list(batches))
    for event in rows.sort_values(["ts", "event_id"])["event_type"]:
        state = step(state, event)
    held.update(tuple(state))
    yield pd.DataFrame([(key[0], *state)], columns=["user_id", *State._fields])


def stream(events: DataFrame) -> DataFrame:
    """The queue over a stream of events: a row with the new state for each user and micro-batch."""
    fields = SCHEMA.partition(", ")[2]
    return events.groupBy("user_id").applyInPandasWithState(_advance, SCHEMA, fields, "update", "NoTimeout")
