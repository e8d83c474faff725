"""Admission under a budget of requests and tokens in a sliding window, with waits.

An admission depends on all earlier ones of its key, so a key's events are folded in
order, one after another, by one small ledger.  In a batch the events of a key stream
through a sorted partition; in a stream the ledger is the key's state.  Either way
only what lies in the window is held, never a whole key.

An event is a ``reserve`` (an estimate of prompt and output tokens) or a ``reconcile``
(what was used).  A key's caller waits until its request is admitted, so an event that
comes while it waits is handled after it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest sleep between two looks at the budget, what is added to each, and the share of the newest cost in the moving factor (fixed values of the rule).
NAP, SLACK, SHARE = 30.0, 0.05, 0.2

COLUMNS = ["kind", "prompt", "output", "actual_prompt", "cached", "completion", "warm"]
RESULT = "waited double, admitted double, reserved long, requests long, tokens long, factor double"


@dataclass
class Ledger:
    """What one key has reserved within the window; times are seconds."""

    max_requests: int
    max_tokens: int
    window: float
    clock: float = float("-inf")
    factor: float = 1.0
    requests: deque = field(default_factory=deque)
    tokens: deque = field(default_factory=deque)
    used: int = 0

    def forget(self, now: float) -> None:
        """Drop what is as old as the window."""
        while self.requests and self.requests[0] <= now - self.window:
            self.requests.popleft()
        while self.tokens and self.tokens[0][0] <= now - self.window:
            self.used -= self.tokens.popleft()[1]

    def needed(self, now: float, cost: int) -> float:
        """Seconds until a slot and enough tokens are free, 0 if they are."""
        wait = 0.0
        if len(self.requests) >= self.max_requests:
            wait = self.requests[0] + self.window - now
        left = self.used + cost - self.max_tokens
        for at, n in self.tokens if left > 0 else ():
            left -= n
            if left <= 0:
                wait = max(wait, at + self.window - now)
                break
        return max(0.0, wait)

    def reserve(self, at: float, prompt: int, output: int) -> tuple[float, float, int]:
        """Wait for the budget and take it: seconds waited, time of admission, tokens reserved.

        A cost beyond the whole budget can never be admitted and raises no wait: its
        time of admission is NaN and nothing is taken.
        """
        now = begun = max(at, self.clock)
        cost = max(1, round(max(0, prompt) * self.factor) + max(0, output))
        if cost > self.max_tokens:
            return 0.0, float("nan"), 0
        while True:
            self.forget(now)
            wait = self.needed(now, cost)
            if wait <= 0:
                break
            now += min(wait, NAP) + SLACK
        self.clock = now
        self.requests.append(now)
        self.tokens.append((now, cost))
        self.used += cost
        return now - begun, now, cost

    def reconcile(self, at: float, prompt: int, actual: int, cached: int, completion: int) -> None:
        """The last reservation becomes what was used; what prompts cost moves the factor."""
        self.clock = max(at, self.clock)
        uncached = max(0, actual - max(0, cached))
        if self.tokens:
            then, n = self.tokens[-1]
            used = max(1, uncached + max(0, completion))
            self.tokens[-1] = (then, used)
            self.used += used - n
        if prompt > 0:
            self.factor = (1 - SHARE) * self.factor + SHARE * uncached / prompt

    def take(self, at: float, kind: str, prompt: int, output: int, actual: int, cached: int, completion: int, warm: bool) -> tuple:
        """One event; its row of ``RESULT``."""
        waited, admitted, cost = 0.0, at, 0
        if not warm and kind == "reserve":
            waited, admitted, cost = self.reserve(at, prompt, output)
        elif not warm and kind == "reconcile":
            self.reconcile(at, prompt, actual, cached, completion)
        self.forget(max(at, self.clock))
        return waited, admitted, cost, len(self.requests), self.used, self.factor


def normal(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column) -> DataFrame:
    """Key and order columns, ``_at`` in seconds and the event's numbers; a number that is null counts as zero."""
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in COLUMNS[1:6]]
    return events.select(*keys, *order, (F.unix_micros(at.cast("timestamp")) / 1e6).alias("_at"), F.coalesce("kind", F.lit("")).alias("kind"), *numbers, F.coalesce("warm", F.lit(False)).alias("warm"))


def _fold(ledger: Ledger, rows: pd.DataFrame) -> list[tuple]:
    return [ledger.take(*row) for row in rows[["_at", *COLUMNS]].itertuples(index=False)]


def admit(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, max_requests: int, max_tokens: int, window: float = 60.0) -> DataFrame:
    """Every event with seconds waited, time of admission, tokens reserved, and the window and factor after it.

    Events of a key go by time, then by the ``order`` columns.  ``events`` has the columns
    ``kind, prompt, output, actual_prompt, cached, completion, warm``; a warm-up event
    passes by the budget.
    """
    rows = normal(events, keys, order, at).repartition(*keys).sortWithinPartitions(*keys, "_at", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, *order).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ledger = None, None
        for batch in batches:
            out = []
            # a batch holds runs of keys; the last run's ledger goes on into the next batch
            starts = batch[list(keys)].ne(batch[list(keys)].shift()).any(axis=1) if len(batch) else pd.Series(dtype=bool)
            for _, run_ in batch.groupby(starts.cumsum(), sort=False):
                key = tuple(run_[k].iloc[0] for k in keys)
                if key != last:
                    last, ledger = key, Ledger(max_requests, max_tokens, window)
                out += _fold(ledger, run_)
            yield pd.concat([batch[[*keys, *order]].reset_index(drop=True), pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {RESULT}")


def admit_stream(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, max_requests: int, max_tokens: int, window: float = 60.0) -> DataFrame:
    """The same over a stream whose batches come in the order of time; a key's ledger is its state."""
    rows = normal(events, keys, order, at)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, *order).schema.fields)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        ledger = Ledger(max_requests, max_tokens, window)
        if state.exists:
            clock, factor, requests, times, costs = state.get
            ledger = Ledger(max_requests, max_tokens, window, clock, factor, deque(requests), deque(zip(times, costs)), sum(costs))
        mine = pd.concat(list(batches)).sort_values(["_at", *order], kind="stable")
        out = pd.DataFrame(_fold(ledger, mine), columns=[c.split()[0] for c in RESULT.split(", ")])
        state.update((ledger.clock, ledger.factor, list(ledger.requests), [float(t) for t, _ in ledger.tokens], [int(n) for _, n in ledger.tokens]))
        yield pd.concat([mine[[*keys, *order]].reset_index(drop=True), out], axis=1)

    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, {RESULT}", "clock double, factor double, requests array<double>, times array<double>, costs array<long>", "append", "NoTimeout")
