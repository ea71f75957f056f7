"""Jobs as folds of their events: states, queueing, cumulative usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.functions.values import PRICE_IN, PRICE_OUT
from evidentia.shipping import ship

TERMINAL = ("complete", "failed", "cancelled")
#: The state that each kind of event asks for; a terminal state never changes.
NEXT = {"created": "queued", "consent": "queued", "started": "running", "partial": "partial", "completed": "complete", "failed": "failed", "cancelled": "cancelled"}


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job (job_id, seq, kind) from its events: the first terminal one, else the last."""
    asked = F.create_map(*(F.lit(x) for item in NEXT.items() for x in item))[F.col("kind")]
    rows = events.withColumn("state", asked).where("state IS NOT NULL")
    ends = F.min(F.when(F.col("state").isin(*TERMINAL), F.struct("seq", "state")))
    return rows.groupBy("job_id").agg(F.coalesce(ends["state"], F.max(F.struct("seq", "state"))["state"]).alias("state"), F.count("*").alias("n_events"))


def stream_job_states(events: DataFrame) -> DataFrame:
    """The same over a stream: one row for each job of a batch, its state so far."""
    ship(events.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = tuple(state.get) if state.exists else (None, 0)
        for row in pd.concat(list(batches), ignore_index=True).sort_values("seq").itertuples():
            if row.kind in NEXT:
                now, n = now if now in TERMINAL else NEXT[row.kind], n + 1
        state.update((now, n))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "n_events": [n]})

    return events.select("job_id", "seq", "kind").groupBy("job_id").applyInPandasWithState(update, "job_id long, state string, n_events long", "state string, n_events long", "update", GroupStateTimeout.NoTimeout)


def usage(calls: DataFrame) -> DataFrame:
    """Cumulative tokens and cost of each job after each call (job_id, seq, tokens_in, tokens_out)."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = {k: F.sum(k).over(w) for k in ("tokens_in", "tokens_out")}
    cost = (total["tokens_in"] * PRICE_IN + total["tokens_out"] * PRICE_OUT) / 1e6
    return calls.select("job_id", "seq", total["tokens_in"].alias("tokens_in"), total["tokens_out"].alias("tokens_out"), cost.alias("cost"))


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream that end after a gap; events later than lateness are left out."""
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")
