"""Champion policy of repeated reviews: a fold over each key's reviews, in batch and as a stream.

Comparison: completion, then failed checks, greatest and summed violation (both
to 1e-6), then similarity (to 1e-4). The tolerances make it no total order, so
it is folded and not sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.shipping import ship

PATIENCE = 3
STATE = "reviews int, complete boolean, checks int, failed int, worst double, total double, similarity double, stale int"
OUTPUT = "reference string, url string, seq long, decision string, stale int, champion double, action string"
INPUT = ["reference", "url", "seq", "similarity", "complete", "final", "checks", "failed", "worst", "total"]


def compare(new: tuple, old: tuple) -> int:
    """1 if new (complete, checks, failed, worst, total, similarity) is better than old, -1 if worse, else 0."""
    if new[0] != old[0]:
        return 1 if new[0] else -1
    if new[1] and old[1]:
        for k, tolerance in ((2, 0), (3, 1e-6), (4, 1e-6)):
            if abs(new[k] - old[k]) > tolerance:
                return 1 if new[k] < old[k] else -1
    gain = new[5] - old[5]
    return 1 if gain > 1e-4 else -1 if gain < -1e-4 else 0


def step(state: tuple | None, row) -> tuple[tuple, tuple]:
    """The state after one review, and (decision, stale, champion similarity, action)."""
    new = (bool(row.complete), int(row.checks), int(row.failed), float(row.worst), float(row.total), float(row.similarity))
    n, champion, stale = (1, new, 0) if state is None else (state[0] + 1, state[1:7], state[7])
    order = compare(new, champion)
    if order > 0:
        champion, stale, decision = new, 0, "new-champion"
    elif order < 0:
        stale, decision = stale + (not row.final), "regressed-rollback-required"
    else:
        stale += n > 1 and not new[0] and not row.final
        decision = "initial-champion" if n == 1 else "unchanged"
    if new[0]:
        action = "complete"
    elif order < 0:
        action = "rollback-to-champion"
    else:
        action = "stop-and-return-champion" if stale >= PATIENCE else "repair-only-returned-hints"
    return (n, *champion, int(stale)), (decision, int(stale), champion[5], action)


def _fold(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[tuple | None, pd.DataFrame]:
    out = []
    for row in rows.sort_values("seq").itertuples():
        state, said = step(state, row)
        out.append((*key, row.seq, *said))
    return state, pd.DataFrame(out, columns=["reference", "url", "seq", "decision", "stale", "champion", "action"])


def fold_reviews(reviews: DataFrame) -> DataFrame:
    """The decision on each review (columns INPUT) in order of seq: one pass over sorted partitions, of which a batch and one key's champion are held."""
    ship(reviews.sparkSession)
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = (None if pd.isna(row.reference) else row.reference, None if pd.isna(row.url) else row.url)
                if own != key:
                    key, state = own, None
                state, said = step(state, row)
                out.append((*own, row.seq, *said))
            yield pd.DataFrame(out, columns=names)

    n = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told by number: few bytes, but each row is a step
    ordered = reviews.select(INPUT).repartition(n, "reference", "url").sortWithinPartitions("reference", "url", "seq")
    return ordered.mapInPandas(run, OUTPUT)


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """The same over a stream: the champion of each key is kept as state."""
    ship(reviews.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        held, out = _fold(key, rows, tuple(state.get) if state.exists else None)
        state.update(held)
        yield out

    return reviews.select(INPUT).groupBy("reference", "url").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
