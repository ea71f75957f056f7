"""Stores of sessions and queues of jobs: who stays, who starts, what a request is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States that no request changes, and states that wait for a place.
FINISHED = ("complete", "failed", "cancelled")
WAITING = ("queued", "awaiting_consent")
# Ranges, defaults and choices of a capture's options.
RANGES = {"width": (320, 3840, 1440), "height": (240, 2160, 900), "dpr": (0.5, 3.0, 1.0), "timeout_ms": (1_000, 60_000, 30_000), "settle_ms": (0, 5_000, 250), "scroll_steps": (0, 10, 0)}
CHOICES = {"theme": ("light", "dark", "no-preference"), "wait_until": ("networkidle", "commit", "domcontentloaded", "load"), "network_policy": ("explicit", "public", "candidate")}
_SALTS = 64


def first_of_each(df: DataFrame, group: str, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group by order, with rank; a group's rows are ranked in parts first, so that none is sorted in one task."""
    from pyspark.sql import Window

    def cut(rows: DataFrame, by: list) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)

    parted = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(_SALTS)))
    return cut(cut(parted, [group, "__part"]).drop("__part"), [group])


def live_sessions(sessions: DataFrame, store: str, key: str, now: Column, ttl_seconds: int = 7_200, most: int = 8) -> DataFrame:
    """The sessions (last_active) that a store keeps as one more comes in: those not past the TTL, of these the newest, one place left free."""
    age = now.cast("timestamp").cast("double") - F.col("last_active").cast("timestamp").cast("double")
    return first_of_each(sessions.where(age <= ttl_seconds), store, key, [F.col("last_active").desc(), F.col(key)], most - 1)


def started(jobs: DataFrame, queue: str, key: str, most: int = 2) -> DataFrame:
    """The waiting jobs (status, created_at) of each queue that start now: the oldest, as many as running ones leave places: queue, key, rank."""
    running = jobs.groupBy(queue).agg(F.count_if(F.col("status") == "running").alias("running"))
    waiting = first_of_each(jobs.where(F.col("status").isin(*WAITING)), queue, key, [F.col("created_at"), F.col(key)], most)
    return waiting.join(running, queue).where(F.col("rank") <= most - F.col("running")).select(queue, key, "rank")


def after_request(status: Column, request: Column, consent: Column) -> Column:
    """State, answer and error of a job after a status or cancel request; a null state is an unknown job."""
    cancels = (request == "cancel") & ~status.isin(*FINISHED)
    agreed = (request == "status") & consent & (status == "awaiting_consent")
    state = F.when(cancels, "cancelled").when(agreed, "queued").otherwise(status)
    answer = F.when(status.isNull(), None).when(request == "cancel", F.when(cancels, "cancelled").otherwise("complete")).otherwise(state)
    return F.struct(state.alias("state"), answer.alias("answer"), F.when(status.isNull(), "job_not_found").when(cancels, "cancelled by client").alias("error"))


def review_requests(requests: DataFrame, sessions: DataFrame, key: str, ttl_seconds: int = 7_200) -> DataFrame:
    """The candidate address of each review request (asked_at, candidate_url): its own, else that of its session (last_active, known_url); an error without a live session or an address."""
    j = requests.join(sessions.select(key, "last_active", "known_url"), key, "left")
    age = F.col("asked_at").cast("timestamp").cast("double") - F.col("last_active").cast("timestamp").cast("double")
    live = F.coalesce(age <= ttl_seconds, F.lit(False))
    url = F.when(live, F.coalesce(F.when(F.trim("candidate_url") != "", F.col("candidate_url")), F.col("known_url")))
    return j.select(*requests.columns, url.alias("url"), F.when(~live, "web_session_not_found").when(url.isNull(), "invalid_input").alias("error"))


def capture_options(given: dict[str, Column]) -> tuple[Column, Column]:
    """A capture's options (RANGES, CHOICES; null or not given: the default) as a struct, and the name of the first that is out of range or no choice, or null."""

    def value(name: str, default) -> Column:
        return F.coalesce(given[name], F.lit(default)) if name in given else F.lit(default)

    numbers = {k: value(k, default) for k, (_, _, default) in RANGES.items()}
    words = {k: F.when(value(k, some[0]) == "", some[0]).otherwise(value(k, some[0])) for k, some in CHOICES.items()}
    bad = {k: ~numbers[k].between(low, high) for k, (low, high, _) in RANGES.items()} | {k: ~words[k].isin(*some) for k, some in CHOICES.items()}
    order = ("width", "height", "dpr", "theme", "wait_until", "timeout_ms", "settle_ms", "scroll_steps", "network_policy")
    refusal = F.coalesce(*(F.when(bad[k], F.lit(k)) for k in order))
    return F.struct(*(c.alias(k) for k, c in (numbers | words).items())), refusal
