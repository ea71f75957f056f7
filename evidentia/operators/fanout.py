"""Jobs that one request makes: parallel jobs, opinions from several perspectives, verifications, and which paths a job may touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.evidence import glob_regex, static_prefix

# The perspectives that a role takes where none are named.
PERSPECTIVES = {
    "researcher": ("evidence-first / authoritative sources", "alternative implementations / market approaches", "skeptical / contradictions and missing evidence"),
    "critic": ("correctness / counterexample", "reliability / failure modes", "complexity / maintainability / hidden assumptions"),
    "reviewer": ("correctness + regressions", "edge cases + failure handling", "maintainability + integration impact"),
}
OTHER_ROLES = ("independent read of the same objective",)


def default_perspectives(role: Column) -> Column:
    known = F.create_map(*(x for k, v in PERSPECTIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(known[role], F.array(*map(F.lit, OTHER_ROLES)))


def parallel(requests: DataFrame, key: str, jobs: str, most: int = 4) -> DataFrame:
    """One row for each job of a request of 1 to most jobs, counted from 1, with the request's count; other requests give one row without a job, and an error."""
    n = F.coalesce(F.size(F.col(jobs)), F.lit(0))
    fits = n.between(1, most)
    rows = requests.select(key, n.alias("count"), F.when(fits, F.lit(None).cast("string")).otherwise("invalid_parallel").alias("error"), F.posexplode_outer(F.when(fits, F.col(jobs))).alias("at", "job"))
    return rows.select(key, "count", "error", (F.col("at") + 1).alias("job_seq"), "job")


def opinions(requests: DataFrame, key: str, *, role: str, objective: str, named: str, count: str, most: int = 4) -> DataFrame:
    """One job for each perspective: the named ones, else the role's own, as many as asked for (three by default, 1 to most)."""
    wanted = F.least(F.greatest(F.coalesce(F.col(count), F.lit(3)), F.lit(1)), F.lit(most))
    told = F.when(F.size(F.col(named)) > 0, F.col(named)).otherwise(F.slice(default_perspectives(F.col(role)), 1, wanted))
    rows = requests.select(key, objective, F.posexplode(told).alias("at", "perspective"))
    return rows.select(key, (F.col("at") + 1).alias("job_seq"), "perspective", F.concat(F.col(objective), F.lit("\n\nPerspective: "), F.col("perspective")).alias("objective"))


def verification(criteria: Column, candidate: Column) -> Column:
    """The objective of a job that checks a candidate against criteria."""
    return F.concat(F.lit("Critically verify the following candidate.\nCriteria: "), F.array_join(criteria, "; "), F.lit("\n\nCANDIDATE:\n"), candidate)


def scope_allows(path: Column, base: str, scope: list[str]) -> Column:
    """Whether a resolved path lies in a scope: entries without wildcards name a folder or file, others are globs, from base where they are relative; web names no path."""
    allowed = F.lit(False)
    for entry in scope:
        if entry == "web":
            continue
        whole = entry if entry.startswith("/") else f"{base}/{entry}"
        prefix = static_prefix(whole)
        here = (path == prefix) | F.startswith(path, F.lit(prefix.rstrip("/") + "/"))
        if "*" in entry or "?" in entry:
            here = here & path.rlike(glob_regex(whole))
        allowed = allowed | here
    return F.coalesce(allowed, F.lit(False))


def unexpired(entries: DataFrame, now: Column, ttl_seconds: int, stamp: str = "ts") -> DataFrame:
    """The cache entries that a sweep leaves."""
    return entries.where(now.cast("timestamp").cast("double") - F.col(stamp).cast("timestamp").cast("double") <= ttl_seconds)
