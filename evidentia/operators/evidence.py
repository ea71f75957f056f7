"""Claims, receipts, predicates and reviews as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verify_claims(claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """Check each claim's evidence against the receipts issued to its job.

    claims: job_id, claim_id, claim_status, confidence, evidence (array of ids);
    receipts: job_id, evidence_id. Returns job_id, claim_id, claim_status (a
    verified claim falls to inferred unless all of its evidence, and some, was
    issued), n_evidence, n_verified, errors.
    """
    cited = claims.select("job_id", "claim_id", F.explode("evidence").alias("evidence_id"))
    issued = receipts.select("job_id", "evidence_id").distinct().withColumn("issued", F.lit(True))
    counts = cited.join(issued, ["job_id", "evidence_id"], "left").groupBy("job_id", "claim_id").agg(F.count("*").alias("n_evidence"), F.count("issued").alias("n_verified"))
    joined = claims.join(counts, ["job_id", "claim_id"], "left").na.fill(0, ["n_evidence", "n_verified"])
    sound = (F.col("n_evidence") > 0) & (F.col("n_evidence") == F.col("n_verified"))
    status = F.when((F.col("claim_status") == "verified") & ~sound, "inferred").otherwise(F.col("claim_status"))
    return joined.select("job_id", "claim_id", status.alias("claim_status"), "n_evidence", "n_verified", claim_errors(F.col("claim_status"), F.col("n_evidence"), F.col("n_verified"), F.col("confidence")).alias("errors"))


def claim_errors(status: Column, n_evidence: Column, n_verified: Column, confidence: Column) -> Column:
    """Messages of a claim's contract, none for a sound one."""
    return F.array_compact(
        F.array(
            F.when((status == "verified") & (n_evidence == 0), "verified claim has no evidence refs"),
            F.when((status == "verified") & (n_verified < n_evidence), "verified claim references non-verified evidence"),
            F.when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "confidence must be within [0.0, 1.0]"),
        )
    )


def line_at(content: Column, line: Column) -> Column:
    """A line counted from 1, without its end; null beyond the last."""
    return F.get(F.split(F.regexp_replace(content, r"\r?\n\z", ""), "\r?\n"), F.greatest(line, F.lit(1)) - 1)


def check_predicates(predicates: DataFrame, files: DataFrame, most_bytes: int = 256 * 1024) -> DataFrame:
    """Evaluate predicates (type, path, line, value, pattern, min, max, sha256) against files (path, content): status and detail.

    Only a file_exists predicate can be refuted by a missing file; all others
    can't be verified without it, or beyond most_bytes (hashes have no limit).
    """
    j = predicates.join(files.select("path", "content"), "path", "left")
    there, n = F.col("content").isNotNull(), F.col("n")
    j = j.withColumn("n", F.when(F.col("type") == "pattern_count", F.regexp_count("content", F.coalesce("pattern", F.lit("^\\b$")))))
    line = line_at(F.col("content"), F.col("line"))
    within = F.coalesce(n >= F.col("min"), F.lit(True)) & F.coalesce(n <= F.col("max"), F.lit(True))
    digest = F.sha2("content", 256)
    verdict = F.col("type")
    ok = (
        F.when(verdict == "file_exists", there)
        .when(~there | ((verdict != "hash_matches") & (F.octet_length("content") > most_bytes)), None)
        .when(verdict == "line_contains", F.coalesce(F.contains(line, F.col("value")), F.lit(False)))
        .when(verdict == "pattern_count", within)
        .when(verdict == "quote_contained", F.contains(F.col("content"), F.col("value")))
        .when(verdict == "hash_matches", digest == F.col("sha256"))
    )
    detail = F.when(verdict == "pattern_count", F.concat(F.lit("count="), n.cast("string"))).when((verdict == "hash_matches") & ~ok, F.concat(F.lit("actual "), digest))
    return j.select("pred_id", F.when(ok, "verified").when(~ok, "refuted").otherwise("unverifiable").alias("status"), detail.alias("detail"))


def grep(files: DataFrame, pattern: str, id_col: str, text_col: str, most_chars: int = 400) -> DataFrame:
    """Each matching line: id, line (from 1), text cut to most_chars."""
    lines = files.select(id_col, F.posexplode(F.split(F.regexp_replace(F.col(text_col), r"\r?\n\z", ""), "\r?\n")).alias("pos", "line_text"))
    return lines.where(F.col("line_text").rlike(pattern)).select(id_col, (F.col("pos") + 1).alias("line"), F.substring("line_text", 1, most_chars).alias("text"))


def read_lines(files: DataFrame, first: int, last: int, id_col: str, text_col: str) -> DataFrame:
    """Lines first to last of each text, joined again."""
    lines = F.split(F.regexp_replace(F.col(text_col), r"\r?\n\z", ""), "\r?\n")
    return files.select(id_col, F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("text"))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c), i + 1
    return f"^{out}$"


def static_prefix(pattern: str) -> str:
    """The folders of a glob before its first wildcard."""
    parts = pattern.split("/")
    plain = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    return "/".join(parts[:plain])


def review_quality(checks: DataFrame, key: str = "review_id") -> DataFrame:
    """n_checks, n_failed, and the most and summed violations relative to the threshold; a check that can't be measured violates by 1."""
    op = F.coalesce("operator", F.when(F.col("name").endswith("_minimum"), ">=").otherwise("<="))
    short = F.when(op == ">=", F.col("threshold") - F.col("actual")).otherwise(F.col("actual") - F.col("threshold"))
    violation = F.coalesce(F.greatest(short, F.lit(0.0)) / F.greatest(F.abs("threshold"), F.lit(1e-6)), F.lit(1.0))
    v = F.when(F.col("passed") == F.lit(False), violation)
    return checks.groupBy(key).agg(F.count("*").alias("n_checks"), F.count(v).alias("n_failed"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_violation"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total_violation"))


def first_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, all columns."""
    kept = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *(F.col(c).alias(f"__{c}") for c in kept)))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *(F.col(f"__b.__{c}").alias(c) for c in kept))


def ranked(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group by order, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def dispatch(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Status of each request by the capability table (capability_id, operations, enabled): ok, unknown_capability, disabled or unsupported_operation."""
    j = requests.join(F.broadcast(capabilities), "capability_id", "left")
    status = F.when(F.col("operations").isNull(), "unknown_capability").when(~F.col("enabled"), "disabled").when(~F.array_contains("operations", F.col("operation")), "unsupported_operation").otherwise("ok")
    return j.select("request_id", status.alias("status"))


def budget_gate(jobs: DataFrame, cost: str, day: str, order: str, consent: float = 0.20, daily: float = 5.0) -> DataFrame:
    """State of each job as it is created: awaiting_consent beyond the consent limit, rejected where the day's estimates so far and its own pass the daily limit, else queued."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(day).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return jobs.withColumn("state", F.when(before + F.col(cost) > daily, "rejected").when(F.col(cost) > consent, "awaiting_consent").otherwise("queued"))


def sweep(jobs: DataFrame, now: Column, ttl_seconds: int, most: int) -> DataFrame:
    """Jobs that stay in the store: all live ones; finished ones younger than the TTL, of those the newest, most in all."""
    finished = F.col("status").isin("complete", "failed", "cancelled")
    young = now.cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double") < ttl_seconds
    kept = jobs.where(finished & young).orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(most)
    return jobs.where(~F.coalesce(finished, F.lit(False))).unionByName(kept)
