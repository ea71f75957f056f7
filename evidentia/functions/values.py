"""Money, time, digests and compact tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars for a million tokens read and written.
PRICE_IN, PRICE_OUT = 0.08, 0.252


def micro_usd(dollars: Column) -> Column:
    """Millionths of a dollar, half away from zero, at least 0."""
    return F.greatest(F.round(dollars * 1_000_000), F.lit(0)).cast("long")


def usd(dollars: Column) -> Column:
    return F.format_string("$%.4f", dollars)


def pessimistic_cost(steps: Column, context: Column, output: Column) -> Column:
    """Every step reads the whole context, and the output is written in full."""
    return steps * context * PRICE_IN / 1e6 + output * PRICE_OUT / 1e6


def rfc3339(ts: Column) -> Column:
    """UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def civil(days: Column) -> Column:
    """Year, month and day of a number of days since 1970."""
    d = F.date_from_unix_date(days.cast("int"))
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))


def cache_key(version: str, content: Column, region: Column) -> Column:
    """Version, 32 digits of the content's SHA-256, and the region where there is one."""
    return F.concat_ws("-", F.lit(version), F.substring(F.sha2(content, 256), 1, 32), region)


def request_id(url: Column, options: Column) -> Column:
    """20 digits of the SHA-256 of the URL, a zero byte and the options."""
    return F.substring(F.sha2(F.concat(url.cast("binary"), F.unhex(F.lit("00")), options.cast("binary")), 256), 1, 20)


def receipt(kind: str, job: Column, url: Column, content: Column, at: Column, snippet: int = 2000) -> Column:
    """An evidence receipt; its id is derived from the job, the address and the digest, so that retries issue it again."""
    digest = F.sha2(content, 256)
    return F.struct(
        F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", job.cast("string"), url, digest), 256), 1, 16)).alias("evidence_id"),
        F.lit(kind).alias("kind"),
        url.alias("url"),
        digest.alias("sha256"),
        rfc3339(at).alias("observed_at"),
        F.substring(content, 1, snippet).alias("snippet"),
    )
