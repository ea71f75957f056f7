"""Choices that a document's rows decide: design tokens, profile, target kind, required inputs, roles by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import color
from evidentia.functions.text import casefold, letters_and_digits

# Words of an intent that ask for a web page.
WEB_MARKERS = ("website", "web page", "frontend", "html", "css", "сайт", "веб", "лендинг", "страниц", "сверст")
# The fields that each operation cannot do without.
REQUIRED = {"locate": ("imagePath", "query"), "zoom": ("imagePath",), "ask": ("imagePath", "question"), "element": ("imagePath", "somId"), "compare": ("referencePath", "candidatePath"), "review": ("referencePath", "url"), "capture": ("url",)}
# Labels of common controls and their roles.
LABEL_ROLES = {
    "confirmpendingpayouts": "action", "respondtopartners": "action", "reviewnewapplications": "action", "partnernetwork": "nav", "frauddetection": "nav", "emailcampaigns": "nav", "applicationpage": "link", "partnerportal": "link", "landingpage": "link", "allpartners": "nav", "applications": "nav",
    "commissions": "nav", "last30days": "utility", "overview": "nav", "payouts": "nav", "messages": "nav", "analytics": "nav", "bounties": "nav", "resources": "nav", "branding": "utility", "groups": "nav", "viewall": "utility",
}


def _has_any(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def target_kind(explicit: Column, intent: Column) -> Column:
    """web or visual: as told, or web where the intent has a marker; an error for any other word."""
    told = casefold(F.trim(explicit))
    bad = F.raise_error(F.concat(F.lit("no target kind: "), told)).cast("string")
    guess = F.when(_has_any(casefold(F.coalesce(intent, F.lit(""))), WEB_MARKERS), "web").otherwise("visual")
    return F.when(explicit.isNull(), guess).when(told.isin("web", "visual"), told).otherwise(bad)


def missing_fields(operation: Column, fields: Column) -> Column:
    """The required fields of an operation that an input's field names lack, in order; none for other operations."""
    need = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.filter(F.coalesce(need[operation], F.array().cast("array<string>")), lambda n: ~F.array_contains(fields, n))


def label_role(text: Column) -> Column:
    """The role of the first label that a text is, begins with, or ends with after at most four characters; null without one."""
    t = letters_and_digits(text)
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in LABEL_ROLES.items()))
    fits = F.filter(entries, lambda e: (t.startswith(e["k"])) | (t.endswith(e["k"]) & (F.length(t) - F.length(e["k"]) <= 4)))
    return F.get(fits, F.lit(0))["v"]


def design_tokens(colors: DataFrame, group: str, background: str = "#FFFFFF") -> DataFrame:
    """Ink (most contrast with the background), accent (most saturated beyond 0.35, else the ink) of each group; the least colour on ties. colors: group, hex."""
    c = colors.where(F.col("hex") != background)
    ink = F.max(F.struct(F.round(color.contrast(F.col("hex"), F.lit(background)), 9).alias("s"), (-F.conv(F.substring("hex", 2, 6), 16, 10).cast("long")).alias("k"), "hex"))
    saturated = F.when(color.saturation(F.col("hex")) > 0.35, F.struct(F.round(color.saturation(F.col("hex")), 9).alias("s"), (-F.conv(F.substring("hex", 2, 6), 16, 10).cast("long")).alias("k"), "hex"))
    return c.groupBy(group).agg(ink["hex"].alias("ink"), F.coalesce(F.max(saturated)["hex"], ink["hex"]).alias("accent"))
