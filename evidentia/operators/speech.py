"""Recognised speech and requests to its engines: segments, texts, input checks and provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations on dictation and models, the models that may be named, and what an operation without claims rests on.
STATE_OPERATIONS = ("dictation_status", "dictation_start", "dictation_settings", "dictation_stop", "model_status", "model_install")
MODELS = ("qwen", "gigaam", "whisper", "remote")
DEFAULT_METHODS = {
    "model_status": ("observed", "local_model_state"), "model_install": ("observed", "local_model_state"), "dictation_status": ("observed", "broker_owned_dictation_state"), "dictation_start": ("observed", "broker_owned_dictation_state"),
    "dictation_settings": ("observed", "broker_owned_dictation_state"), "dictation_stop": ("observed", "broker_owned_dictation_state"), "fetch": ("observed", "public_media_fetch"),
}
_SPACE = r"(?U)^\s+|\s+$"


def clean_segments(segments: Column) -> Column:
    """Segments (text, start, end as anything that casts) with a text and both bounds, trimmed, bounds to hundredths; null stays null, no segment an empty array."""
    made = F.transform(segments, lambda s: F.struct(F.round(s["start"].try_cast("double"), 2).alias("start"), F.round(s["end"].try_cast("double"), 2).alias("end"), F.regexp_replace(F.coalesce(s["text"], F.lit("")), _SPACE, "").alias("text")))
    return F.filter(made, lambda s: (s["text"] != "") & s["start"].isNotNull() & s["end"].isNotNull())


def joined_text(segments: Column, text: Column) -> Column:
    """The segments' texts, each trimmed, with spaces between; the text itself where there are no segments to join."""
    parts = F.array_join(F.transform(segments, lambda s: F.regexp_replace(F.coalesce(s["text"], F.lit("")), _SPACE, "")), " ")
    return F.coalesce(F.regexp_replace(parts, _SPACE, ""), text)


def input_refusal(operation: Column, fields: Column, model: Column, url: Column, audio_path: Column, known_files: Column) -> Column:
    """Why an input can't be served (invalid_input, invalid_model, file_not_found), or null. fields: the input's names, null where it is no object."""
    web = F.coalesce(F.regexp_replace(url, _SPACE, "").rlike("^https?://"), F.lit(False))
    return (
        F.when(operation.isin("model_status", "model_install"), F.when(fields.isNull(), "invalid_input").when(model.isNotNull() & ~model.isin(*MODELS), "invalid_model"))
        .when(operation.isin(*STATE_OPERATIONS), None)
        .when(fields.isNull(), "invalid_input")
        .when(operation == "fetch", F.when(~web, "invalid_input"))
        .when(audio_path.isNull(), "invalid_input")
        .when(~F.array_contains(known_files, audio_path), "file_not_found")
    )


def provenance(operation: Column, claims: Column) -> Column:
    """Kind, method and confidence of each claim (kind, method, confidence) that names a method, observed first, then measured and inferred; else what the operation rests on."""
    default = F.create_map(*(x for k, (kind, method) in DEFAULT_METHODS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(method).alias("method"), F.lit(None).cast("double").alias("confidence")))))
    other = F.struct(F.lit("inferred").alias("kind"), F.lit("automatic_speech_recognition").alias("method"), F.lit(None).cast("double").alias("confidence"))
    found = F.flatten(F.transform(F.array(*map(F.lit, ("observed", "measured", "inferred"))), lambda k: F.filter(claims, lambda c: (c["kind"] == k) & c["method"].isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(default[operation], other)))
