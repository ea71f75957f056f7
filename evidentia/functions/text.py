"""Text normalisation and parsing as JVM-side Column expressions.

All take a string Column and propagate null unless said otherwise. Case folding
covers the alphabets of the evidence tables: lower case, with the sharp s as ss.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters and the Latin letters they look like.
HOMOGLYPHS = ("авсеікмнортху", "abceikmhoptxy")
# The wider list used when whole pictures' texts are compared.
HOMOGLYPHS_WIDE = ("авсенкмортхуіјѕӏ", "abcehkmoptxyijsl")
# Currency signs that may lead an amount.
SIGILS = "$€£¥₽₩₹₿"
# Marks typical of drawings made of characters.
ASCII_ART = "/\\|_-+=*#@%<>()[]{}:;.,'"
# Phrases that recognisers emit on silence.
SILENCE_PHRASES = (
    "thank you for watching", "thanks for watching", "please subscribe", "don't forget to subscribe", "do not forget to subscribe", "bye bye", "bye.", "thank you.",
    "thanks for watching.", "you", "you.", "subscribe", "music", "music.", "[music]", "[applause]", "[laughter]", "so", "so.", "amara", "amara.org",
    "i'm going to show you how to", "let's get started",
)
# Punctuation that a transcript doesn't begin with.
LEADING_MARKS = r"\-–—.•,;:!?"
# Named font weights.
FONT_WEIGHTS = {"normal": 400, "regular": 400, "medium": 500, "semibold": 600, "semi-bold": 600, "bold": 700, "light": 300}
_WORD = r"[\p{L}\p{N}_.-]+"
_SPACE = r"(?U)\s+"


def casefold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "ß", "ss")


def collapse(c: Column) -> Column:
    """White space at the ends removed, runs of it as one space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), _SPACE, " ")


def word_tokens(c: Column) -> Column:
    """Runs of letters, digits, underscores, dots and hyphens, in order."""
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


def reading_text(c: Column) -> Column:
    """The case-folded word tokens, one space apart."""
    return F.array_join(word_tokens(casefold(c)), " ")


def visible_text(c: Column) -> Column:
    """Collapsed and case-folded; null counts as empty."""
    return casefold(collapse(F.coalesce(c, F.lit(""))))


def letters_and_digits(c: Column) -> Column:
    """Case-folded, only letters and digits kept; null counts as empty."""
    return F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def latin_look(c: Column) -> Column:
    """Letters and digits with Cyrillic look-alikes as Latin."""
    return F.translate(letters_and_digits(c), *HOMOGLYPHS)


def picture_text(c: Column) -> Column:
    """Word tokens of a picture's whole text, look-alikes as Latin."""
    return F.array_join(word_tokens(F.translate(casefold(c), *HOMOGLYPHS_WIDE)), " ")


def symbol_text(c: Column) -> Column:
    """Line feeds only, none at the ends, no white space at line ends; null counts as empty."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "^\n+|\n+$", ""), r"(?U)[^\S\n]+(?=\n|$)", "")


def intent_tokens(c: Column) -> Column:
    """Distinct lower-case word tokens of more than two characters; null has none."""
    return F.array_distinct(F.filter(word_tokens(F.lower(F.coalesce(c, F.lit("")))), lambda t: F.length(t) > 2))


def letter_offsets(c: Column) -> Column:
    """Struct of the letters and digits (folded character by character) and each one's position in the source."""
    chars = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x, i: F.struct(casefold(x).alias("c"), i.alias("i")))
    kept = F.filter(chars, lambda x: x["c"].rlike(r"^[\p{L}\p{N}]+$"))
    return F.struct(F.array_join(F.transform(kept, lambda x: x["c"]), "").alias("text"), F.transform(kept, lambda x: x["i"]).alias("offsets"))


def sigil_correction(left: Column, right: Column) -> Column:
    """Of two readings that differ in the first character only, the one that leads with a currency sign where the other has s or 5; else null."""

    def holds(sign: Column, other: Column) -> Column:
        same = casefold(F.substring(sign, 2, 1 << 30)) == casefold(F.substring(other, 2, 1 << 30))
        return (F.length(sign) >= 3) & (F.length(sign) == F.length(other)) & F.instr(F.lit(SIGILS), F.substring(sign, 1, 1)).cast("boolean") & F.lower(F.substring(other, 1, 1)).isin("s", "5") & same

    return F.when(holds(left, right), left).when(holds(right, left), right)


def mostly_ascii(c: Column) -> Column:
    """Whether three quarters of the letters and digits are ASCII; false without any."""
    n = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    plain = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    return (n > 0) & (plain >= n * 0.75)


def looks_drawn(texts: Column) -> Column:
    """Whether an array of readings is a drawing of characters: two or more, four visible characters, 35 % of them marks."""
    visible = F.regexp_replace(F.array_join(texts, ""), _SPACE, "")
    marks = F.length(F.regexp_replace(visible, r"[^/\\|_\-+=*#@%<>()\[\]{}:;.,']", ""))
    return (F.size(texts) >= 2) & (F.length(visible) >= 4) & (marks >= F.length(visible) * 0.35)


def glyph_count_matches(font_size: Column, measured: Column, value: Column) -> Column:
    """Large readings (48 px) of four or more measured glyphs must show at least 72 % of them."""
    visible = F.length(F.regexp_replace(F.coalesce(value, F.lit("")), _SPACE, ""))
    return (F.coalesce(font_size, F.lit(0)) < 48) | (F.coalesce(measured, F.lit(0)) < 4) | (visible >= F.ceil(measured * 0.72))


def keeps_numeric_format(current: Column, status: Column, candidate: Column) -> Column:
    """Whether a candidate keeps a leading currency sign, and protected statuses' values unchanged."""
    now, new = (F.trim(F.coalesce(x, F.lit(""))) for x in (current, candidate))
    sign = F.substring(now, 1, 1).isin("$", "€", "£", "¥") & (F.substring(new, 1, 1) != F.substring(now, 1, 1))
    frozen = F.coalesce(status, F.lit("")).isin("layout-sequence-inferred", "deterministic-badge-template-confirmed") & (new != now)
    return ~sign & ~frozen


def css_pixels(c: Column) -> Column:
    """12px as 12.0; null for anything else."""
    return F.regexp_extract(F.lower(F.trim(c)), r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*px$", 1).try_cast("double")


def css_hex(c: Column) -> Column:
    """#rgb, #rrggbb, rgb() and opaque rgba() as #RRGGBB; null otherwise."""
    t = F.trim(c)
    rgb = r"(?i)^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})(?:\s*,\s*(0(?:\.\d+)?|1(?:\.0+)?))?\s*\)$"
    r, g, b = (F.regexp_extract(t, rgb, k).try_cast("int") for k in (1, 2, 3))
    alpha = F.coalesce(F.regexp_extract(t, rgb, 4).try_cast("double"), F.lit(1.0))
    return (
        F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(t))
        .when(t.rlike("^#[0-9A-Fa-f]{3}$"), F.upper(F.regexp_replace(t, "([0-9A-Fa-f])", "$1$1")))
        .when(F.greatest(r, g, b).between(0, 255) & (alpha >= 0.999), F.format_string("#%02X%02X%02X", r, g, b))
    )


def font_weight(c: Column, fallback: int = 400) -> Column:
    """A named weight, or the first of 100 to 900 in the text, or the fallback."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.create_map(*(F.lit(x) for item in FONT_WEIGHTS.items() for x in item))
    return F.coalesce(named[t], F.regexp_extract(t, r"\b([1-9]00)\b", 1).try_cast("int"), F.lit(fallback))


def font_family(c: Column) -> Column:
    """The first family of a list without quotes; empty beyond 128 characters or with control characters."""
    first = F.regexp_replace(F.trim(F.split(F.coalesce(c, F.lit("")), ",", 2)[0]), "^['\"]+|['\"]+$", "")
    return F.when((F.length(first) > 128) | first.rlike(r"[\x00-\x1f]"), F.lit("")).otherwise(first)


def _silence_pattern() -> str:
    """One or more of the phrases in a row, each a whole word or bracketed, where a text or sentence begins."""
    quoted = "|".join(re.escape(p) for p in sorted(SILENCE_PHRASES, key=len, reverse=True))
    return rf"(?iuU)(?<![^.!?])(?:\s*(?:{quoted})(?!\w)[.,!?]?)+"


def strip_silence_phrases(c: Column) -> Column:
    """Remove the silence phrases with which a text or sentence begins; words that only begin like one stay."""
    return collapse(F.regexp_replace(c, _silence_pattern(), ""))


def capitalize_first(c: Column) -> Column:
    """The first letter in upper case, all else as it is."""
    head, first = F.regexp_extract(c, r"(?s)^(\P{L}*)", 1), F.regexp_extract(c, r"(?s)^\P{L}*(\p{L})", 1)
    return F.concat(head, F.upper(first), F.substring(c, F.length(head) + F.length(first) + 1, F.length(c)))


def clean_transcript(c: Column) -> Column:
    """One line without silence phrases and leading punctuation, its first letter in upper case; null as empty."""
    spoken = strip_silence_phrases(collapse(F.coalesce(c, F.lit(""))))
    return capitalize_first(F.regexp_replace(spoken, rf"(?U)^[\s{LEADING_MARKS}]+", ""))


def seam_word(c: Column) -> Column:
    """A word without the punctuation around it, case-folded."""
    return casefold(F.regexp_replace(c, r"^[.,!?;:…\"'()\[\]«»—\-]+|[.,!?;:…\"'()\[\]«»—\-]+$", ""))


def axis_amount(c: Column) -> Column:
    """An amount whose currency sign was read as s or 5: digits stay, o is 0, s is 8; null for other text, or for zeros only."""
    t = letters_and_digits(c)
    body = F.translate(F.substring(t, 2, 1 << 30), "oоs", "008")
    ok = (F.length(t) >= 2) & F.substring(t, 1, 1).isin("s", "5") & body.rlike("^[0-9]+$")
    informative = F.substring(t, 2, 1 << 30).rlike("[0-9s]") | (F.length(t) == 2)
    return F.when(ok & informative, body.try_cast("long"))


def path_component(c: Column) -> Column:
    """A name safe as part of a path: 80 characters, all but ASCII letters, digits, _ and - as _; empty as session."""
    t = F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, 80), "[^A-Za-z0-9_-]", "_")
    return F.when(t == "", F.lit("session")).otherwise(t)


def single_line(c: Column) -> Column:
    """Without line feeds and backslashes, collapsed."""
    return collapse(F.regexp_replace(c, r"[\n\r\\]+", " "))


def video_id(c: Column) -> Column:
    """The eleven-character id in a watch or short link; null where neither form occurs."""
    found = (F.regexp_extract(c, p, 1) for p in (r"(?:v=|/shorts/|/embed/)([0-9A-Za-z_-]{11})", r"youtu\.be/([0-9A-Za-z_-]{11})"))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def css_urls(c: Column) -> Column:
    """Distinct addresses of url(...) values in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"url\(\s*[\"']?([^\"')]+?)[\"']?\s*\)"), F.lit(1)))


def spacing_is_plausible(c: Column) -> Column:
    """False where a text ends in a lone lower-case letter, or begins with a lone letter before a word of three or more; a and i may stand alone."""
    parts = F.split(collapse(F.coalesce(c, F.lit(""))), " ")
    first, last = parts[0], F.element_at(parts, -1)
    ending = last.rlike(r"^\p{Ll}$") & ~last.isin("a", "i")
    leading = first.rlike(r"^\p{L}$") & ~F.lower(first).isin("a", "i") & (F.length(F.get(parts, F.lit(1))) >= 3)
    return (F.size(parts) < 2) | ~(ending | leading)
