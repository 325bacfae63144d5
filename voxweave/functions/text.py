"""Column functions over text and time. Times in columns named *_ms are integer milliseconds, others are seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks a label that no interval and no earlier segment gives.
UNKNOWN = "UNKNOWN"


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def stripped(text: Column) -> Column:
    """White space of any script taken from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(word_list(text)), F.lit(0)).cast("long")


def name_key(name: Column) -> Column:
    """Letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def srt_time(s: Column) -> Column:
    """HH:MM:SS,mmm; parts of a millisecond are cut off."""
    ms = (s * 1000).cast("long")
    part = lambda unit, of: F.floor(ms / unit) % of if of else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def clock(s: Column) -> Column:
    """H:MM:SS."""
    whole = s.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def minute_clock(s: Column) -> Column:
    """M:SS."""
    whole = s.cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def confidence(log_probability: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(log_probability))), 4)


def joined(parts: Column, by: str) -> Column:
    """parts: an array of (order, text); their texts in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), by)
