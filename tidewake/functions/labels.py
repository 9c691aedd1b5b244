"""Code maps, lenient casts, text clean-up and display formats, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.sources.registry import FAILURE_UNKNOWN, FAILURE_UNREACHABLE, FAILURES, NAV_STATUS, SHIP_TYPES


def ship_type_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(SHIP_TYPES):
        out = F.when(code.between(lo, hi), label).otherwise(out)
    return out


def nav_status_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, label in enumerate(NAV_STATUS):
        out = F.when(code == k, label).otherwise(out)
    return out


def failure_reason(error: Column) -> Column:
    """A publishable reason: null without an error, the generic phrase for unknown ones."""
    low = F.lower(error)
    out = F.lit(FAILURE_UNKNOWN)
    for tokens, reason in reversed(FAILURES):
        hit = low.contains(tokens[0])
        for t in tokens[1:]:
            hit = hit | low.contains(t)
        out = F.when(hit, reason).otherwise(out)
    return F.when(error.isNotNull() & (error != ""), out)


def is_unreachable(error: Column) -> Column:
    return F.coalesce(failure_reason(error).isin(*FAILURE_UNREACHABLE), F.lit(False))


def confidence_bucket(conf: Column, high: float = 0.6, medium: float = 0.25) -> Column:
    return F.when(conf >= high, "high").when(conf >= medium, "medium").otherwise("low")


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def optional_double(c: Column) -> Column:
    return c.try_cast("double")


def optional_int(c: Column) -> Column:
    """Whole part of a number in text, null where it can't be read."""
    return c.try_cast("double").cast("int")


def csv_double(c: Column) -> Column:
    """NaN for what can't be read."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan")))


def csv_bool(c: Column) -> Column:
    """True, false or null (anything else)."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def utc_micros(c: Column) -> Column:
    """Microseconds of ``YYYY-MM-DD[ T]HH:MM:SS[.fraction]`` at the start of a text.

    The fraction is cut to microseconds and whatever follows, an offset included, is
    ignored: times are UTC.
    """
    shape = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(?:\.(\d+))?"
    day, clock, part = (F.regexp_extract(c, shape, i) for i in (1, 2, 3))
    whole = F.try_to_timestamp(F.concat(F.nullif(day, F.lit("")), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.unix_micros(whole) + F.rpad(F.substring(part, 1, 6), 6, "0").cast("long")


def redact(c: Column, secrets: list[str], most: int = 500) -> Column:
    """Secrets replaced, the longest first, and the text cut."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        c = F.replace(c, F.lit(s), F.lit("[redacted]"))
    return F.substring(c, 1, most)


def flag_emoji(iso2: Column) -> Column:
    """Two regional-indicator letters, built from their UTF-8 bytes."""
    letter = lambda i: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(F.upper(iso2), i, 1)) + F.lit(0xA6 - 65)))), "UTF-8")
    return F.when(F.length(iso2) == 2, F.concat(letter(1), letter(2)))


def gap_text(ms: Column) -> Column:
    """Hours and minutes of a gap: ``1H5M``, or ``45M`` below an hour."""
    minutes = F.floor(ms / 60000 + F.lit(0.5)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return F.when(hours > 0, F.format_string("%dH%dM", hours, minutes % 60)).otherwise(F.format_string("%dM", minutes))


def ago(past_us: Column, now_us: Column) -> Column:
    """How long ago, coarser as it recedes."""
    minutes = F.floor((now_us - past_us) / 60_000_000).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    older = F.when(hours < 24, F.format_string("%dh ago", hours)).otherwise(F.format_string("%dd ago", F.floor(hours / 24).cast("long")))
    return F.when(minutes < 1, "just now").when(minutes < 60, F.format_string("%dm ago", minutes)).otherwise(older)


def age(fix_us: Column, reference_us: Column, live: bool) -> Column:
    """A fix's age against now, or on which side of a pass it lies."""
    apart = reference_us - fix_us
    minutes = F.floor(F.abs(apart) / 60_000_000).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    text = F.when(minutes < 1, "under a minute").when(hours == 0, F.format_string("%d min", minutes)).otherwise(F.format_string("%dh %dm", hours, minutes % 60))
    if live:
        return F.concat(F.lit("reported "), text, F.lit(" ago"))
    return F.concat(text, F.when(apart >= 0, " before this pass").otherwise(" after this pass"))


def stamp(at_us: Column, seconds: bool = False) -> Column:
    """``04 AUG 14:22Z`` in UTC."""
    return F.upper(F.date_format(F.timestamp_micros(at_us), "dd MMM HH:mm:ss'Z'" if seconds else "dd MMM HH:mm'Z'"))


def contact_state(on_land: Column, mode: Column, match_state: Column) -> Column:
    return F.when(on_land, "masked").when((mode == "survey") | match_state.isNull(), "contact").otherwise(match_state)


def contact_id(mode: Column, det_id: Column) -> Column:
    return F.concat(F.when(mode == "survey", "SC-").otherwise("DR-"), det_id.cast("string"))


def contact_mmsi(matched: Column, candidate: Column) -> Column:
    return F.coalesce(matched, candidate)


def contact_rank(state: Column) -> Column:
    """Place in the contact list."""
    return F.array_position(F.array(*map(F.lit, ("dark", "indeterminate", "matched", "contact", "masked"))), state)


def feed_pill(state: Column) -> Column:
    return F.when(state == "stale", "warn").when(state == "connected", "ok").otherwise("bad")


def imagery_pill(state: Column, loaded: Column) -> Column:
    return F.when(~loaded, "bad").when(state == "error", "bad").when(state == "degraded", "warn").otherwise("ok")
