"""Recording clocks. A civil clock stays without a zone unless one was stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribelake.functions.text import basename

# Clock formats.
ISO_CLOCK = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
NAME_CLOCK = r"^audio_([0-9]{6})_([0-9]{6})(?:_[^.]+)?\.[A-Za-z0-9]+$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn`` of a value computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def civil(day: Column, clock: Column) -> Column:
    """TIMESTAMP_NTZ of 'yyyy-MM-dd' and 'HH:mm:ss', null off the calendar."""
    return F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")


def iso_parts(text: Column | str) -> Column:
    """Struct(day, clock, fraction, offset, at) of an ISO clock, null when malformed."""
    x = _col(text)
    day, clock, rest = F.substring(x, 1, 10), F.substring(x, 12, 8), F.substr(x, F.lit(20))
    offset = F.regexp_extract(rest, r"(Z|[+-][0-9]{2}:[0-9]{2})?$", 1)
    at = civil(day, clock)
    # Offsets stay below 24 hours.
    good_offset = offset.isin("", "Z") | offset.rlike(r"^[+-]([01][0-9]|2[0-3]):[0-5][0-9]$")
    shown = F.when(offset == "Z", "+00:00").when(offset != "", offset)
    parts = F.struct(
        day.alias("day"), clock.alias("clock"), F.regexp_extract(rest, r"^(\.[0-9]+)?", 1).alias("fraction"),
        shown.alias("offset"), at.alias("at"),
    )
    return F.when(x.rlike(ISO_CLOCK) & good_offset & at.isNotNull(), parts)


def offset_seconds(offset: Column) -> Column:
    """Signed seconds of '+hh:mm', null when unknown."""
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    return sign * (F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 5, 2).cast("int") * 60)


def instant(text: Column | str) -> Column:
    """Seconds since 1970 of a clock with an offset; null when zoneless or malformed."""

    def seconds(parts):
        fraction = F.coalesce(parts["fraction"].try_cast("double"), F.lit(0.0))
        return civil_seconds(parts).cast("double") + fraction - offset_seconds(parts["offset"])

    return bind(iso_parts(text), seconds)


def civil_seconds(parts: Column) -> Column:
    """Seconds of a parsed clock on a day count from 1970, free of any zone."""
    days = F.datediff(parts["day"].try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    hms = [F.split(parts["clock"], ":")[i].try_cast("bigint") for i in range(3)]
    return days * 86400 + hms[0] * 3600 + hms[1] * 60 + hms[2]


def recording_time(filename: Column | str, explicit: Column | str | None = None) -> Column:
    """Struct of date, time, recorded_at, timezone, provenance, confirmed.

    A bad explicit clock is reported as invalid and never replaced by the name.
    """
    name = basename(_col(filename))
    pairs = lambda at, sep: F.concat(
        F.substring(name, at, 2), F.lit(sep), F.substring(name, at + 2, 2), F.lit(sep), F.substring(name, at + 4, 2)
    )
    day, clock = F.concat(F.lit("20"), pairs(7, "-")), pairs(14, ":")
    named = name.rlike(NAME_CLOCK) & civil(day, clock).isNotNull()
    none = F.lit(None).cast("string")

    def build(d, t, at, zone, provenance, confirmed):
        return F.struct(
            d.alias("date"), t.alias("time"), at.alias("recorded_at"), zone.alias("timezone"),
            F.lit(provenance).alias("provenance"), F.lit(confirmed).alias("confirmed"),
        )

    from_name = F.when(
        named, build(day, clock, F.concat(day, F.lit("T"), clock), none, "filename", False)
    ).otherwise(build(none, none, none, none, "unknown", False))
    if explicit is None:
        return from_name

    def declared(parts):
        zero = parts["fraction"].rlike(r"^(\.0+)?$")
        micros = F.when(zero, "").otherwise(F.rpad(F.substring(parts["fraction"], 1, 7), 7, "0"))
        zone = F.when(parts["offset"] == "+00:00", "UTC").otherwise(F.concat(F.lit("UTC"), parts["offset"]))
        shown = F.concat(parts["day"], F.lit("T"), parts["clock"], micros, F.coalesce(parts["offset"], F.lit("")))
        return F.when(
            parts.isNotNull(), build(parts["day"], parts["clock"], shown, zone, "explicit_metadata", True)
        ).otherwise(build(none, none, none, none, "invalid_explicit_metadata", False))

    given = _col(explicit)
    return F.when(given.isNull(), from_name).otherwise(bind(iso_parts(given), declared))


def real_date(c: Column | str) -> Column:
    """YYYY-MM-DD that exists on the calendar."""
    x = _col(c)
    return x.isNotNull() & x.rlike(DAY) & x.try_cast("date").isNotNull()


def recording_interval(
    explicit: Column | str, embedded: Column | str, duration: Column | str
) -> Column:
    """Start, end, source and zone status; explicit metadata first, then embedded."""
    given, bwf, seconds = _col(explicit), _col(embedded), _col(duration)

    def stamp(t):
        text = F.replace(t.cast("string"), F.lit(" "), F.lit("T"))
        return F.when(F.instr(text, ".") > 0, F.rpad(text, 26, "0")).otherwise(text)

    def described(pair):
        declared = pair["declared"].isNotNull()
        parts = F.coalesce(pair["declared"], pair["embedded"])
        source = F.when(declared, "explicit_source_metadata").when(parts.isNotNull(), "embedded_bwf_origination").otherwise("unknown")
        fraction = F.coalesce(parts["fraction"].try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
        after = lambda t, s: F.try_add(t, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s))
        begin = after(parts["at"], fraction)
        finite = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(float("inf")))
        end = F.when(finite, after(begin, F.bround(seconds, 6).try_cast("decimal(18,6)")))
        tail = F.coalesce(parts["offset"], F.lit(""))
        return F.struct(
            F.concat(stamp(begin), tail).alias("started_at"), F.concat(stamp(end), tail).alias("ended_at"),
            source.alias("time_source"),
            F.when(declared, "user_supplied").when(parts.isNotNull(), "embedded_metadata").otherwise("unknown").alias("time_confidence"),
            F.replace(parts["offset"], F.lit(":"), F.lit("")).alias("timezone"),
            F.when(parts["offset"].isNotNull(), "explicit_offset").otherwise("unknown").alias("timezone_status"),
            F.when(end.isNotNull(), "declared start plus decoded duration").alias("end_time_basis"),
            (given.isNotNull() & ~declared).alias("invalid_explicit_recorded_at"),
        )

    clocks = F.struct(iso_parts(given).alias("declared"), iso_parts(bwf).alias("embedded"))
    return bind(clocks, described)
