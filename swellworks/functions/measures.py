"""Units, directions, positions and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellworks.functions.text import let, matched

FEET = 3.28084
US = "US"
UNITS = ("US", "Metric")
#: Position in a location line, fixed patterns: as the forecast reads it, and as the map does (space after the parenthesis).
POSITION = r"\(([-+]?\d+(?:\.\d+)?)\s*([NS])\s+([-+]?\d+(?:\.\d+)?)\s*([EW])\)"
LENIENT_POSITION = r"\(\s*([-+]?\d+(?:\.\d+)?)\s*([NS])\s+([-+]?\d+(?:\.\d+)?)\s*([EW])\)"


def reversed_direction(degrees: Column) -> Column:
    """Where waves go to from where they come from, 0..359."""
    return F.pmod(degrees + 180, F.lit(360))


def feet(metres: Column) -> Column:
    """S12, unrounded."""
    return metres * F.lit(FEET)


def shown_height(feet_value: Column, unit: Column) -> Column:
    """The stored feet, or metres derived from them; any unit but US is metric."""
    return F.when(unit == US, feet_value).otherwise(feet_value / F.lit(FEET))


def unit_label(unit: Column) -> Column:
    return F.when(unit == US, F.lit("(ft)")).otherwise(F.lit("(m)"))


def signed(value: Column, hemisphere: Column) -> Column:
    """North and east are positive, any other letter negative."""
    return F.when(hemisphere.isin("N", "E"), value).otherwise(-value)


def position(location: Column, pattern: str = POSITION) -> Column:
    """struct<lat,lon> of a location line, or null."""
    lat, lon = matched(location, pattern, 1).try_cast("double"), matched(location, pattern, 3).try_cast("double")
    both = F.struct(signed(lat, matched(location, pattern, 2)).alias("lat"), signed(lon, matched(location, pattern, 4)).alias("lon"))
    return F.when(lat.isNotNull() & lon.isNotNull(), both)


def run_timestamp(date: Column, hour: Column) -> Column:
    """yyyyMMdd and HH as a UTC timestamp, or null (hour 24 too)."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), hour), F.lit("yyyyMMdd HH"))


def hours_later(start: Column, hours: Column) -> Column:
    """Start plus fractional hours; null beyond the years 1..9999."""
    ok = F.abs(hours) < 7e7
    micros = F.when(ok, F.round(hours * 3.6e9)).cast("bigint")
    total = F.unix_micros(start.cast("timestamp")) + micros
    return let(total, lambda x: F.when(x.between(-62135596800000000, 253402300799999999), F.timestamp_micros(x)))


def date_label(local: Column) -> Column:
    """Thursday, January 30, 2025."""
    return F.date_format(local, "EEEE, MMMM d, yyyy")


def time_label(local: Column) -> Column:
    """8:00 AM."""
    return F.date_format(local, "h:mm a")


def model_run_label(local: Column) -> Column:
    """The hour keeps its leading zero."""
    return F.concat(F.lit("Model Run: "), F.date_format(local, "EEEE, MMMM d, yyyy hh:mm a"))


def time_band(local: Column) -> Column:
    """Day from 6:00 to 19:00, night from 20:00 to 5:00, both with their ends; null between."""
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute.between(360, 1140), "day").when((minute >= 1200) | (minute <= 300), "night")


def url_parameter(value: Column) -> Column:
    """Percent-encoded text; a blank is %20."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
