"""Coordinate expressions: decimal text, degree-minute-second text, grid keys, lengths with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip

_DMS = (r"^\s*(\d{1,3})\s*[°ºd]\s*(?:(\d{1,2})\s*['′’]\s*)?"
        r"(?:(\d{1,2}(?:\.\d+)?)\s*(?:[\"″”]|''|′′)\s*)?([NSEWnsew])\s*$")
_LENGTH = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\.?\s*$"

# Metres per unit of length.
METRES_PER_UNIT = {
    "": 1.0, "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0,
    "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "fathom": 1.8288, "fathoms": 1.8288,
    "km": 1000.0, "cm": 0.01,
}


def number(c: Column) -> Column:
    """The text as a finite double, else null."""
    d = strip(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def dms_to_decimal(c: Column, places: int = 3) -> Column:
    """Decimal degrees of ``40°26'46"N``, rounded; null when the text has another form."""
    fits = c.rlike(_DMS)
    deg = F.regexp_extract(c, _DMS, 1).try_cast("double")
    minutes = F.coalesce(F.regexp_extract(c, _DMS, 2).try_cast("double"), F.lit(0.0))
    seconds = F.coalesce(F.regexp_extract(c, _DMS, 3).try_cast("double"), F.lit(0.0))
    sign = F.when(F.upper(F.regexp_extract(c, _DMS, 4)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(fits & (minutes < 60) & (seconds < 60), F.round(sign * (deg + minutes / 60 + seconds / 3600), places))


def grid_key(lat: Column, lon: Column, size: float = 0.1) -> Column:
    """Key of the grid cell a point falls into: the cell's lower corner with three decimals."""
    g = F.lit(float(size))
    key = F.format_string("%.3f:%.3f", F.floor(lat / g) * g, F.floor(lon / g) * g)
    return F.when(lat.isNotNull() & lon.isNotNull(), key)


def metres(c: Column) -> Column:
    """Length in metres of ``10 feet`` and the like, null for an unknown unit or other text."""
    unit = F.lower(F.regexp_extract(c, _LENGTH, 2))
    factor = F.lit(None).cast("double")
    for name, value in METRES_PER_UNIT.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.when(c.rlike(_LENGTH), F.round(F.regexp_extract(c, _LENGTH, 1).try_cast("double") * factor, 4))


def plain_number(c: Column) -> Column:
    """Text of a double without exponent or trailing zeros (``3.048``, ``12``)."""
    text = F.format_string("%.7f", c)  # gives the text "null" for a null
    return F.when(c.isNotNull(), F.regexp_replace(text, r"\.?0+$", ""))
