"""Date expressions: ISO dates and intervals, and free-form dates that can be standardised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip

_DAY = r"^\d{4}-\d{2}-\d{2}(T[0-9:.]+(Z|[+-]\d{2}:?\d{2})?)?$"
_MONTH = r"^\d{4}-\d{2}$"
_YEAR = r"^\d{4}$"
_ORDINAL = r"^\d{4}-\d{3}$"

# Written-out date layouts that name exactly one day.
DATE_LAYOUTS = [
    "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy",
    "d-MMM-yyyy", "d-MMMM-yyyy", "yyyy MMM d", "yyyy MMMM d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
]
_NUMERIC = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$"


def _start(c: Column) -> Column:
    year_start = F.concat(F.substring(c, 1, 4), F.lit("-01-01")).try_cast("date")
    ordinal = F.date_add(year_start, F.substring(c, 6, 3).try_cast("int") - 1)
    return (
        F.when(c.rlike(_DAY), F.substring(c, 1, 10).try_cast("date"))
        .when(c.rlike(_MONTH) | c.rlike(_YEAR), c.try_cast("date"))
        .when(c.rlike(_ORDINAL) & (F.substring(c, 6, 3) >= "001") & (F.year(ordinal).cast("string") == F.substring(c, 1, 4)), ordinal)
    )


def _end(c: Column) -> Column:
    return (
        F.when(c.rlike(_YEAR), F.concat(c, F.lit("-12-31")).try_cast("date"))
        .when(c.rlike(_MONTH), F.last_day(c.try_cast("date")))
        .otherwise(_start(c))
    )


def iso_interval(c: Column) -> Column:
    """Struct (start, end) of an ISO date or interval, null when the text is neither.

    Years, months, days, day-of-year dates, times of day and ``a/b`` intervals are read; in an interval
    the second part may leave out the leading parts it shares with the first (``2020-01-05/08``).
    """
    def complete(parts: Column) -> Column:
        left, right = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        shortened = right.rlike(r"^\d{2}(-\d{2})?$") & (F.length(left) > F.length(right) + 4)
        prefix = F.substr(left, F.lit(1), F.length(left) - F.length(right))
        return F.when(shortened, F.array(left, F.concat(prefix, right))).otherwise(parts)

    parts = let(F.split(strip(c), "/"), complete)
    ends = F.transform(parts, lambda p: F.struct(_start(p).alias("start"), _end(p).alias("end")))

    def joined(e: Column) -> Column:
        first, last = F.get(e, F.lit(0))["start"], F.try_element_at(e, F.lit(-1))["end"]
        return F.when((F.size(e) <= 2) & (first <= last), F.struct(first.alias("start"), last.alias("end")))

    return let(ends, joined)


def duration_days(interval: Column) -> Column:
    return F.datediff(interval["end"], interval["start"]) + 1


def has_leap_day(interval: Column) -> Column:
    """True when 29 February lies inside the interval."""
    def leap_day(year: Column) -> Column:
        return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-02-29")).try_cast("date")

    years = F.sequence(F.year(interval["start"]), F.least(F.year(interval["end"]), F.year(interval["start"]) + 8))
    return F.exists(years, lambda y: F.coalesce(leap_day(y).between(interval["start"], interval["end"]), F.lit(False)))


def numeric_date_parts(c: Column) -> Column:
    """Struct (a, b, y) of an ``a/b/y`` date, null when the text is none; y is null for a two-digit year,
    whose century the text does not tell."""
    def parts(text: Column) -> Column:
        def n(i: int) -> Column:
            return F.regexp_extract(text, _NUMERIC, i).try_cast("int")
        year = F.when(F.length(F.regexp_extract(text, _NUMERIC, 3)) == 4, n(3))
        return F.when(text.rlike(_NUMERIC), F.struct(n(1).alias("a"), n(2).alias("b"), year.alias("y")))

    return let(strip(c), parts)


def ambiguous_date(c: Column) -> Column:
    """True when day and month can be swapped to give another valid date, or the century is open."""
    def swappable(d: Column) -> Column:
        return d.isNotNull() & (d["y"].isNull() | (d["a"].between(1, 12) & d["b"].between(1, 12) & (d["a"] != d["b"])))

    return F.coalesce(let(numeric_date_parts(c), swappable), F.lit(False))


def standard_date(c: Column, day_first: bool | None = None) -> Column:
    """ISO text of a date written in a known non-ISO layout, null when none fits or it is ambiguous.

    ``day_first`` settles ambiguous ``a/b/y`` dates; left as None they stay null.
    """
    def named(text: Column) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS]).cast("date")

    def numeric(d: Column) -> Column:
        a, b = d["a"], d["b"]
        month_first = F.when(b > 12, True).when(a > 12, False).when(a == b, True)
        if day_first is not None:
            month_first = F.coalesce(month_first, F.lit(not day_first))
        text = F.when(month_first, F.format_string("%04d-%02d-%02d", d["y"], a, b)).when(
            ~month_first, F.format_string("%04d-%02d-%02d", d["y"], b, a))
        return text.try_cast("date")

    return F.date_format(F.coalesce(let(strip(c), named), let(numeric_date_parts(c), numeric)), "yyyy-MM-dd")
