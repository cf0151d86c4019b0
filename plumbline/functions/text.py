"""Text expressions: blanks, packed ``field=value`` pairs, test ids and change texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.names import col

WHITESPACE = " \t\n\r\f\v"

# Cell texts that a delimited read treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

PAIRS = "array<struct<field:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def key_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text form of a key: null becomes ``''``; NaN and infinities too when the input is fractional."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        c = F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit("")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_empty(df: DataFrame, cols: Sequence[str] | None = None,
                   tokens: Sequence[str] = ()) -> DataFrame:
    """Normalise the named columns to non-null text; cells equal to one of ``tokens`` become ``''``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        if cols is not None and name not in cols:
            out.append(col(name))
            continue
        text = key_text(col(name), types[name])
        if tokens:
            text = F.when(text.isin(*tokens), F.lit("")).otherwise(text)
        out.append(text.alias(name))
    return df.select(*out)


def parse_pairs(c: Column, keep_bare: bool = False) -> Column:
    """Split ``k=v|k=v`` at ``|`` and at the first ``=`` into an array of (field, value).

    The default form is the one amendments are read with: field and value are trimmed, quotes around
    the value are removed and parts without ``=`` are ignored. ``keep_bare`` is the display form: only
    the part is trimmed, empty parts are dropped and a part without ``=`` is a field with value ``''``.
    """
    parts = F.split(F.coalesce(c, F.lit("")), r"\|")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        field = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)
        value = F.when(at > 0, F.substr(p, at + 1)).otherwise(F.lit(""))
        if not keep_bare:
            field, value = strip(field), strip(strip(value), "\"'")
        return F.struct(field.alias("field"), value.alias("value"))

    if keep_bare:
        kept = F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")
    else:
        kept = F.filter(parts, lambda p: p.contains("="))
    return F.transform(kept, pair)


def pair_fields(c: Column) -> Column:
    """Field names of the parts that hold ``=`` in a packed text."""
    return F.transform(
        F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: p.contains("=")),
        lambda p: F.substring_index(p, "=", 1),
    )


def render_pairs(pairs: Column) -> Column:
    """Pack an array of (field, value) as ``k=v|k=v``; a null value is rendered empty."""
    return F.array_join(
        F.transform(pairs, lambda x: F.concat(x["field"], F.lit("="), F.coalesce(x["value"], F.lit("")))),
        "|",
    )


def render_response(label: Column, pairs: Column, text: Column) -> Column:
    """Result text of a response: packed pairs, else the label, else plain text, else ``''``."""
    packed = F.when(F.size(pairs) > 0, render_pairs(pairs))
    return F.coalesce(packed, label, text, F.lit(""))


def pairs_text(values: Mapping[str, Column]) -> Column:
    """``a=1|b=`` over named value columns, empty values included; ``''`` for no columns."""
    if not values:
        return F.lit("")
    return F.concat_ws("|", *[
        F.concat(F.lit(name + "="), F.coalesce(v, F.lit(""))) for name, v in values.items()
    ])


def pack_cols(names: Sequence[str]) -> str:
    return "|".join(names)


def combo_text(acted: Column, consulted: Column) -> Column:
    """One display text per combination: acted-upon parts, then consulted ones, duplicates dropped."""
    def parts(c: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: strip(p)), lambda p: p != "")

    joined = F.array_join(F.array_distinct(F.concat(parts(acted), parts(consulted))), " · ")
    return F.when(joined == "", F.lit("N/A")).otherwise(joined)


def test_kind(test_id: Column) -> Column:
    """Last non-empty ``_`` token of an id, upper case; ``''`` for none."""
    tokens = F.filter(F.split(F.upper(F.coalesce(test_id, F.lit(""))), "_"), lambda t: t != "")
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def parse_ie(c: Column) -> Column:
    """Comma list of information elements, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: strip(p)), lambda p: p != "")


def case_change(old: Column, new: Column) -> Column:
    """Kind of a case-only change, null when the two texts differ in more than case (or not at all)."""
    only_case = (old != "") & (new != "") & (F.lower(old) == F.lower(new)) & (old != new)
    return (
        F.when(only_case & (old == F.upper(old)) & (new == F.lower(new)), F.lit("lowercase change"))
        .when(only_case & (old == F.lower(old)) & (new == F.upper(new)), F.lit("uppercase change"))
        .when(only_case, F.lit("case change"))
    )


def change_text(result: Column, acted: Column) -> Column:
    """``field amended from a → b`` per pair, joined by ``; ``; a field without an original shows
    ``field → b`` and a part that is no pair is shown as it is."""
    originals = parse_pairs(acted, keep_bare=True)
    parts = F.filter(F.transform(F.split(F.coalesce(result, F.lit("")), r"\|"), lambda p: strip(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        at = F.instr(p, "=")
        field, value = F.substring_index(p, "=", 1), F.substr(p, at + 1)
        before = F.try_element_at(F.filter(originals, lambda o: o["field"] == field), F.lit(1))
        return (
            F.when(at == 0, p)
            .when(before.isNotNull(), F.concat(field, F.lit(" amended from "), before["value"], F.lit(" → "), value))
            .otherwise(F.concat(field, F.lit(" → "), value))
        )

    return F.array_join(F.transform(parts, one), "; ")
