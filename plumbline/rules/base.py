"""Responses and the generic rule family; the domain rules are instances of these."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.coords import number
from plumbline.functions.text import blank, let, pairs_text, strip
from plumbline.rules.registry import Inputs

RuleFn = Callable[[Inputs], Column]
CHANGES = "map<string,string>"


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def response(status: Column | str, result: Column | str = "", comment: Column | str = "",
             changes: Column | None = None) -> Column:
    """The response struct (status, result, comment, changes)."""
    return F.struct(
        _text(status).alias("status"), _text(result).alias("result"), _text(comment).alias("comment"),
        (F.lit(None).cast(CHANGES) if changes is None else changes.cast(CHANGES)).alias("changes"),
    )


def unmet(comment: Column | str, external: bool = False) -> Column:
    return response(N.EXTERNAL_UNMET if external else N.INTERNAL_UNMET, "", comment)


def verdict(ok: Column, yes: Column | str, no: Column | str) -> Column:
    """COMPLIANT where ``ok``, else NOT_COMPLIANT (an unknown outcome counts as not compliant)."""
    held = F.coalesce(ok, F.lit(False))
    return response(N.HAS_RESULT, F.when(held, F.lit(N.COMPLIANT)).otherwise(F.lit(N.NOT_COMPLIANT)),
                    F.when(held, _text(yes)).otherwise(_text(no)))


def issue(found: Column, yes: Column | str, no: Column | str) -> Column:
    held = F.coalesce(found, F.lit(False))
    return response(N.HAS_RESULT, F.when(held, F.lit(N.POTENTIAL_ISSUE)).otherwise(F.lit(N.NOT_ISSUE)),
                    F.when(held, _text(yes)).otherwise(_text(no)))


def changed(changes: Mapping[str, Column], comment: Column | str, status: str = N.AMENDED) -> Column:
    """A proposed change of one or more fields, both packed as text and typed as a map."""
    entries = [x for k, v in changes.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]
    return response(status, pairs_text(changes), comment, F.create_map(*entries))


def unchanged(comment: Column | str) -> Column:
    return response(N.NOT_AMENDED, "", comment)


def any_blank(v: Inputs, *names: str) -> Column:
    out = blank(v[names[0]])
    for n in names[1:]:
        out = out | blank(v[n])
    return out


def not_empty(name: str) -> RuleFn:
    return lambda v: verdict(~blank(v[name]), f"{name} contains a value.", f"{name} is empty.")


def in_range(name: str, low: float, high: float) -> RuleFn:
    """Number within closed bounds; blank or non-numeric input cannot be tested."""
    def fn(v: Inputs) -> Column:
        return let(number(v[name]), lambda n: F.when(n.isNull(), unmet(f"{name} is empty or not a number.")).otherwise(
            verdict(n.between(low, high), f"{name} is between {low:g} and {high:g} inclusive.",
                    f"{name} is outside the range {low:g} to {high:g}.")))
    return fn


def in_vocabulary(name: str, terms: Sequence[str]) -> RuleFn:
    """Exact member of a short fixed list. Long lists come from a joined table instead."""
    return lambda v: F.when(blank(v[name]), unmet(f"{name} is empty.")).otherwise(
        verdict(v[name].isin(*terms), f"{name} is a listed term.",
                F.concat(F.lit(f"{name} ["), v[name], F.lit("] is not a listed term."))))


def matches(name: str, pattern: str, what: str) -> RuleFn:
    return lambda v: F.when(blank(v[name]), unmet(f"{name} is empty.")).otherwise(
        verdict(v[name].rlike(pattern), f"{name} is {what}.", f"{name} is not {what}."))


def less_than(low: str, high: str) -> RuleFn:
    """``low`` ≤ ``high`` as numbers."""
    def fn(v: Inputs) -> Column:
        a, b = number(v[low]), number(v[high])
        return F.when(a.isNull() | b.isNull(), unmet(f"{low} or {high} is empty or not a number.")).otherwise(
            verdict(a <= b, f"{low} is not greater than {high}.", f"{low} is greater than {high}."))
    return fn


def consistent(first: str, second: str, expected: Callable[[Inputs], Column]) -> RuleFn:
    """``second`` equals the value derived from ``first``; no derived value means inconsistent."""
    return lambda v: F.when(any_blank(v, first, second), unmet(f"{first} or {second} is empty.")).otherwise(
        verdict(expected(v) == v[second], f"{first} and {second} agree.", f"{first} and {second} do not agree."))


def standardize(name: str, standard: Callable[[Inputs], Column], valid: Callable[[Inputs], Column]) -> RuleFn:
    """Replace a value by its standard form where one is known."""
    def fn(v: Inputs) -> Column:
        def outcome(target: Column) -> Column:
            return (
                F.when(blank(v[name]), unmet(f"{name} is empty."))
                .when(F.coalesce(valid(v), F.lit(False)), unchanged(f"{name} already has a standard value."))
                .when(target.isNotNull() & (target != v[name]), changed({name: target}, f"{name} standardised."))
                .otherwise(unchanged(F.concat(F.lit(f"No standard value known for {name} ["), v[name], F.lit("]."))))
            )
        return let(standard(v), outcome)
    return fn


def fill_from(targets: Mapping[str, Callable[[Inputs], Column]], sources: Sequence[str]) -> RuleFn:
    """Fill empty target fields from other fields; any target already present leaves the row alone."""
    def fn(v: Inputs) -> Column:
        present = F.lit(False)
        for name in targets:
            present = present | ~blank(v[name])

        def outcome(values: Column) -> Column:
            derived = {name: values[f"v{i}"] for i, name in enumerate(targets)}
            known = F.lit(True)
            for value in derived.values():
                known = known & value.isNotNull()
            return (
                F.when(present, unmet("Not altering existing values of " + ", ".join(targets) + "."))
                .when(any_blank(v, *sources), unmet(", ".join(sources) + " is empty."))
                .when(known, changed(derived, "Filled in from " + ", ".join(sources) + ".", N.FILLED_IN))
                .otherwise(unchanged("No value can be derived from " + ", ".join(sources) + "."))
            )

        return let(F.struct(*[f(v).alias(f"v{i}") for i, f in enumerate(targets.values())]), outcome)
    return fn


def folded_terms(terms: Sequence[str]) -> dict[str, str]:
    """Folded spelling → term, for vocabularies matched without case, spaces, ``_`` and ``-``."""
    return {"".join(ch for ch in t.lower() if ch.isalnum()): t for t in terms}


def fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"[\s_\-]+", ""))


def lookup_literal(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a short fixed map for the key ``c``, null when absent."""
    out = F.lit(None).cast("string")
    by_value: dict[str, list[str]] = {}
    for k, val in table.items():
        by_value.setdefault(val, []).append(k)
    for val, keys in by_value.items():
        out = F.when(c.isin(*keys), F.lit(val)).otherwise(out)
    return out
