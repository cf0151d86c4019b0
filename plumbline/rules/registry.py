"""Rule registry: a rule is a function from bound inputs to a response Column.

``@rule(...)`` registers a test together with the columns it reads, so the catalogue and the run both
come from the same declaration. Binding looks every input up by name: in the columns of a table, in a
map of values, or in the parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import key_text
from plumbline.names import col

CATALOGUE_SCHEMA = (
    "id string, guid string, type string, class_name string, acted_upon array<string>, "
    "consulted array<string>, parameters array<string>, description string, notes string, "
    "ie_class string, ie_acted_upon array<string>, ie_consulted array<string>, usecases array<string>"
)

Source = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A registered test. ``needs`` names the reference answers its function looks at."""

    id: str
    guid: str
    type: str
    acted: tuple[str, ...]
    consulted: tuple[str, ...]
    fn: Callable[[Inputs], Column]
    params: Mapping[str, Any] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    class_name: str = ""
    ie_class: str = ""
    description: str = ""
    notes: str = ""
    usecases: tuple[str, ...] = ()
    param_types: Mapping[str, str] = field(default_factory=dict)  # ``date`` or ``number`` (not negative), of parameters a request may get wrong

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.acted + self.consulted))

    def with_params(self, **params: Any) -> Rule:
        return replace(self, params={**self.params, **params})


class Inputs:
    """What a rule sees: values by column name, parameters, and joined reference answers."""

    def __init__(self, source: Source, params: Mapping[str, Any], param_map: Column | None = None):
        self._source, self._params, self._param_map = source, params, param_map

    def __getitem__(self, name: str) -> Column:
        return self._source(name)

    def answer(self, name: str) -> Column:
        return F.col(answer_column(name))

    def option(self, name: str, default: Any = None) -> Any:
        """Value of a parameter that shapes the expression itself."""
        return self._params.get(name, default)

    def param(self, name: str, default: Any = None) -> Column:
        """A parameter as a Column; a request's own value wins over the default, unless it is blank."""
        value = F.lit(self._params.get(name, default)).cast("string")
        if self._param_map is None:
            return value
        # a request may write the name with a namespace
        spelled = F.try_element_at(F.filter(F.map_entries(self._param_map), lambda e: F.substring_index(e["key"], ":", -1) == name), F.lit(1))
        return F.coalesce(F.nullif(F.btrim(self._param_map[name]), F.lit("")), F.nullif(F.btrim(spelled["value"]), F.lit("")), value)

    def given(self, name: str) -> bool:
        """Whether a parameter can have a value at all."""
        return self._param_map is not None or self._params.get(name) is not None


def answer_column(name: str) -> str:
    return f"__answer_{name}"


def _remembered(read: Source) -> Source:
    """The same Column object for the same name; building one costs a round trip to the JVM per node."""
    seen: dict[str, Column] = {}

    def source(name: str) -> Column:
        if name not in seen:
            seen[name] = read(name)
        return seen[name]

    return source


def columns_source(df: DataFrame) -> Source:
    """Inputs are the columns of ``df``, with blanks as ``''``."""
    fields = {f.name: f for f in df.schema.fields}

    def read(name: str) -> Column:
        f = fields[name]
        clean = isinstance(f.dataType, T.StringType) and not f.nullable
        return col(name) if clean else key_text(col(name), f.dataType)

    return _remembered(read)


def column_source() -> Source:
    """Inputs are columns that are known to hold non-null text."""
    return _remembered(col)


def map_source(values: Column) -> Source:
    """Inputs are the entries of a map column; an absent entry is blank."""
    return _remembered(lambda name: F.coalesce(values[name], F.lit("")))


def bind(r: Rule, source: Source, param_map: Column | None = None) -> Column:
    """The response of ``r`` over inputs found by name in ``source``; a parameter of the wrong type is an error of its own."""
    from plumbline.rules.base import unmet

    inputs = Inputs(source, r.params, param_map)
    out = r.fn(inputs)
    for name, kind in r.param_types.items():
        if inputs.given(name):
            text = inputs.param(name)
            wrong = text.try_cast("date").isNull() if kind == "date" else ~F.coalesce(text.try_cast("double").between(0, 1e300), F.lit(False))
            out = F.when(text.isNotNull() & wrong, unmet(F.concat(F.lit(f"Parameter {name} is no {kind}: "), text))).otherwise(out)
    return out


class Registry:
    """Rules by id; the first declaration of an id stays."""

    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}

    def add(self, r: Rule) -> Rule:
        return self._rules.setdefault(r.id, r)

    def rule(self, id: str, type: str = "Validation", acted: Iterable[str] = (), consulted: Iterable[str] = (),
             guid: str | None = None, **more: Any) -> Callable[[Callable[[Inputs], Column]], Rule]:
        """Decorator form of :meth:`add`; a missing guid is derived from the id."""
        def register(fn: Callable[[Inputs], Column]) -> Rule:
            more.setdefault("description", (fn.__doc__ or "").strip())
            more.setdefault("class_name", fn.__module__)
            return self.add(Rule(id, guid or str(uuid.uuid5(uuid.NAMESPACE_URL, id)), type,
                                 tuple(acted), tuple(consulted), fn, **more))
        return register

    def __getitem__(self, id: str) -> Rule:
        return self._rules[id]

    def __contains__(self, id: str) -> bool:
        return id in self._rules

    def __iter__(self):
        return iter(sorted(self._rules.values(), key=lambda r: r.id))

    def __len__(self) -> int:
        return len(self._rules)

    def select(self, *ids: str) -> list[Rule]:
        return [self._rules[i] for i in ids]

    def build_catalogue(self, spark: SparkSession) -> DataFrame:
        """The catalogue of every registered rule as a DataFrame."""
        return catalogue_of(spark, self)


def catalogue_of(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (r.id, r.guid, r.type, r.class_name, list(r.acted), list(r.consulted), sorted(r.params), r.description,
         r.notes, r.ie_class, list(r.acted), list(r.consulted), list(r.usecases))
        for r in rules
    ]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)
