"""User rules written as a plain function over values, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.rules.base import response
from plumbline.rules.registry import Inputs
from plumbline.session import ship_package

_ANSWER = "status string, result string, comment string"


def pandas_rule(fn: Callable[..., tuple[str, str, str]], columns: Sequence[str]) -> Callable[[Inputs], Column]:
    """A rule from ``fn(*values) -> (status, result, comment)``.

    An exception marks only the combination it came from, with its message as the comment. The function
    runs once per distinct combination, since that is what rules are evaluated on. ``changes`` stays null;
    amendments made this way are read back from the packed result text.
    """
    def one(values: tuple) -> tuple[str, str, str]:
        try:
            answer = fn(*values)
            if not isinstance(answer, tuple) or len(answer) != 3 or not all(a is None or isinstance(a, str) for a in answer) or not answer[0]:
                raise TypeError(f"a rule must return (status, result, comment), not {answer!r}")
            return answer
        except Exception as error:  # isolated per item by contract
            return N.INTERNAL_UNMET, "", f"{type(error).__name__}: {error}"

    @F.pandas_udf(_ANSWER)
    def run(values: pd.DataFrame) -> pd.DataFrame:
        rows = [one(t) for t in values.itertuples(index=False, name=None)]
        return pd.DataFrame(rows, columns=["status", "result", "comment"], dtype="object")

    def bound(v: Inputs) -> Column:
        ship_package(SparkSession.active())
        answer = run(F.struct(*[v[name].alias(f"v{i}") for i, name in enumerate(columns)]))
        return response(answer["status"], answer["result"], answer["comment"])

    return bound
