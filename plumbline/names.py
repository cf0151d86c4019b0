"""Column-name helpers and the fixed names of the result table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORE_PREFIX = "dwc:"

# The base columns of a result table, in output order.
RESULT_COLUMNS = [
    "test_id", "test_type", "status", "result", "comment",
    "actedUpon", "consulted", "actedUpon_cols", "consulted_cols", "count",
]

# Status vocabulary.
HAS_RESULT = "RUN_HAS_RESULT"
AMENDED = "AMENDED"
NOT_AMENDED = "NOT_AMENDED"
FILLED_IN = "FILLED_IN"
AMBIGUOUS = "AMBIGUOUS"
INTERNAL_UNMET = "INTERNAL_PREREQUISITES_NOT_MET"
EXTERNAL_UNMET = "EXTERNAL_PREREQUISITES_NOT_MET"

# Result vocabulary.
COMPLIANT = "COMPLIANT"
NOT_COMPLIANT = "NOT_COMPLIANT"
POTENTIAL_ISSUE = "POTENTIAL_ISSUE"
NOT_ISSUE = "NOT_ISSUE"

ACTIONABLE = [AMENDED, FILLED_IN]
ATTENTION = [NOT_COMPLIANT, POTENTIAL_ISSUE]


def quoted(name: str) -> str:
    """Back-tick a column name, so that names with ``:`` or ``.`` resolve."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))
