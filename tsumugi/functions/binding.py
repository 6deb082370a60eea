"""Names for values within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body(*values), each value worked out once a row.

    Functions with lambdas are interpreted and don't share what they have in common, so a value that is used in several
    places, or within a lambda, would be worked out each time. As fields of a lambda's variable they are worked out once.
    """
    bound = F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))
    return F.element_at(F.transform(bound, lambda x: body(*[x[f"v{k}"] for k in range(len(values))])), 1)
