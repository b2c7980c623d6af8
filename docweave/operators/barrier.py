"""A fence for the optimizer around costly columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows, with their columns final for whatever comes later.

    A filter on a computed column would otherwise be rewritten into the
    column's expression and moved below it, which evaluates that expression,
    and all it refers to, again for every mention. A filter on a generator's
    output stays above the generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
