"""Help for plans that Catalyst would otherwise make worse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(c: Column) -> Column:
    """``c``, in a projection through which no filter is pushed.

    A filter on a computed column (also one inferred from an explode) is moved below its projection by
    inlining the expression, which then runs once more for each use. The partition id makes the
    projection nondeterministic to Catalyst, so the filter stays above and reads the column. ``c`` is the
    first argument of a coalesce, which is always evaluated, so its equal parts are still computed once;
    inside a branch of a condition they would not be.
    """
    return F.coalesce(c, F.when(F.spark_partition_id() < 0, F.lit(None)))
