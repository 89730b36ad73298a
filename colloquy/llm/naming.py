"""Names of helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apart(df: DataFrame, *names: str) -> list[str]:
    """``names`` behind as many underscores as it takes for no column of ``df`` to have any of them, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]
