"""Looking at a table: first rows, search, sort and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREVIEW_ROWS = 1000


def table(df: DataFrame, sort: list[str] | None = None, descending: bool = False, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, by any columns if given."""
    if sort:
        df = df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in sort])
    return df.limit(limit)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, whatever its case."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.lower(F.to_json(c) if nested else c.cast("string"))

    needle = text.lower()
    hit = F.lit(False)
    for f in df.schema.fields:
        hit = hit | F.coalesce(cell(f).contains(needle), F.lit(False))
    return df.filter(hit)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """One page in a total order.

    An offset has to pass over all rows before it. For deep pages give ``after``, the order
    values of the last row seen: they become a filter, and the cost no longer grows with depth.
    """
    if after is not None:
        behind = F.lit(False)
        for i in range(len(order)):
            tie = F.lit(True)
            for c, v in zip(order[:i], after[:i]):
                tie = tie & F.col(c).eqNullSafe(F.lit(v))
            # NULLs come first in the order.
            later = F.col(order[i]).isNotNull() if after[i] is None else F.col(order[i]) > F.lit(after[i])
            behind = behind | (tie & F.coalesce(later, F.lit(False)))
        df = df.filter(behind)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
