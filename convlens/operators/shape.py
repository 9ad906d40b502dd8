"""From one wide row of aggregates to a long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lengthen(row: DataFrame, records: Sequence[Mapping[str, object]]) -> DataFrame:
    """One output row per record and input row; plain values become literals.

    Keep the entries plain column references and compute with them afterwards, on the long
    table: an expression in a record is compiled once per record.
    """
    structs = [
        F.struct(
            *[
                (v if isinstance(v, Column) else F.lit(v)).alias(name)
                for name, v in record.items()
            ]
        )
        for record in records
    ]
    return row.select(F.inline(F.array(*structs)))
