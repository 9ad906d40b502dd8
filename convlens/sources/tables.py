"""Readers, the load contract, publishing and sinks."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import quoted

log = logging.getLogger(__name__)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read Parquet, or CSV with a header. CSV without a schema costs a pass for inference."""
    if os.path.splitext(path.rstrip("/"))[1].lower() in (".csv", ".tsv"):
        reader = spark.read.option("header", True)
        if path.lower().endswith(".tsv"):
            reader = reader.option("sep", "\t")
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return reader.csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def check_contract(
    t: DataFrame,
    columns: Sequence[str] | T.StructType,
    expected_rows: int | None = None,
) -> DataFrame:
    """Fail on missing, extra or mistyped columns and on an empty table.

    An unusual row count is only reported. Returns the table unchanged.
    """
    if isinstance(columns, T.StructType):
        want = {f.name: f.dataType for f in columns.fields}
    else:
        want = dict.fromkeys(columns)
    have = {f.name: f.dataType for f in t.schema.fields}
    if len(t.columns) != len(want):
        raise ValueError(f"expected {len(want)} columns, found {len(t.columns)}")
    missing = [c for c in want if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wrong = [c for c, kind in want.items() if kind is not None and have[c] != kind]
    if wrong:
        raise ValueError(f"columns of another type: {wrong}")
    if t.isEmpty():
        raise ValueError("table is empty")
    if expected_rows is not None:
        rows = t.count()
        if rows != expected_rows:
            log.warning("table has %d rows instead of %d", rows, expected_rows)
    return t


def rename_columns(t: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns, dotted names included; names the table lacks are ignored."""
    return t.withColumnsRenamed({old: new for old, new in names.items() if old in t.columns})


def drop_columns(t: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns that are present."""
    keep = [c for c in t.columns if c not in set(names)]
    return t.select(*[quoted(c) for c in keep])


def conform(
    t: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Project to the schema: renamed, in its column order and types.

    A NULL in a column the schema calls NOT NULL stops the run when the row is reached,
    so no separate counting pass is needed.
    """
    t = rename_columns(t, renames or {})
    out = []
    for field in schema.fields:
        c = quoted(field.name).cast(field.dataType)
        if not field.nullable:
            c = F.when(c.isNotNull(), c).otherwise(
                F.raise_error(F.lit(f"NULL in column {field.name}"))
            )
        out.append(c.alias(field.name))
    return t.select(*out)


def publish(
    t: DataFrame,
    name: str,
    schema: T.StructType,
    renames: Mapping[str, str] | None = None,
    save: bool = False,
) -> DataFrame:
    """Conform a table and make it known by name, as a view or as a saved table.

    NULLs in required columns are counted first, in one pass: a later query that does not read such a
    column would never reach the check in the row.
    """
    source = rename_columns(t, renames or {})
    required = [f for f in schema.fields if not f.nullable]
    if required:
        missing = [
            F.count_if(quoted(f.name).cast(f.dataType).isNull()).alias(f"n{i}")
            for i, f in enumerate(required)
        ]
        found = [(f.name, n) for f, n in zip(required, source.agg(*missing).first()) if n]
        if found:
            raise ValueError("NULL in " + ", ".join(f"column {c} ({n} rows)" for c, n in found))
    typed = conform(t, schema, renames)
    if save:
        typed.write.mode("overwrite").saveAsTable(name)
        return t.sparkSession.table(name)
    typed.createOrReplaceTempView(name)
    return typed


def write_table(t: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write Parquet, CSV with a header, or JSON lines; one file per partition."""
    writer = t.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def load_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read a result written earlier with ``write_table``."""
    return spark.read.parquet(os.path.join(folder, name))


def numeric_columns(t: DataFrame) -> list[str]:
    return [f.name for f in t.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(t: DataFrame) -> list[str]:
    return [f.name for f in t.schema.fields if not isinstance(f.dataType, T.NumericType)]
