"""Loading text files against a contract: rows that break it are set apart with their reasons.

The file is read once, malformed lines included, and staged: Spark parses only the columns a
query asks for, so counts taken from the text itself would depend on the query. Accepted rows, rejected
rows and the report all read the staged table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import quoted
from convlens.sources.staging import stage
from convlens.sources.tables import write_table

RECORD, REASONS = "_record", "_reasons"


@dataclass(frozen=True)
class Contract:
    """What a table has to hold: types and required columns, conditions on a row (columns or SQL text), a
    unique key.

    A row whose condition is NULL passes it: ``required`` (NOT NULL in the schema) says what must be there.
    """

    schema: T.StructType
    checks: Mapping[str, Column | str] = field(default_factory=dict)
    key: Sequence[str] = ()


def schema_violations(t: DataFrame, schema: T.StructType) -> DataFrame:
    """column, problem (missing, extra, type), expected, found: every difference, not the first one."""
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    have = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    rows = [(c, "missing", kind, None) for c, kind in want.items() if c not in have]
    rows += [(c, "extra", None, kind) for c, kind in have.items() if c not in want]
    rows += [(c, "type", kind, have[c]) for c, kind in want.items() if have.get(c, kind) != kind]
    return t.sparkSession.createDataFrame(rows, "column string, problem string, expected string, found string")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """The columns of the schema and ``_record``, the text of a line that does not fit it.

    Quotes are read as ``write_table`` writes them. A header that names other columns stops the run. Line
    breaks inside quotes need ``multi_line``, with which a file is read by one task and not in splits.
    """
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    reader = spark.read.schema(T.StructType([*fields, T.StructField(RECORD, T.StringType(), True)]))
    reader = reader.options(header=True, sep=sep, mode="PERMISSIVE", enforceSchema=False)
    return reader.options(columnNameOfCorruptRecord=RECORD, multiLine=multi_line).csv(path)


def judged(t: DataFrame, contract: Contract) -> DataFrame:
    """The table with ``_reasons``, what each row breaks; staged.

    A malformed row has that reason alone, for its values cannot be trusted. All rows of a repeated key are
    rejected, as nothing says which one is right; a NULL in the key repeats nothing.
    """
    if RECORD not in t.columns:
        t = t.withColumn(RECORD, F.lit(None).cast("string"))
    reasons = [
        F.when(quoted(f.name).isNull(), F.lit(f"missing {f.name}"))
        for f in contract.schema.fields
        if not f.nullable
    ]
    for name, check in contract.checks.items():
        reasons.append(F.when(~(F.expr(check) if isinstance(check, str) else check), F.lit(name)))
    own = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    malformed = F.col(RECORD).isNotNull()
    t = stage(t.withColumn(REASONS, F.when(malformed, F.array(F.lit("malformed"))).otherwise(own)), "judged")
    if not contract.key:
        return t
    # counted before the shuffle; only repeated keys are joined, one row each
    counted = t.where(F.col(RECORD).isNull()).groupBy(*[quoted(k).alias(f"_key{i}") for i, k in enumerate(contract.key)])
    repeated = counted.agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    same = F.col(RECORD).isNull()
    for i, k in enumerate(contract.key):
        same = same & (quoted(k) == F.col(f"_key{i}"))
    found = F.when(F.col("_copies").isNotNull(), F.array(F.lit("repeated key"))).otherwise(F.array().cast("array<string>"))
    joined = t.join(repeated, same, "left").withColumn(REASONS, F.concat(REASONS, found))
    return stage(joined.select(*[quoted(c) for c in t.columns]), "judged-keys")


def accepted(rows: DataFrame, contract: Contract) -> DataFrame:
    return rows.where(F.size(REASONS) == 0).select(*[quoted(f.name) for f in contract.schema.fields])


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(REASONS) > 0)


def report(rows: DataFrame) -> DataFrame:
    """reason, rows: how many rows were accepted, how many rejected, and how many break each rule."""
    whole = F.when(F.size(REASONS) == 0, F.lit("accepted")).otherwise(F.lit("rejected"))
    reason = F.explode(F.concat(F.array(whole), F.col(REASONS)))
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def load(
    spark: SparkSession, path: str, contract: Contract, folder: str, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """Read a CSV file or folder, write ``accepted`` and ``rejected`` below ``folder``, return the report."""
    rows = judged(read_csv(spark, path, contract.schema, sep, multi_line), contract)
    write_table(accepted(rows, contract), f"{folder}/accepted")
    write_table(rejected(rows), f"{folder}/rejected")
    return report(rows)
