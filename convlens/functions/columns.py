"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(sql_name(name))


# -- numbers ---------------------------------------------------------------


def round_half_up(c: ColumnLike, digits: int = 2) -> Column:
    """Round half away from zero in binary arithmetic.

    Spark's ``round`` rounds the shortest decimal text of a double, other engines round
    the binary value; this form gives the same answer everywhere.
    """
    c = as_column(c).cast("double")
    scale = float(10**digits)
    rounded = F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    # floor() goes through a long; leave values it cannot hold as they are
    return F.when(F.abs(c) < F.lit(9.0e18 / scale), rounded).otherwise(c)


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """Double division, NULL where the denominator is zero."""
    den = as_column(den).cast("double")
    return as_column(num).cast("double") / F.nullif(den, F.lit(0.0))


def percent(num: ColumnLike, den: ColumnLike, digits: int = 2) -> Column:
    den = as_column(den).cast("double")
    return round_half_up(
        F.lit(100.0) * as_column(num).cast("double") / F.nullif(den, F.lit(0.0)), digits
    )


def count_where(predicate: Column) -> Column:
    """Number of rows for which the predicate holds (NULL does not count); 0 on no rows."""
    return F.count(F.when(predicate, F.lit(1)))


def cap(c: ColumnLike, upper) -> Column:
    """Clip at an upper bound; NULL stays NULL (``least`` alone would return the bound)."""
    c = as_column(c)
    return F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)


def minutes(c: ColumnLike, digits: int = 1) -> Column:
    return round_half_up(as_column(c) / F.lit(60.0), digits)


def finite_or_null(c: ColumnLike) -> Column:
    """NaN and the infinities become NULL."""
    c = as_column(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def number(c: ColumnLike, type_name: str = "double", strict: bool = True) -> Column:
    """Cast to a number. Strict raises on bad text (ANSI cast), otherwise bad text is NULL."""
    c = as_column(c)
    return c.cast(type_name) if strict else c.try_cast(type_name)


# -- text ------------------------------------------------------------------


def norm_text(c: ColumnLike) -> Column:
    """Strip any white space at both ends and lower-case; NULL stays NULL."""
    return F.lower(F.regexp_replace(as_column(c), r"^\s+|\s+$", ""))


def contains_any(c: ColumnLike, words: Iterable[str]) -> Column:
    """True when the lower-cased text holds any of the words as a substring."""
    text = F.lower(as_column(c))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word.lower())
    return hit


def join_list(c: ColumnLike, sep: str = ", ") -> Column:
    return F.array_join(as_column(c), sep)


# -- flags, tiers, codes ---------------------------------------------------


def flag(predicate: Column) -> Column:
    """0/1 integer; a NULL predicate counts as 0."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def sentinel_flag(c: ColumnLike, sentinel) -> Column:
    """1 where the value is real, 0 where it is the sentinel, NULL where it is missing."""
    return (as_column(c) != F.lit(sentinel)).cast("int")


def strip_sentinel(c: ColumnLike, sentinel, replacement=-1) -> Column:
    c = as_column(c)
    return F.when(c == F.lit(sentinel), F.lit(replacement)).otherwise(c)


def tier(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First rule that holds gives the label."""
    out = None
    for predicate, label in rules:
        out = F.when(predicate, F.lit(label)) if out is None else out.when(predicate, F.lit(label))
    return out.otherwise(F.lit(default))


def band(
    c: ColumnLike, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True
) -> Column:
    """Right-closed bands: ``(e0, e1], (e1, e2], ...``.

    ``include_lowest`` closes the first band on the left as well. Values outside the
    edges and NULL give NULL.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("band needs one label per pair of neighbouring edges")
    c = as_column(c)
    low = c < F.lit(edges[0]) if include_lowest else c <= F.lit(edges[0])
    out = F.when(c.isNull() | low, F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def map_codes(c: ColumnLike, codes: Mapping[str, int]) -> Column:
    """Look a label up in a fixed table; a label outside it gives NULL."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    c = as_column(c)
    return F.when(c.isNotNull(), table[c])


def ordinal(c: ColumnLike, levels: Sequence[str], first: int = 1, default: int | None = None) -> Column:
    """Position of a label in an ordered list, ``default`` when it is not in the list."""
    code = map_codes(c, {level: first + i for i, level in enumerate(levels)})
    return code if default is None else F.coalesce(code, F.lit(default))


# -- keys ------------------------------------------------------------------


def key_hash(key: ColumnLike, seed: int | str, first: int = 1, digits: int = 8) -> Column:
    """Hex digits of the MD5 of ``key:seed`` -- the same for a row on every run and engine."""
    text = F.concat(as_column(key).cast("string"), F.lit(f":{seed}"))
    return F.substring(F.md5(text), first, digits)


def text_key(c: ColumnLike) -> Column:
    """SHA-256 of the whole text: a fixed-width key to group copies by."""
    return F.sha2(as_column(c).cast("string"), 256)
