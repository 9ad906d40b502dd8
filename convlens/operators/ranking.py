"""Ranks, percent ranks, shares and distances to the mean over group rows of any number.

``rank() OVER (ORDER BY x)`` and ``sum(x) OVER ()`` bring all groups to one task. Here the group
rows are staged once, so that the table behind them is read once; equal values are counted
together, which gives ties one rank; the counts run in slices that carry one row each; and totals
are added up in two phases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions.columns import percent, ratio, round_half_up
from convlens.operators.conversion import N, RATE
from convlens.operators.slicing import VALUES_PER_SLICE, plan_cuts, running_sums
from convlens.sources.staging import stage


class Standing:
    """The place of each group among all groups, or among those of equal ``by`` values.

    ``rank``, ``percent_rank``, ``share`` and ``vs_mean`` each add one column; ``table`` has the
    result. NULL measures rank as in SQL windows: last descending, first ascending. NaN is the largest value.
    """

    def __init__(
        self, res: DataFrame, by: Sequence[str] = (), values_per_slice: int = VALUES_PER_SLICE
    ):
        self.by = list(by)
        self.values_per_slice = values_per_slice
        self.rows = stage(res, "groups")
        self.table = self.rows

    def rank(self, measure: str = RATE, name: str = "rank_by_conv") -> Standing:
        """1 for the largest value; groups that tie share the smallest rank."""
        counted = self._counted(measure, descending=True)
        place = (F.col("_upto") - F.col("_rows") + 1).cast("long")
        return self._add(counted, [*self.by, measure], place, name)

    def percent_rank(
        self, measure: str = RATE, name: str = "conv_percent_rank", digits: int = 1
    ) -> Standing:
        """Share of the other groups with a smaller value, in percent; 0 for a single group."""
        counted = self._counted(measure, descending=False)
        below = F.col("_upto") - F.col("_rows")
        others = F.greatest(F.col("_all") - 1, F.lit(1))
        place = round_half_up(F.lit(100.0) * (below / others), digits)
        return self._add(counted, [*self.by, measure], place, name)

    def share(self, measure: str = N, name: str = "pct_of_dataset", digits: int = 2) -> Standing:
        """Share of the total of the measure, in percent."""
        if not self.by:
            total = self.rows.agg(F.sum(measure).alias("_all")).scalar()
            self.table = self.table.withColumn(name, percent(F.col(measure), total, digits))
            return self
        totals = self.rows.groupBy(*self.by).agg(F.sum(measure).alias("_all"))
        return self._join(totals, self.by, percent(measure, "_all", digits), name)

    def vs_mean(
        self, kind: str, measure: str = RATE, name: str | None = None, digits: int = 2
    ) -> Standing:
        """Difference to (``diff``) or quotient by (``index``) the unweighted mean of the groups."""
        if kind not in ("diff", "index"):
            raise ValueError(f"kind must be diff or index, not {kind}")
        name = name or {"diff": "diff_from_mean_pp", "index": "conv_index"}[kind]

        def value(mean: Column) -> Column:
            exact = F.col(measure) - mean if kind == "diff" else ratio(F.col(measure), mean)
            return round_half_up(exact, digits)

        if not self.by:
            self.table = self.table.withColumn(name, value(self.rows.agg(F.avg(measure)).scalar()))
            return self
        means = self.rows.groupBy(*self.by).agg(F.avg(measure).alias("_mean"))
        return self._join(means, self.by, value(F.col("_mean")), name)

    def _counted(self, measure: str, descending: bool) -> DataFrame:
        counts = self.rows.groupBy(*self.by, measure).agg(F.count(F.lit(1)).alias("_rows"))
        cuts = plan_cuts(self.rows, measure, self.values_per_slice)
        return running_sums(
            counts, self.by, measure, {"_upto": "_rows"}, cuts, descending, {"_all": "_rows"}
        )

    def _add(self, side: DataFrame, keys: Sequence[str], value: Column, name: str) -> Standing:
        return self._join(side.select(*keys, value.alias("_value")), keys, F.col("_value"), name)

    def _join(self, side: DataFrame, keys: Sequence[str], value: Column, name: str) -> Standing:
        columns = [*self.table.columns, name]
        side = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        self.table = self.table.join(side, same, "left").withColumn(name, value).select(*columns)
        return self
