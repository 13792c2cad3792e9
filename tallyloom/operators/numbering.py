"""Order within groups, without a task that holds a group.

Rows are dealt by ranges of (group, order), sorted there and written. A row's place in its range is known from the sort; a
table of one row for each group and range turns it into the place in the group, or brings the last value of the ranges before. So one
second, one key or one source may hold any share of the rows: its rows lie in as many ranges as their number calls for,
and no window runs over more than a range. Rows that are equal in all of ``order`` share a range; give a column that tells
them apart. Results read tables in the shared folder (see ``staging``), so that the ranges that were counted are the ranges that are
numbered, whatever executor is lost meanwhile.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.staging import materialize, partitions


def _ranges(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """The rows, written by ranges, with ``__range`` and ``__row``, which ascends in a range."""
    keys = [*[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    dealt = df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)
    return materialize(dealt.withColumns({"__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "ranges")


def _by_range(rows: DataFrame, small: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """Each row with the row of ``small`` for its group (nulls are a group) and range."""
    named = small.withColumnsRenamed({g: f"__group_{i}" for i, g in enumerate(group)} | {"__range": "__in_range"})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__group_{i}")) for i, g in enumerate(group)], F.col("__range") == F.col("__in_range"))
    return rows.join(named, same, how)


def number_rows(df: DataFrame, group: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """Adds ``name``: 0, 1, ... (long) in each group, ascending by ``order``, nulls first; null is a group of its own."""
    rows = _ranges(df, group, order)
    counts = rows.groupBy(*group, "__range").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    numbered = _by_range(rows, counts.select(*group, "__range", shift.alias("__shift")), group)
    return numbered.withColumn(name, F.col("__row") + F.col("__shift")).select(*[c for c in df.columns if c != name], name)


def with_previous(df: DataFrame, group: list[str], order: list[str | Column], value: Column, name: str = "previous", where: Column | None = None) -> DataFrame:
    """Adds ``name``: the value of the last row before in the group, null for none; with ``where``, of the last row before
    for which that holds. With descending ``order`` this is the next row."""
    counts = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    rows = _ranges(df.withColumn("__value", F.when(counts, F.struct(value.alias("v")))), group, order)
    before = lambda by, key: Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("__value IS NOT NULL").groupBy(*group, "__range").agg(F.max_by("__value", "__row").alias("__end"))
    carried = _by_range(rows.select(*group, "__range").distinct(), ends, group, "left")
    earlier = carried.select(*group, "__range", F.last("__end", True).over(before(group, "__range")).alias("__earlier"))
    inside = rows.withColumn("__inside", F.last("__value", True).over(before([*group, "__range"], "__row")))
    return _by_range(inside, earlier, group).withColumn(name, F.coalesce("__inside", "__earlier")["v"]).select(*[c for c in df.columns if c != name], name)
