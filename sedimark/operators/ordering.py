"""Total orders of keys that may hold a large share of all rows.

Rows are dealt by ranges of key and order, sorted, and written with their place in that order, so a hot key lies over many ranges. What a range needs to know of
those before it (how many rows of its first key, the last value in effect) is a running value over one row for each key and range; a key has at most as many as there are ranges. No task
sorts or scans a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Keys with more rows than this are ordered by ranges where an operator has both ways; at most 10,000 keys can be, as the number follows the table's.
CROWD, MOST_HOT = 1_000_000, 10_000


def in_ranges(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The rows as a written table with place_ (their place in the order by key, not dense) and range_."""
    deal = [*(F.asc_nulls_first(b) for b in by), *order]
    sorted_ = rows.repartitionByRange(*deal).sortWithinPartitions(*deal)
    placed = written(sorted_.withColumn("place_", F.monotonically_increasing_id()))
    # the identifier's upper bits are the number of the range
    return placed.withColumn("range_", F.shiftright("place_", 33))


def _before(placed: DataFrame, by: list[str], what: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """For each key and range the values of `running`, made of the aggregates `what` of the key's ranges."""
    cells = placed.groupBy(*by, "range_").agg(*(c.alias(n) for n, c in what.items()))
    return cells.select(*(F.col(b).alias(f"{b}_of") for b in by), F.col("range_").alias("range_of"), *(c.alias(n) for n, c in running.items()))


def _with(placed: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    same = F.col("range_") == F.col("range_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_of"))
    return placed.join(cells, same).drop("range_of", *(f"{b}_of" for b in by))


def _earlier(by: list[str]):
    """All earlier ranges of a key."""
    # without a key there is one row a range, and no more
    return W.partitionBy(*(by or [F.lit(0)])).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)


def numbered(rows: DataFrame, name: str, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows with their number 1, 2, ... in the order within each key (none: in all rows)."""
    placed = in_ranges(rows, by, order)
    cells = _before(
        placed, by, {"n_": F.count("*"), "first_": F.min("place_")}, {"first_of": F.col("first_"), "before_": F.coalesce(F.sum("n_").over(_earlier(by)), F.lit(0))}
    )
    return _with(placed, cells, by).withColumn(name, F.col("place_") - F.col("first_of") + F.col("before_") + 1).drop("place_", "range_", "first_of", "before_")


def split_hot(rows: DataFrame, by: str, crowd: int = CROWD) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most a crowd of rows, and those of the other keys (None if there are no such keys). Null is a key like others.

    Keys count as hot from a crowd and a ten-thousandth of the rows on, so what is broadcast are at most MOST_HOT keys.
    """
    sizes = rows.groupBy(F.col(by).alias("hot_key_")).agg(F.count("*").alias("n_"))
    large = written(sizes.where(F.col("n_") > crowd))
    if not large.limit(1).count():
        return rows, None
    keys = F.broadcast(large.where(F.col("n_") > rows.count() // MOST_HOT).drop("n_"))
    same = F.col(by).eqNullSafe(F.col("hot_key_"))
    return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi")


def last_before(marks: DataFrame, by: str, order: list[str], value: str, wanted: Column) -> DataFrame:
    """The rows of `marks` for which `wanted` holds, with the value of the last row of their key, at or before them in the order, that has one."""
    placed = in_ranges(marks, [by], order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("place_")))
    carried = F.last("last_", ignorenulls=True).over(_earlier([by]))
    cells = _before(placed, [by], {"last_": last}, {"carried_": carried})
    own = F.last(value, ignorenulls=True).over(W.partitionBy("range_", by).orderBy("place_").rowsBetween(W.unboundedPreceding, 0))
    return _with(placed.withColumn("own_", own).where(wanted), cells, [by]).withColumn(value, F.coalesce("own_", "carried_")).drop("own_", "carried_", "place_", "range_")


def with_previous(rows: DataFrame, by: str, order: list[str], ident: str, previous: str, version: str) -> DataFrame:
    """rows with the ident of the row before them in their key's order, and their number."""
    placed = in_ranges(rows, [by], order)
    w = W.partitionBy("range_", by).orderBy("place_")
    cells = _before(
        placed, [by], {"n_": F.count("*"), "first_": F.min("place_"), "last_": F.max_by(F.struct(ident), "place_")},
        {"first_of": F.col("first_"), "before_": F.coalesce(F.sum("n_").over(_earlier([by])), F.lit(0)), "carried_": F.last("last_").over(_earlier([by]))[ident]},
    )
    own = F.when(F.col("place_") == F.col("first_of"), F.col("carried_")).otherwise(F.col("lag_"))
    return (
        _with(placed.withColumn("lag_", F.lag(ident).over(w)), cells, [by]).withColumn(previous, own)
        .withColumn(version, F.col("place_") - F.col("first_of") + F.col("before_") + 1).drop("lag_", "first_of", "before_", "carried_", "place_", "range_")
    )


def running_max(rows: DataFrame, by: str, order: list[str], value: Column, name: str, crowd: int = CROWD) -> DataFrame:
    """rows with the greatest value of the rows before them in their key's order (null before the first); keys with more than a crowd of rows are scanned by ranges."""
    cold, hot = split_hot(rows.withColumn("value_", value), by, crowd)
    before = lambda *keys: W.partitionBy(*keys).orderBy(*(("place_",) if len(keys) > 1 else order)).rowsBetween(W.unboundedPreceding, -1)
    out = cold.withColumn(name, F.max("value_").over(before(by)))
    if hot is not None:
        placed = in_ranges(hot, [by], order)
        cells = _before(placed, [by], {"most_": F.max("value_")}, {"carried_": F.max("most_").over(_earlier([by]))})
        own = placed.withColumn("own_", F.max("value_").over(before("range_", by)))
        out = out.unionByName(_with(own, cells, [by]).withColumn(name, F.greatest("own_", "carried_")).drop("own_", "carried_", "place_", "range_"))
    return out.drop("value_")
