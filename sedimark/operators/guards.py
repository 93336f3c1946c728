"""Integrity guards: plans whose rows are violations, and the one place where they are evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A guard found violations; the message shows the first five and how many more there are."""


def require_empty(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Fails with a preview if there are rows. The only guard that runs a job."""
    rows = violations.limit(shown + 1).collect()
    if rows:
        more = violations.count() - shown if len(rows) > shown else 0
        raise GuardError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows[:shown]) + (f" (+{more} more)" if more else ""))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose reference is null or names no row of parent."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone holds: empty where the sides are the same set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def not_exactly_once(expected: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Expected keys that aren't assigned exactly once, and assigned keys that aren't expected."""
    n = assigned.groupBy(key).agg(F.count("*").alias("n"))
    return expected.select(key).distinct().withColumn("expected", F.lit(True)).join(n, key, "full_outer").where("not (coalesce(expected, false) and coalesce(n, 0) = 1)").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def incomplete_runs(runs: DataFrame, run_type: str, outputs: bool = True) -> DataFrame:
    """Runs of another type, unfinished, or (where outputs is set) without the digest of their outputs."""
    bad = (F.col("run_type") != run_type) | F.col("finished_at").isNull()
    return runs.where(bad | F.col("outputs_hash").isNull() if outputs else bad)


def count_mismatches(summaries: DataFrame, rows: DataFrame, key: str, declared: str) -> DataFrame:
    """Summaries whose declared count isn't the number of their rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("actual"))
    return summaries.join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.col(declared) != F.col("actual")).select(key, declared, "actual")


def out_of_order(df: DataFrame, earlier: str, later: str) -> DataFrame:
    return df.where(F.col(later) < F.col(earlier))


def over_ceiling(df: DataFrame, by: str, most: int) -> DataFrame:
    """Groups with more rows than a hard ceiling; they fail, they are never cut."""
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most)


def mixed_generation(rows: DataFrame, summary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that disagree with their generation's summary in any field, null-safe."""
    s = summary.select(F.col(key), *(F.col(f).alias(f"__{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return rows.join(s, key).where(~same).select(key, *fields)
