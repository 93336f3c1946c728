"""Coverage reports: summaries by case and capability, and their lines as rows, so that a report of any length is written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def with_unsupported(results: DataFrame, unsupported: DataFrame) -> DataFrame:
    """results (case_id, requirement_id, status, needed_capability, matched_locators, missing) with a gap for each requirement that no check supports (case_id, requirement_id, needed_capability)."""
    none = F.array().cast("array<string>")
    return results.unionByName(unsupported.select("case_id", "requirement_id", F.lit("gap").alias("status"), "needed_capability", none.alias("matched_locators"), none.alias("missing")))


def case_summaries(results: DataFrame) -> DataFrame:
    """(case_id, recovered, total, fraction)."""
    return results.groupBy("case_id").agg(F.count_if(F.col("status") == "recovered").alias("recovered"), F.count("*").alias("total")).withColumn("fraction", F.round(F.col("recovered") / F.col("total"), 6))


def needed_capabilities(results: DataFrame) -> DataFrame:
    """(needed_capability, n_gaps)."""
    return results.where("status = 'gap'").groupBy("needed_capability").agg(F.count("*").alias("n_gaps"))


def report_lines(results: DataFrame) -> DataFrame:
    """(section, key, at, line): the lines of a Markdown report; in the order of section, key and at they are the report.

    Sections: 1 totals, 2 cases, 3 capabilities that lack, 4 requirements with their places and missing fragments.
    """
    code = lambda c: F.concat(F.lit("`"), C.col(c), F.lit("`"))
    line = lambda df, section, key, at, text: df.select(F.lit(section).alias("section"), key.alias("key"), F.lit(at).alias("at"), text.alias("line"))
    sums = results.agg(F.count_distinct("case_id").alias("c"), F.count("*").alias("n"), F.count_if(F.col("status") == "recovered").alias("r"))
    said = {"Cases": F.col("c"), "Requirements": F.col("n"), "Recovered": F.col("r"), "Gaps": F.col("n") - F.col("r"), "Fraction": F.format_number(F.coalesce(F.try_divide(F.col("r"), F.col("n")), F.lit(0.0)), 3)}
    totals = sums.select(F.lit(1).alias("section"), F.lit("").alias("key"), F.posexplode(F.array(*(F.concat(F.lit(f"- {k}: **"), v.cast("string"), F.lit("**")) for k, v in said.items()))).alias("at", "line"))
    cases = line(case_summaries(results), 2, F.col("case_id"), 0, F.concat(F.lit("| "), code("case_id"), F.lit(" | "), F.col("recovered").cast("string"), F.lit(" | "), F.col("total").cast("string"), F.lit(" | "), F.format_number("fraction", 3), F.lit(" |")))
    lack = line(needed_capabilities(results), 3, F.coalesce("needed_capability", F.lit("")), 0, F.concat(F.lit("- "), code(F.coalesce("needed_capability", F.lit(""))), F.lit(": "), F.col("n_gaps").cast("string")))
    head = F.concat(F.lit("- "), code("requirement_id"), F.lit(": **"), F.col("status"), F.lit("**"), F.when(F.col("needed_capability").isNotNull(), F.concat(F.lit(" needs "), code("needed_capability"))).otherwise(F.lit("")))
    listed = lambda c, what: F.transform(c, lambda x: F.concat(F.lit(f"  - {what}: `"), x, F.lit("`")))
    detail = results.select(F.lit(4).alias("section"), F.concat_ws("/", "case_id", "requirement_id").alias("key"), F.posexplode(F.concat(F.array(head), listed("matched_locators", "matched"), listed("missing", "missing"))).alias("at", "line"))
    return totals.unionByName(cases).unionByName(lack).unionByName(detail)


def write_markdown(results: DataFrame, path: str) -> None:
    """Writes the report's lines as text files whose names are in their order."""
    order = ("section", "key", "at")
    report_lines(results).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def write_json(results: DataFrame, path: str) -> None:
    """Writes the requirements' results as JSON lines."""
    results.write.json(path)
