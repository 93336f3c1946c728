"""Inspection: every locator resolved back to its place in the source. The inverse of extraction."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Aggregates and the lists that they count.
AGGREGATES = {"entry_count": "entries", "parent_count": "parents", "event_count": "events"}
#: The field by which a list's items are addressed.
LIST_KEYS = {"entries": "path", "jobs": "id", "artifacts": "id", "steps": "number"}


def resolved(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence (artifact_id, locator) with kind, the source text it stands for and whether it resolves; an unresolved locator is a row, not an error."""
    # texts are split once an artifact, before the join gives every piece of evidence its artifact
    met = evidence.join(artifacts.select("artifact_id", "source_locator", C.kept_lines("text").alias("rows")), "artifact_id", "left")
    first, last = C.locator_lines("locator")
    own = F.col("locator").startswith(F.col("source_locator"))
    typed = met.withColumn("location_kind", F.when(own, C.location_kind("locator"))).withColumn("first_line", first).withColumn("last_line", last)
    key = F.regexp_extract("locator", r"#\$path\.(\w+)$", 1)
    p = F.col("source_locator")
    path_value = F.when(key == "basename", C.basename(p)).when(key == "suffix", C.suffix(p)).when(key == "path_depth", C.depth(p).cast("string")).when(key == "top_level_entry", C.top_level(p))
    text = F.when(F.col("location_kind") == "artifact_metadata", path_value).when(F.col("location_kind").isin("text_lines", "text_range"), C.slice_rows("rows", F.col("first_line"), F.col("last_line")))
    return typed.withColumn("excerpt", text).drop("rows")


def ranges(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Range locators, of one line or several, with the exact text between their byte columns; null where that is no place in the text."""
    pattern = r":L(\d+):C(\d+)-L(\d+):C(\d+)"
    part = lambda k: F.regexp_extract("locator", pattern, k).cast("int")
    met = evidence.where(F.col("locator").rlike(pattern)).join(artifacts.select("artifact_id", C.kept_lines("text").alias("rows")), "artifact_id")
    return met.withColumn("excerpt", C.slice_range("rows", part(1), part(2), part(3), part(4))).drop("rows")


def _step(value: object, token: str) -> object:
    token = token.replace("~1", "/").replace("~0", "~")
    if isinstance(value, list):
        return value[int(token)]
    return value[token]


def resolve_pointer(document: object, pointer: str) -> object:
    """A JSON pointer, where list items may also be addressed by their key field and aggregates stand for their list."""
    parent, value = "", document
    for token in pointer.split("/")[1:]:
        if isinstance(value, dict) and token not in value and token in AGGREGATES:
            value, parent = value[AGGREGATES[token]], token
            continue
        if isinstance(value, list) and (field := LIST_KEYS.get(parent)) and all(isinstance(x, dict) and field in x for x in value):
            name = token.replace("~1", "/").replace("~0", "~")
            (value,) = [x for x in value if str(x[field]) == name]
        else:
            value = _step(value, token)
        parent = token
    return value


def structured(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Locators of JSON pointers and TOML keys with the value there as JSON (null and an error where there is none)."""

    kind_of = artifacts.schema["artifact_id"].dataType.simpleString()
    kinds = {"artifact_id": "Int64" if kind_of in ("bigint", "int") else object}

    def look(path: str, document: object, place: str) -> object:
        if path.lower().endswith(".toml"):
            for key in place.split("."):
                document = document[key]
            return document
        return resolve_pointer(document, place)

    def run(batches):
        for batch in batches:
            out = []
            for artifact, path, text, places in zip(batch["artifact_id"], batch["source_locator"], batch["text"], batch["places"]):
                # a text is parsed once, whatever the number of its locators
                try:
                    document, fault = (tomllib.loads if path.lower().endswith(".toml") else json.loads)(text), None
                except (ValueError, TypeError, RecursionError) as x:
                    document, fault = None, type(x).__name__
                for at in places:
                    try:
                        value = None if fault else json.dumps(look(path, document, at[len(path) + 1 :]), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
                        out.append((artifact, at, value, fault))
                    except (ValueError, KeyError, IndexError, TypeError) as x:
                        out.append((artifact, at, None, type(x).__name__))
            yield pd.DataFrame(out, columns=["artifact_id", "locator", "value", "error"]).astype(kinds)

    places = evidence.where(F.contains("locator", F.lit("#"))).groupBy("artifact_id").agg(F.collect_list("locator").alias("places"))
    met = artifacts.select("artifact_id", "source_locator", "text").join(places, "artifact_id")
    return met.mapInPandas(run, f"artifact_id {kind_of}, locator string, value string, error string")


def audit(evidence: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All evidence that can't be inspected, and why: its run, its artifact or its place."""
    sound = runs.where("run_type = 'extraction' and finished_at is not null").select("run_id")
    fault = lambda df, what: df.select("artifact_id", "locator", F.lit(what).alias("fault"))
    lost = resolved(evidence, artifacts)
    return (
        fault(evidence.join(sound, "run_id", "left_anti"), "run").unionByName(fault(evidence.join(artifacts, "artifact_id", "left_anti"), "artifact"))
        .unionByName(fault(lost.where("source_locator is not null and (location_kind is null or (location_kind in ('text_lines', 'text_range', 'artifact_metadata') and excerpt is null))"), "place"))
    )
