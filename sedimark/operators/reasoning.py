"""Support graphs, supersession, transitions, patterns and coverage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written


def closure(edges: DataFrame, child: str, parent: str, by: str | None = None) -> DataFrame:
    """(child, ancestor, distance) of all ancestors, by doubling: paths of length 2**k after k joins. A node that is its own ancestor stands on a cycle."""
    keys = [by] if by else []
    step = edges.select(*keys, F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct()
    known, n = written(step), None
    while True:
        next_ = known.select(*keys, F.col("child").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
        longer = known.where("child <> ancestor").join(next_, [*keys, "ancestor"]).select(*keys, "child", F.col("far").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        known = written(known.unionByName(longer).groupBy(*keys, "child", "ancestor").agg(F.min("distance").alias("distance")))
        now = tuple(known.agg(F.count("*"), F.sum("distance")).first())
        if now == n:
            return known
        n = now


def cycles(closed: DataFrame) -> DataFrame:
    return closed.where("child = ancestor")


def resolved_revisions(closed: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each observation with the number of revisions that its leaves stand on; leaves: ancestor, revision. A sound one has exactly one."""
    return closed.join(leaves, "ancestor").groupBy("child").agg(F.count_distinct("revision").alias("n_revisions"), F.min("revision").alias("revision"))


def successors(observations: DataFrame, by: str, ident: str, *order: str) -> DataFrame:
    """Each observation of a claim with the one that supersedes it."""
    w = W.partitionBy(by).orderBy(*order)
    return observations.withColumn("superseded_by", F.lead(ident).over(w)).withColumn("state", F.when(F.lead(ident).over(w).isNull(), "current").otherwise("superseded"))


def multiple_successors(edges: DataFrame, superseded: str) -> DataFrame:
    """Observations that more than one other supersedes."""
    return edges.where(F.col(superseded).isNotNull()).groupBy(superseded).agg(F.count("*").alias("n")).where("n > 1")


def transitions(events: DataFrame, by: str, kind: str, at: str, first: str, then: str) -> DataFrame:
    """By key, the first `first` event and the first `then` strictly after it; null if there is none. One aggregate and one window, no self-join."""
    w = W.partitionBy(by)
    start = F.min(F.when(F.col(kind) == first, F.col(at))).over(w)
    marked = events.where(F.col(kind).isin(first, then)).withColumn("from_at", start)
    return marked.groupBy(by).agg(F.min("from_at").alias("from_at"), F.min(F.when((F.col(kind) == then) & (F.col(at) > F.col("from_at")), F.col(at))).alias("to_at")).where("from_at is not null")


def patterns(occurrences: DataFrame, by: str, least_supporting: int = 2, least_controls: int = 0) -> DataFrame:
    """Patterns with enough sources that support them and enough negative controls, no source counted twice."""
    n = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("source_id")))
    return occurrences.groupBy(by).agg(n("supporting").alias("n_supporting"), n("negative_control").alias("n_controls"), F.count("*").alias("n_occurrences")).withColumn("holds", (F.col("n_supporting") >= least_supporting) & (F.col("n_controls") >= least_controls))


def pattern_faults(occurrences: DataFrame, by: str) -> DataFrame:
    """Sources or revisions with more than one occurrence in a pattern."""
    one = lambda c: occurrences.groupBy(by, F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(by, F.lit(c).alias("what"), "value", "n")
    return one("source_id").unionByName(one("source_revision_id"))


# coverage


def fragment_hits(requirements: DataFrame, evidence: DataFrame, by: str) -> DataFrame:
    """Requirements (requirement_id, fragment, and the key that evidence shares) with whether any statement of their key holds the fragment.

    The key makes it an equi-join: a requirement meets its own artifact's evidence, never all of it.
    """
    met = requirements.join(evidence.select(by, C.folded("statement").alias("s")), by, "left")
    return met.groupBy(*requirements.columns).agg(F.coalesce(F.bool_or(F.contains(F.col("s"), C.folded("fragment"))), F.lit(False)).alias("covered"))


def fragment_hits_anywhere(requirements: DataFrame, evidence: DataFrame, width: int = 4, automaton_bytes: int = 16 << 20) -> DataFrame:
    """Requirements (with a fragment) with whether any statement at all holds the fragment.

    A statement that holds a fragment has the fragment's words, but for the first and last, as whole words. So it has all windows of `width` of these; candidates are the statements with the
    fragment's rarest window, found by equi-joins on window hashes, and the fragment is then looked for itself. A fragment with a window that no statement has is decided without its text.
    Fragments too short for a window are looked for by automatons over every statement, one for each `automaton_bytes` of them, so what is broadcast has that size whatever their number.
    """
    ids = lambda words, at: F.xxhash64(F.array_join(F.slice(words, at, width), " "))
    need = written(requirements.select(C.folded("fragment").alias("f")).where("f is not null").distinct().withColumn("n", F.size(F.split("f", " "))))
    # statements get numbers of their own, so that the windows carry no text
    s = written(evidence.select(F.monotonically_increasing_id().alias("id"), C.folded("statement").alias("s")).where("s is not null"))
    long = need.where(F.col("n") >= width + 2).withColumn("w", F.split("f", " "))
    asked = long.select("f", F.explode(F.transform(F.sequence(F.lit(2), F.col("n") - width), lambda k: ids(F.col("w"), k))).alias("h")).distinct()
    # the words are an element of an array, so that a text is split once and not at every window
    windows = lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda k: ids(w, k)))
    has = s.select("id", F.explode(F.array_distinct(F.transform(F.array(F.split("s", " ")), windows)[0])).alias("h"))
    seen = written(has.join(asked.select("h").distinct(), "h", "left_semi"))
    counts = seen.groupBy("h").agg(F.count("*").alias("c"))
    rarest = asked.join(counts, "h", "left").groupBy("f").agg(F.min_by("h", "c").alias("h"), F.count_if(F.col("c").isNull()).alias("none")).where("none = 0").select("f", "h")
    met = seen.join(rarest, "h").select("f", "id").join(s, "id").where(F.contains(F.col("s"), F.col("f"))).select("f")
    for some in _in_chunks(need.where(F.col("n") < width + 2).select("f"), automaton_bytes):
        met = met.unionByName(s.mapInArrow(_holds(some), "f string"))
    met = met.distinct().withColumn("covered", F.lit(True))
    return requirements.distinct().withColumn("f", C.folded("fragment")).join(met, "f", "left").drop("f").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _in_chunks(fragments: DataFrame, most_bytes: int):
    """Lists of texts of about that many bytes each."""
    size = fragments.agg(F.sum(F.octet_length("f") + 64)).first()[0]
    chunks = -(-(size or 0) // most_bytes)
    for k in range(chunks):
        if some := [r.f for r in fragments.where(F.pmod(F.xxhash64("f"), F.lit(chunks)) == k).collect()]:
            yield some


def _holds(fragments: list[str]):
    """A function over batches of statements (column s) that gives the fragments that any of them holds, each once a task."""

    def run(batches):
        left = set(fragments)
        try:
            import ahocorasick
        except ImportError:
            look = lambda text: {f for f in left if f in text}
        else:
            automaton = ahocorasick.Automaton()
            for f in filter(None, fragments):
                automaton.add_word(f, f)
            automaton.make_automaton()
            look = lambda text: {f for _, f in automaton.iter(text)} if len(automaton) else set()
        for batch in batches:
            found = set()
            for text in batch.column("s").to_pylist():
                found |= look(text) & left
            if batch.num_rows and "" in left:
                found.add("")
            left -= found
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["f"])

    return run


def coverage(hits: DataFrame, by: str) -> DataFrame:
    """Covered requirements by case and in all, with their share (0.0 of none)."""
    share = F.coalesce(F.try_divide(F.count_if("covered"), F.count("*")), F.lit(0.0)).alias("fraction")
    return hits.rollup(by).agg(F.count("*").alias("n_required"), F.count_if("covered").alias("n_covered"), share).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("total")))


def gaps_by_capability(hits: DataFrame) -> DataFrame:
    return hits.where("not covered").groupBy("needed_capability").agg(F.count("*").alias("n_gaps"))


def tree_check(trees: DataFrame) -> DataFrame:
    """Trees (entries, required, exact, whole, truncated) with what is missing and whether the check holds."""
    missing, extra = F.array_except("required", "entries"), F.array_except("entries", "required")
    return trees.withColumn("missing", missing).withColumn("holds", (F.size(missing) == 0) & (~F.col("exact") | (F.size(extra) == 0)) & (~F.col("whole") | ~F.col("truncated")))


def matching_facts(facts: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors (selector_id, source_locator, field, op, expected) with the number of facts of their path whose JSON field equals or contains the expected text."""
    met = selectors.join(facts.select("source_locator", "normalized_value"), "source_locator", "left")
    value = F.expr("get_json_object(normalized_value, concat('$.', field))")
    ok = F.when(F.col("op") == "equals", value == F.col("expected")).otherwise(F.contains(value, F.col("expected")))
    return met.groupBy(*selectors.columns).agg(F.count_if(ok).alias("n_matches"))


def normalized_packets(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cited ids of model answers (packet_id, cited) that the packet allows; others are listed. No model is called."""
    cited = answers.select("packet_id", F.explode(F.array_distinct("cited")).alias("support_id"))
    met = cited.join(allowed.withColumn("ok", F.lit(True)), ["packet_id", "support_id"], "left")
    return met.groupBy("packet_id").agg(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("ok"), F.col("support_id"))))).alias("supports"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("ok").isNull(), F.col("support_id"))))).alias("rejected"))
