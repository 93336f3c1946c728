"""All queries of the engine with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import delta, extract, governance, guards, identity, inspect, pages, payloads, planning, reasoning, selectors
from ..operators import capture as cap
from ..sources import tables
from . import comparison, envelopes, pipelines, reports
from . import lenses as L
from .oracle import ORACLES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


def _flat(c):
    """Text with line breaks as spaces."""
    return F.regexp_replace(c, "\n", " ")


# paths


@query
def path_facts(spark, d):
    return extract.path_facts(L.url_paths(spark, d)).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def surface_classify(spark, d):
    t = L.tree(spark, d, "current").unionByName(L.tree(spark, d, "previous")).select("path").distinct()
    return t.select("path", C.change_surface("path").alias("surface"))


@query
def surface_counts(spark, d):
    return surface_classify(spark, d).groupBy("surface").agg(F.count("*").alias("n"))


@query
def media_types(spark, d):
    t = L.tree(spark, d, "current").select("path")
    return t.groupBy(C.media_type("path").alias("media_type")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query
def path_groups(spark, d):
    return L.tree(spark, d, "current").groupBy(C.path_group("path").alias("path_group")).agg(F.count("*").alias("n"))


@query
def safe_paths(spark, d):
    return L.url_paths(spark, d).select("artifact_id", C.safe_path("source_locator").alias("safe"))


# extraction


@query
def md_paragraphs(spark, d):
    return extract.markdown_paragraphs(L.markdown(L.artifacts(spark, d))).select("artifact_id", "locator", "statement")


@query
def md_list_items(spark, d):
    return extract.markdown_list_items(L.markdown(L.artifacts(spark, d))).select("artifact_id", "locator", "statement")


def _props(spark, d):
    e = L.events(spark, d)
    return e.select(F.col("event_id").alias("artifact_id"), F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".json")).alias("source_locator"), F.col("props").alias("text"))


@query
def json_pointer_leaves(spark, d):
    return extract.facts_of(extract.parsed(_props(spark, d), (extract.JSON,))).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def json_diagnostics(spark, d):
    """Documents are no JSON: every one gives a diagnostic, none stops the run."""
    a = L.artifacts(spark, d).withColumn("source_locator", F.concat("source_locator", F.lit(".json")))
    return extract.diagnostics_of(extract.parsed(a, (extract.JSON,))).groupBy("extractor_name", "error_type").agg(F.count("*").alias("n"))


@query
def package_json_facts(spark, d):
    p = L.dealt_parts(spark, d)
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.struct(F.col("p_brand").alias("left"), F.col("p_size").alias("n")).alias("dependencies"), F.struct(F.lit("x").alias("build"), F.lit("y").alias("a")).alias("scripts")))
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/package.json")).alias("source_locator"), body.alias("text"))
    return extract.facts_of(extract.parsed(a, extract.DEFAULT)).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def pyproject_facts(spark, d):
    p = L.dealt_parts(spark, d)
    text = F.concat(F.lit('[project]\nname = "'), "p_brand", F.lit('"\nversion = " '), F.col("p_size").cast("string"), F.lit('"\ndependencies = ["b", "a ", "b"]\n[build-system]\nrequires = ["x"]\n'))
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.lit("pyproject.toml").alias("source_locator"), text.alias("text"))
    return extract.facts_of(extract.parsed(a, extract.DEFAULT)).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def python_ast_facts(spark, d):
    p = L.dealt_parts(spark, d)
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("def f_"), k, F.lit("(a, b=1):\n    x = g(a, key=b)\n    assert x\n    return x\n"))
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("m"), k, F.lit(".py")).alias("source_locator"), text.alias("text"))
    f = extract.facts_of(extract.parsed(a, extract.PYTHON))
    return f.select("artifact_id", F.regexp_extract("locator", r"#python/(\w+)$", 1).alias("kind"), F.get_json_object("normalized_value", "$.scope").alias("scope"), F.get_json_object("normalized_value", "$.line").cast("long").alias("line"))


def _modules(spark, d):
    """A Python module for each part: a class with a method that calls, assigns, asserts and defines a function."""
    p = L.dealt_parts(spark, d)
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    n = lambda m: (size % m).cast("string")
    text = F.concat(
        F.lit("class C"), k, F.lit(":\n    def run(self, x):\n        y = make_"), n(3), F.lit("(x, '"), "p_brand", F.lit("', limit="), n(5), F.lit(")\n        assert y  >  "), n(4),
        F.lit(", 'm'\n        def inner():\n            return helper(y, key="), n(2), F.lit(")\n        return inner\nhelper(1)\n"),
    )
    return p.select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("m"), k, F.lit(".py")).alias("source_locator"), text.alias("text"), "p_size", "p_brand")


@query
def python_nodes(spark, d):
    """Kinds, names and scopes of a module's nodes, and how many nodes lie inside each."""
    return extract.counted_inside(extract.python_nodes(_modules(spark, d))).select("artifact_id", "kind", "scope", "name", _joined("targets"), "n_inside")


@query
def python_selectors(spark, d):
    """A requirement of seven selectors for each part's module: function, call with arguments and keywords, assignment, assertion, and calls inside a method or nowhere."""
    m = _modules(spark, d)
    c, of = F.concat(F.lit("C"), F.col("artifact_id").cast("string")), lambda x: F.lit(x)
    none, words = F.lit(None), lambda *x: F.array(*x).cast("array<string>")

    def one(place, kind, scope=none, name=none, args=none, keywords=none, value_call=none, contains=none, inside=none):
        fields = {"place": of(place), "kind": of(kind), "scope": scope, "name": name, "args_contains": args, "keywords": keywords, "value_call": value_call, "contains": contains, "inside": inside}
        kinds = dict(f.split(" ", 1) for f in selectors.SELECTOR.split(", "))
        return F.struct(*(v.cast(kinds[k]).alias(k) for k, v in fields.items()))

    run = F.concat(c, F.lit(".run"))
    asked = [
        one(1, "function", name=F.concat(run, F.lit(".inner"))), one(2, "call", run, of("make_1"), words(F.lower("p_brand"), of("X")), F.create_map(of("limit"), of("2"))),
        one(3, "assignment", run, of("y"), keywords=F.create_map(of("limit"), of("1")), value_call=of("make_0")), one(4, "assert", run, contains=of("Y > 3")),
        one(5, "call", F.concat(run, F.lit(".inner")), of("helper"), keywords=F.create_map(of("key"), of("1")), inside=run), one(6, "call", of("<module>"), of("helper"), keywords=F.create_map(of("key"), of("None"))),
        one(7, "call", of("<module>"), of("helper"), inside=run),
    ]
    wanted = m.select(F.col("artifact_id").cast("string").alias("requirement_id"), F.col("source_locator").alias("artifact"), F.explode(F.array(*asked)).alias("s")).select("requirement_id", "artifact", "s.*")
    # the last selector can't be met; every third requirement leaves it out
    wanted = wanted.where("place < 7 or requirement_id % 3 <> 0")
    found = selectors.assessed(selectors.python_matches(extract.python_nodes(m), wanted))
    return found.select("requirement_id", "status", F.size("matched_locators").alias("n_locators"), F.size("missing").alias("n_missing"), F.array_join("missing", "|").alias("missing"))


@query
def typescript_facts(spark, d):
    p = L.dealt_parts(spark, d)
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("// part "), k, F.lit("\nexport function f"), k, F.lit("(a) {\n  const x = g(a);\n  if (x) { throw x; }\n}\n"))
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("m"), k, F.lit(".ts")).alias("source_locator"), text.alias("text"))
    rows = extract.parsed(a, extract.TYPESCRIPT)
    return rows.groupBy("extractor_name", F.coalesce(F.regexp_extract("locator", r"#typescript/(\w+)$", 1), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@query
def evidence_ordinals(spark, d):
    """Identities of facts from their place in the total order of each source."""
    f = extract.path_facts(L.artifacts(spark, d)).withColumn("capture_id", F.split("source_locator", "/")[0])
    return extract.numbered_facts(f, "run", "capture_id").select("capture_id", "fact_index", "locator", "evidence_id")


@query
def assertion_ordinals(spark, d):
    """Identities of paragraphs and of list items from their place in the total order of each source, which is by line numbers, not by their text."""
    a = L.markdown(L.artifacts(spark, d))
    said = extract.markdown_paragraphs(a).unionByName(extract.markdown_list_items(a)).withColumn("capture_id", F.split("source_locator", "/")[0])
    return extract.numbered_assertions(said, "run", "capture_id").select("capture_id", "assertion_index", "locator", "assertion_id")


@query
def run_envelopes(spark, d):
    f = extract.path_facts(L.artifacts(spark, d)).withColumn("capture_id", F.split("source_locator", "/")[0])
    return extract.envelope(f, ["capture_id"], "locator", "normalized_value").select("capture_id", "n_rows", "outputs_hash")


@query
def typescript_scopes(spark, d):
    """A class of each part with a method, an arrow function, a call in a template, an overload and a regular expression: names and kinds with the columns that they stand in."""
    p = L.dealt_parts(spark, d)
    k, n = F.col("p_partkey").cast("string"), (F.col("p_size") % 3).cast("string")
    text = F.concat(
        F.lit("// é "), k, F.lit("\nclass C"), k, F.lit(" {\n  go(a: string): void;\n  async go(a) { const é = `x${f"), n, F.lit("(a)} (`; return /[)(]/.test(é) }\n}\nexport const h"), k,
        F.lit(" = (x: number): string => {\n  if (!x) { throw new E(x); }\n  return a.b(x)?.c"), n, F.lit("(1, [2, 3])\n}\n"),
    )
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("m"), k, F.lit(".ts")).alias("source_locator"), text.alias("text"))
    value = lambda f: F.get_json_object("normalized_value", f"$.{f}")
    facts = extract.facts_of(extract.parsed(a, extract.TYPESCRIPT)).where("extractor_name = 'typescript-lexical'")
    return facts.select("artifact_id", F.concat_ws("-", value("line"), value("column"), value("end_line"), value("end_column")).alias("at"), value("node_type").alias("node_type"), F.coalesce(value("name"), value("callee"), value("condition"), value("expression")).alias("what"), value("arguments").alias("arguments"))


# inspection


@query
def locator_slices(spark, d):
    a = L.markdown(L.artifacts(spark, d))
    return inspect.resolved(extract.markdown_paragraphs(a).select("artifact_id", "locator", "statement"), a).select("artifact_id", "locator", "location_kind", _flat("excerpt").alias("excerpt"))


@query
def inspect_paths(spark, d):
    a = L.artifacts(spark, d)
    return inspect.resolved(extract.path_facts(a).select("artifact_id", "locator", "normalized_value"), a).select("artifact_id", "locator", "excerpt", F.col("excerpt").eqNullSafe(F.col("normalized_value")).alias("agrees"))


@query
def inspect_ranges(spark, d):
    """Ranges of one line and of several in documents, by bytes; some end inside a character or beyond a line."""
    a = L.artifacts(spark, d).where("text is not null")
    n = F.size(C.kept_lines("text"))
    to = F.least(n, F.lit(3)) * F.when(F.col("artifact_id") % 2 == 0, 1).otherwise(0) + F.when(F.col("artifact_id") % 2 == 0, 0).otherwise(1)
    at = F.concat("source_locator", F.lit(":L1:C"), (F.col("artifact_id") % 5).cast("string"), F.lit("-L"), to.cast("string"), F.lit(":C"), (F.col("artifact_id") % 11 + 4).cast("string"), F.lit("#x"))
    found = inspect.ranges(a.select("artifact_id", at.alias("locator")), a)
    return found.select("artifact_id", "locator", C.digest(F.coalesce("excerpt", F.lit("none"))).alias("excerpt_hash"))


@query
def inspect_toml(spark, d):
    """TOML keys of generated manifests, one of which isn't there."""
    p = L.dealt_parts(spark, d)
    text = F.concat(F.lit('[project]\nname = "'), "p_brand", F.lit('"\nsize = '), F.col("p_size").cast("string"), F.lit("\n"))
    a = p.select(F.col("p_partkey").alias("artifact_id"), F.lit("pyproject.toml").alias("source_locator"), text.alias("text"))
    keys = F.explode(F.array(*(F.lit(f"pyproject.toml#project.{k}") for k in ("name", "size", "none"))))
    return inspect.structured(a.select("artifact_id", keys.alias("locator")), a)


@query
def inspect_pointers(spark, d):
    a = _props(spark, d)
    return inspect.structured(extract.facts_of(extract.parsed(a, (extract.JSON,))), a).select("artifact_id", "locator", "value")


# change


def _sides(spark, d):
    return L.capture(spark, d, "previous"), L.capture(spark, d, "current")


def _artifact_deltas(spark, d):
    return delta.artifact_deltas(*(x.select(*L.SIDE) for x in _sides(spark, d)))


@query
def artifact_delta(spark, d):
    return _artifact_deltas(spark, d).select("source_locator", "change_type", "previous_content_hash", "current_content_hash")


@query
def artifact_delta_counts(spark, d):
    return _artifact_deltas(spark, d).groupBy("change_type").agg(F.count("*").alias("n"))


def _facts(x):
    """One fact of each captured artifact, its length, beside its path's facts."""
    live = x.where("retrieval_status = 'captured'")
    size = live.select("artifact_id", "source_locator", F.concat("source_locator", F.lit("#length")).alias("locator"), F.length("text").cast("string").alias("raw_value"), F.length("text").cast("string").alias("normalized_value"), F.lit("length").alias("extractor_name"), F.lit("1").alias("extractor_version"))
    return extract.path_facts(live).unionByName(size)


@query
def structural_delta(spark, d):
    was, now = _sides(spark, d)
    return delta.structural_deltas(_facts(was), _facts(now), _artifact_deltas(spark, d)).select("source_locator", "structural_key", "change_type", "previous_value", "current_value")


@query
def structural_delta_gaps(spark, d):
    """The same, without the paths that an extractor couldn't read on either side."""
    was, now = _sides(spark, d)
    gaps = was.where("text like '%|%'").select("source_locator").union(now.where("text like '%|%'").select("source_locator"))
    return delta.structural_deltas(_facts(was), _facts(now), _artifact_deltas(spark, d), gaps).groupBy("change_type").agg(F.count("*").alias("n"))


@query
def unexplained_structure(spark, d):
    """Facts that differ in unchanged paths: the lengths of some artifacts are told wrongly on one side."""
    was, now = _sides(spark, d)
    wrong = F.col("locator").endswith("#length") & (F.col("artifact_id") % 23 == 9)
    told = _facts(now).withColumn("normalized_value", F.when(wrong, F.concat("normalized_value", F.lit("!"))).otherwise(F.col("normalized_value")))
    return delta.unexplained_structure(_facts(was), told, _artifact_deltas(spark, d)).select("source_locator", "extractor_name")


def _assertions(x):
    return extract.markdown_paragraphs(L.markdown(x.where("retrieval_status = 'captured'")))


@query
def assertion_changes(spark, d):
    was, now = _sides(spark, d)
    return delta.assertion_changes(_assertions(was), _assertions(now))


def _tree_deltas(spark, d):
    return delta.tree_deltas(L.tree(spark, d, "previous"), L.tree(spark, d, "current"), ("previous", "current"))


@query
def delta_identities(spark, d):
    """Identities of changed artifacts, facts and paths."""
    was, now = _sides(spark, d)
    a, p = _artifact_deltas(spark, d), _tree_deltas(spark, d)
    s = delta.structural_deltas(_facts(was), _facts(now), a)
    return (
        a.select(F.lit("artifact").alias("kind"), F.col("source_locator").alias("at"), F.col("artifact_delta_id").alias("id"))
        .unionByName(s.select(F.lit("structure").alias("kind"), F.concat_ws("|", "source_locator", "structural_key").alias("at"), F.col("structural_delta_id").alias("id")))
        .unionByName(p.select(F.lit("path").alias("kind"), F.col("path").alias("at"), F.col("git_path_delta_id").alias("id")))
    )


@query
def tree_path_diff(spark, d):
    return _tree_deltas(spark, d).select("path", "change_type", "surface", "previous_object_sha", "current_object_sha")


@query
def diff_summary(spark, d):
    return delta.diff_summary(_tree_deltas(spark, d), "surface", "change_type")


@query
def materiality(spark, d):
    """Each customer's consecutive orders as revisions."""
    o = L.table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = o.select("o_orderkey", F.lag("o_orderkey").over(w).cast("string").alias("previous_commit_sha"), F.col("o_orderkey").cast("string").alias("current_commit_sha"), F.lag("o_orderpriority").over(w).alias("previous_tree_sha"), F.col("o_orderpriority").alias("current_tree_sha")).where("previous_commit_sha is not null")
    return delta.materiality(pairs).select("o_orderkey", "reason", "material")


# planning


def _plans(spark, d):
    return planning.capture_plans(_tree_deltas(spark, d))


@query
def capture_plan(spark, d):
    return _plans(spark, d).select("path", F.col("previous.disposition").alias("previous_disposition"), F.col("previous.reason").alias("previous_reason"), F.col("current.disposition").alias("current_disposition"), F.col("current.reason").alias("current_reason"), "policy_suppressed")


@query
def required_paths(spark, d):
    return planning.required_paths(_plans(spark, d))


@query
def suppressed_paths(spark, d):
    return planning.suppressed_paths(_plans(spark, d))


@query
def first_parent_chain(spark, d):
    c = L.table(spark, d, "conversations").select("conv_id", "turn").distinct().withColumn("parent", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    return planning.first_parent_chain(c, "conv_id", "turn", "parent")


@query
def latest_touch(spark, d):
    t = L.touches(spark, d)
    return planning.latest_touch(t.select("path").distinct(), t)


@query
def commit_snapshots(spark, d):
    files = F.struct(F.col("path").alias("filename"), F.lit(None).cast("string").alias("previous_filename"))
    c = L.touches(spark, d).groupBy("commit_ordinal").agg(F.collect_list(files).alias("files")).select(F.col("commit_ordinal").cast("string").alias("commit_sha"), F.col("commit_ordinal").alias("ordinal"), F.array().cast("array<string>").alias("parent_shas"), "files")
    return planning.commit_snapshots(c).select("ordinal", _joined("touched_paths"))


def _segments(spark, d):
    t = L.touches(spark, d)
    return planning.segments(planning.latest_touch(t.select("path").distinct(), t).withColumn("commit_ordinal", F.floor(F.col("commit_ordinal") / 1000)))


@query
def candidate_segments(spark, d):
    return _segments(spark, d).select("commit_ordinal", "path_group", "chunk_ordinal", F.size("paths").alias("n_paths"), _joined("paths"))


@query
def candidate_size_stats(spark, d):
    s = _segments(spark, d).select(F.size("paths").alias("n"))
    return s.agg(F.count("*").alias("n_candidates"), F.expr("percentile(n, 0.5)").alias("median_paths"), F.max("n").alias("max_paths"), F.expr("percentile_disc(0.95) within group (order by n)").cast("long").alias("p95_paths"))


@query
def exact_cover(spark, d):
    """Paths that aren't in exactly one candidate: some were taken out of theirs, some stand in a second one."""
    found = _segments(spark, d)
    lost = found.withColumn("paths", F.filter("paths", lambda p: ~p.endswith("7")))
    twice = found.withColumn("paths", F.filter("paths", lambda p: p.endswith("11")))
    return planning.segment_faults(L.touches(spark, d).select("path"), lost.unionByName(twice)).select("path", F.col("n").cast("long").alias("n"))


def _signals(spark, d):
    deltas = tables.written(_tree_deltas(spark, d))  # read five times below
    plans = planning.capture_plans(deltas)
    artifact = deltas.where("change_type in ('modified', 'removed')").select("path")
    structural = deltas.where("change_type = 'modified' and previous_object_sha <> current_object_sha").select("path")
    assertions = deltas.where("path like '%.md' and change_type <> 'added'").select("path")
    gaps = deltas.where("current_size > 1000000").select("path")
    return planning.path_signals(deltas.select("path", C.path_group("path").alias("path_group")), plans, artifact, structural, assertions, gaps)


@query
def candidate_reduction(spark, d):
    return planning.reductions(_signals(spark, d), "path_group").select("path_group", "n_paths", _joined("signal_kinds"), "disposition")


@query
def reduction_counts(spark, d):
    r = planning.reductions(_signals(spark, d).withColumn("folder", F.substring_index("path", "/", 2)), "folder")
    return r.groupBy("disposition").agg(F.count("*").alias("n"))


@query
def signal_counts(spark, d):
    return _signals(spark, d).select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


@query
def gap_signals(spark, d):
    was, now = _sides(spark, d)
    diag = lambda x, side: x.where("text like '%|%'").select(F.col("source_locator").alias("path"), F.lit(side).alias("side"), F.concat(F.lit(f"{side}-"), F.col("artifact_id").cast("string")).alias("diagnostic_id"))
    paths = L.artifacts(spark, d).select(F.col("source_locator").alias("path"), "source")
    g = planning.gap_signals(paths, diag(was, "previous").unionByName(diag(now, "current")), "source")
    return g.select("source", *map(_joined, ("paths", "previous_diagnostic_ids", "current_diagnostic_ids")))


@query
def change_signal_counts(spark, d):
    """The whole change signal over two captures of the documents, whose paths are also the trees' paths: rows by product."""
    was, now = (x.withColumn("capture_id", F.lit(side)) for x, side in zip(_sides(spark, d), ("previous", "current")))
    tree = lambda x: x.select(F.col("source_locator").alias("path"), F.lit("blob").alias("entry_type"), F.lit("100644").alias("mode"), F.substring(F.coalesce("content_hash", F.lit("sha256:missing")), 8, 40).alias("object_sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    touched = L.artifacts(spark, d).where("artifact_id % 2 = 0").select(F.col("source_locator").alias("path"), (F.col("artifact_id") % 9 + 1).alias("commit_ordinal"))
    r = pipelines.change_signal(was, now, (tree(was), tree(now)), touched, "run", ("previous", "current"))
    n = lambda df, what: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    retained = r.reductions.where("disposition = 'retain'")
    return n(r.artifact_deltas, "artifact deltas").unionByName(n(r.path_deltas, "path deltas")).unionByName(n(r.candidates.select(F.explode("paths")), "candidate paths")).unionByName(n(retained, "retained")).unionByName(n(r.reductions, "reductions")).unionByName(n(r.gaps, "gaps")).unionByName(n(r.structural_deltas, "structural deltas"))


# tracking, registry, profiles


def _levels(spark, d):
    level = F.create_map(*(F.lit(x) for kv in L.LEVELS.items() for x in kv))
    return L.events(spark, d).select("user_id", "event_id", "ts", F.element_at(level, F.col("event_type")).alias("level"))


def _timeline(spark, d):
    """Assignments: the level changes at purchases, signups and errors; of one moment the first event counts."""
    t = _levels(spark, d).where(F.col("level").isin("0", "3", "4"))
    return t.groupBy("user_id", "ts").agg(F.min_by(F.struct("event_id", "level"), "event_id").alias("r")).select("user_id", "ts", F.col("r.event_id").alias("assignment_id"), "r.level")


@query
def asof_tracking(spark, d):
    return governance.as_of(L.events(spark, d).select("user_id", "event_id", F.col("ts").alias("at")), _timeline(spark, d), "user_id", "at", "ts", "assignment_id", "level").select("event_id", "assignment_id", "level")


@query
def tracking_policy(spark, d):
    p = governance.policy_of("level")
    return asof_tracking(spark, d).select("event_id", p["capture_depth"].alias("capture_depth"), p["polling_mode"].alias("polling_mode"), p["reasoning_allowed"].alias("reasoning_allowed"))


@query
def tracking_history(spark, d):
    return governance.history(_timeline(spark, d), "user_id", "assignment_id", "ts", "assignment_id").select("assignment_id", "supersedes", F.col("version").cast("long").alias("version"))


@query
def tracking_assignments(spark, d):
    """Events as requests to assign their user's level, in order of their ids: which are recorded, which repeat or contradict one, and which come too late."""
    e = _levels(spark, d)
    hour = F.unix_micros(F.date_trunc("day", "ts"))
    r = e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("source_id"), "level", F.when(F.col("event_id") % 29 != 5, "me").otherwise(" ").alias("assigned_by"), F.lit("why").alias("reason"),
        F.when(F.col("event_id") % 9 == 4, hour + 1).when(F.col("event_id") % 2 == 0, hour).alias("effective_at"), hour.alias("recorded_at"),
    )
    first = e.groupBy(F.col("user_id").alias("source_id")).agg(F.unix_micros(F.date_trunc("day", F.min("ts"))).alias("first_seen_at")).where("source_id % 7 <> 3").withColumn("first_seen_at", F.col("first_seen_at") + F.when(F.col("source_id") % 5 == 0, 5 * 86_400_000_000).otherwise(0))
    return governance.assigned(r, first).select(F.col("seq").alias("event_id"), "state")


@query
def tracking_gates(spark, d):
    r = asof_tracking(spark, d).join(L.events(spark, d).select("event_id", "event_type"), "event_id").select("event_id", "level", F.when(F.col("event_type") == "purchase", 4).otherwise(2).alias("needed_rank"), (F.col("event_type") == "error").alias("needs_process"), F.lit(False).alias("needs_reasoning"))
    return governance.gate_violations(r).select("event_id")


@query
def latest_locator(spark, d):
    o = L.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return governance.latest_locators(o, "o_custkey", "o_orderdate", "o_orderkey")


@query
def discovery_dedupe(spark, d):
    p = L.table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("discovered_locator"), F.col("page_id").alias("position"))
    return governance.discovery_hits(p, "run").select("discovered_locator", "position", F.col("ordinal").cast("long").alias("ordinal"))


@query
def registry_resolve(spark, d):
    c = L.table(spark, d, "customer")
    hits = c.select(F.col("c_name").alias("discovered_locator"))
    meta = c.where("c_acctbal > 0").select(F.col("c_name").alias("discovered_locator"), F.col("c_nationkey").alias("provider_repository_id"))
    known = L.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("provider_repository_id"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("source_id"))
    return governance.resolve_hits(hits, meta, known).select("discovered_locator", "state", F.when(F.col("state") == "resolved", F.col("source_id")).alias("source_id"))


@query
def profile_features(spark, d):
    a = L.artifacts(spark, d)
    rows = extract.path_facts(a).select("artifact_id", "source_locator", "extractor_name", F.lit(True).alias("is_fact")).unionByName(extract.markdown_paragraphs(L.markdown(a)).select("artifact_id", "source_locator", "extractor_name", F.lit(False).alias("is_fact")))
    p = governance.profiles(rows.withColumn("media_type", C.media_type("source_locator")).withColumn("source_id", F.split("source_locator", "/")[0]), "source_id")
    return p.select("source_id", _joined("extractor_families"), _joined("artifact_media_types"), "artifact_count", "evidence_fact_count", "source_assertion_count", _joined("feature_keys"))


@query
def triage_band(spark, d):
    c = L.table(spark, d, "customer")
    flags = F.array_compact(F.array(F.when(F.col("c_nationkey") % 3 == 0, "governance"), F.when(F.col("c_nationkey") % 4 == 0, "experiment")))
    p = c.select(
        "c_custkey", (F.col("c_nationkey") % 6).cast("string").alias("level"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("domain_match"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("n_structural_deltas"), flags.alias("sensitivity_flags"), F.lit(1).alias("evidence_fact_count"),
        F.when(F.col("c_acctbal") > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("extractor_families"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("surface:workflow"))).otherwise(F.array().cast("array<string>")).alias("feature_keys"),
    )
    return governance.triage(p).select("c_custkey", "band", _joined("reasons"))


@query
def action_policy(spark, d):
    o = L.table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "contribute_upstream").when(F.col("o_orderpriority").startswith("2"), "adopt").when(F.col("o_orderpriority").startswith("3"), "pin").otherwise("monitor")
    p = o.select(F.col("o_orderkey").alias("action_id"), kind.alias("action_type"), F.when(F.col("o_custkey") % 2 == 0, "maintainer").otherwise("observer").alias("actor_role"), (F.col("o_totalprice") > 150000).alias("repository_modification_required"), (F.col("o_custkey") % 3 != 0).alias("can_write"), (F.col("o_custkey") % 5 != 0).alias("can_contribute"))
    rules = spark.createDataFrame([("r1", "prohibit", ["adopt"], []), ("r2", "require_role", ["pin", "adopt"], ["maintainer"]), ("r3", "require_independent_authorization", ["contribute_upstream", "pin"], [])], "rule_id string, effect string, action_types array<string>, allowed_actor_roles array<string>")
    return governance.action_decisions(p, rules).select("action_id", "decision", "status", _joined("matched_rule_ids"))


@query
def readiness_outcome(spark, d):
    p = L.table(spark, d, "part")
    need = p.select(F.col("p_partkey").alias("case_id"), F.explode(F.array(F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string")), F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")))).alias("capability"))
    caps = spark.createDataFrame([("c0", "available"), ("c1", "available"), ("c2", "available"), ("c3", "missing"), ("c4", "deferred"), ("c5", "available")], "capability string, state string")
    return governance.readiness(need.distinct(), caps)


@query
def review_faults(spark, d):
    o = L.table(spark, d, "orders")
    reviews = o.select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_custkey") % 4 == 0, "Thing").otherwise("Pattern").alias("subject_type"), F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "F", "ACCEPT").otherwise("LATER").alias("decision"))
    subjects = L.table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("Pattern").alias("subject_type"), F.col("c_custkey").alias("subject_id"))
    return governance.review_faults(reviews, subjects).select("review_id")


# reasoning


def _threads(spark, d):
    return L.table(spark, d, "conversations").select("conv_id", "turn").distinct().withColumn("parent", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))).where("parent is not null")


@query
def support_closure(spark, d):
    return reasoning.closure(_threads(spark, d), "turn", "parent", "conv_id").select("conv_id", "child", "ancestor", "distance")


@query
def observation_revisions(spark, d):
    e = _threads(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("o"), F.concat_ws(":", "conv_id", "parent").alias("s"))
    leaves = L.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("ancestor"), F.col("role").alias("revision"))
    return reasoning.resolved_revisions(reasoning.closure(e, "o", "s"), leaves).select("child", "n_revisions", "revision")


@query
def supersession(spark, d):
    return reasoning.successors(_levels(spark, d), "user_id", "event_id", "ts", "event_id").select("event_id", "superseded_by", "state")


@query
def event_transition(spark, d):
    return reasoning.transitions(L.events(spark, d), "user_id", "event_type", "ts", "signup", "error")


@query
def pattern_min_sources(spark, d):
    e = L.events(spark, d).select("event_type", F.col("user_id").alias("source_id"), F.when(F.col("value") > 50, "supporting").otherwise("negative_control").alias("role"))
    return reasoning.patterns(e, "event_type", 2, 1)


def _hits(spark, d):
    """Whole benchmark items against all documents."""
    need = L.table(spark, d, "benchmark").select(F.col("item_id").alias("requirement_id"), F.col("text").alias("fragment"), F.when(F.col("item_id") % 2 == 0, "tree").otherwise("ast").alias("needed_capability"))
    return reasoning.fragment_hits_anywhere(need, L.table(spark, d, "documents").select(F.col("text").alias("statement")))


@query
def coverage_fraction(spark, d):
    return reasoning.coverage(_hits(spark, d), "needed_capability").withColumn("fraction", F.round("fraction", 6))


@query
def coverage_gaps(spark, d):
    return reasoning.gaps_by_capability(_hits(spark, d))


# sources, sinks and guards


@query
def append_idempotent(spark, d):
    """Orders landed again, some edited, some new: the rows an append would add."""
    o = L.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("payload"))
    old = o.where("o_orderkey % 3 <> 0")
    again = o.withColumn("payload", F.when(F.col("o_orderkey") % 7 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return tables.split_append(again, old, ["o_orderkey"], "payload")[0].select("o_orderkey", "payload")


@query
def conflict_rows(spark, d):
    o = L.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("payload"))
    again = o.withColumn("payload", F.when(F.col("o_orderkey") % 7 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return tables.split_append(again, o.where("o_orderkey % 3 <> 0"), ["o_orderkey"], "payload")[1]


@query
def content_dedupe(spark, d):
    """Contents by digest: what a content-addressed store would hold."""
    return L.artifacts(spark, d).groupBy(C.digest("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("artifact_id").alias("first_id"))


@query
def capture_manifests(spark, d):
    a = L.artifacts(spark, d)
    asked = a.select(F.col("source").alias("capture_id"), F.col("source_locator").alias("path"))
    got = L.capture(spark, d, "current").where("retrieval_status = 'captured'").select(F.col("source").alias("capture_id"), F.col("source_locator").alias("path"), F.col("text").cast("binary").alias("data"))
    m = cap.manifests(cap.capture_refs(cap.requested_paths(asked), got))
    return m.select("capture_id", F.size("artifacts").cast("long").alias("n_refs"), F.size(F.filter("artifacts", lambda r: r["retrieval_status"] == "missing")).cast("long").alias("n_missing"))


@query
def reconstruction_faults(spark, d):
    a = L.artifacts(spark, d)
    asked = a.select(F.col("source").alias("capture_id"), F.col("source_locator").alias("path"))
    refs = cap.capture_refs(cap.requested_paths(asked), a.select(F.col("source").alias("capture_id"), F.col("source_locator").alias("path"), F.col("text").cast("binary").alias("data")))
    kept = refs.join(a.where("artifact_id % 17 <> 0").select("source_locator"), "source_locator", "left_semi")
    objects = kept.where("source_locator not like '%9.md'").select("content_hash").distinct()
    return cap.reconstruction_faults(cap.manifests(refs), kept, objects).groupBy("fault").agg(F.count("*").alias("n"))


@query
def provider_facts(spark, d):
    """Flat payload fields to facts, nulls kept."""
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("artifact_id"), F.col("s_name").alias("name"), F.nullif(F.col("s_nationkey"), F.lit(3)).alias("nation"))
    return cap.unpivoted(s, ["artifact_id"], ["name", "nation"], "$x#", "supplier").select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def lineage_integrity(spark, d):
    """Line items up to their region, by inner joins."""
    li, o, c = (L.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    n, r = L.table(spark, d, "nation"), L.table(spark, d, "region")
    up = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return up.groupBy("r_name").agg(F.count("*").alias("n_lines"), F.count_distinct("o_orderkey").alias("n_orders"))


@query
def orphans(spark, d):
    """References that name nothing: parts that no line item has, labels without a document."""
    p = guards.orphans(L.table(spark, d, "part"), L.table(spark, d, "lineitem"), "p_partkey", "l_partkey").agg(F.count("*").alias("n")).withColumn("what", F.lit("parts"))
    return p.unionByName(guards.orphans(L.table(spark, d, "labels"), L.table(spark, d, "documents"), "doc_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("labels")))


@query
def closed_set_check(spark, d):
    return guards.set_difference(L.table(spark, d, "labels"), L.table(spark, d, "documents"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query
def duplicate_keys(spark, d):
    return guards.duplicates(L.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query
def count_mismatches(spark, d):
    s = L.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("declared"))
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return guards.count_mismatches(s, li, "o_orderkey", "declared")


# provider facts, guards and comparisons


@query
def inconsistent_metadata(spark, d):
    s = L.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("private"), F.when(F.col("s_suppkey") % 4 == 0, "private").otherwise("public").alias("visibility"))
    return cap.inconsistent_metadata(s)


@query
def commit_facts(spark, d):
    """Orders as commits whose parent is the order before."""
    o = L.table(spark, d, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        key.alias("artifact_id"), F.sha2(key.cast("string"), 256).alias("sha"), F.sha2("o_orderpriority", 256).alias("tree_sha"), F.array((key - 1).cast("string")).alias("parent_shas"), F.lit(1).alias("parent_count"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_date"), F.when(key % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("committer_date"),
    )
    return cap.commit_facts(rows).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def event_facts(spark, d):
    """Each user's events as the history of an issue, in order; null fields make no fact."""
    e = L.events(spark, d)
    one = F.struct(
        F.col("event_id").alias("id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("node_id"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("actor"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("commit_id"), F.lit(None).cast("string").alias("commit_url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    histories = cap.ordered_events(e.groupBy(F.col("user_id").alias("artifact_id")).agg(F.collect_list(one).alias("events")))
    return cap.event_facts(histories).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def repository_metadata_facts(spark, d):
    s = L.table(spark, d, "supplier")
    rows = s.select(
        F.col("s_suppkey").alias("artifact_id"), F.col("s_suppkey").alias("id"), F.lower("s_name").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") != 3, "main").alias("default_branch"),
        (F.col("s_suppkey") % 2 == 0).alias("archived"), F.lit(False).alias("fork"), F.lit("public").alias("visibility"),
    )
    return cap.metadata_facts(rows).select("artifact_id", "locator", F.col("normalized_value").alias("value"))


@query
def workflow_step_facts(spark, d):
    """Orders as jobs, their line items as steps."""
    li = L.table(spark, d, "lineitem")
    step = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("name"), F.lit("completed").alias("status"), F.when(F.col("l_linestatus") == "O", "success").alias("conclusion"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("started_at"), F.lit(None).cast("string").alias("completed_at"))
    jobs = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(step).alias("steps")).withColumn("artifact_id", F.col("id") % 100)
    return cap.step_facts(jobs).groupBy("artifact_id", F.substring_index("locator", "/", -1).alias("field"), F.col("normalized_value").alias("value")).agg(F.count("*").alias("n"))


@query
def tree_facts(spark, d):
    t = L.tree(spark, d, "current").withColumn("tree_sha", F.split("path", "/")[0])
    return cap.tree_facts(t).select("tree_sha", "locator", C.digest("normalized_value").alias("value_hash"))


@query
def incomplete_collections(spark, d):
    o = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).alias("jobs_total"), F.lit(0).alias("artifacts_total"))
    n = L.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("jobs"))
    runs = o.join(n, "l_orderkey").withColumn("artifacts", F.array().cast("array<int>"))
    return cap.incomplete_collections(runs).select("l_orderkey", "jobs_total", F.size("jobs").alias("n_jobs"))


@query
def job_logs(spark, d):
    """Jobs with the probe of their log, where there is one."""
    jobs = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("conclusion"))
    probes = jobs.where("id % 3 <> 0").select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, "available").otherwise("expired").alias("availability"), F.when(F.col("id") % 2 == 0, 302).otherwise(410).alias("http_status"), (F.col("id") % 2 == 0).alias("redirected"))
    return cap.jobs_with_logs(jobs, probes).groupBy("conclusion", "availability", "http_status", "redirected").agg(F.count("*").alias("n"))


@query
def registry_drift(spark, d):
    """Suppliers observed again, some renamed, some moved to no nation."""
    s = L.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    again = s.withColumn("s_name", F.when(F.col("s_suppkey") % 6 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name"))).withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")))
    return cap.drift(s, again, "s_suppkey", ["s_name", "s_nationkey"])


@query
def resolution_conflicts(spark, d):
    c = L.table(spark, d, "customer").select(F.col("c_custkey").alias("hit_id"), F.col("c_nationkey").alias("source_id"), F.lit("resolved").alias("state"))
    again = c.where("hit_id % 2 = 0").withColumn("state", F.when(F.col("hit_id") % 8 == 0, "unresolved").otherwise(F.col("state")))
    return governance.resolution_conflicts(c, again, "hit_id", ["source_id", "state"])


@query
def authorised_captures(spark, d):
    """Orders as captures of customers; a customer's latest locator must come from a registry run and be resolved once."""
    o = L.table(spark, d, "orders")
    captures = o.select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("source_id"))
    locators = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("repository_locator_id"), F.col("o_orderdate").alias("observed_at"), (F.col("o_orderkey") % 10).cast("string").alias("pipeline_run_id"))
    runs = spark.range(10).select(F.col("id").cast("string").alias("run_id"), F.when(F.col("id") < 7, "registry").otherwise("capture").alias("run_type"))
    resolutions = o.select(F.col("o_orderkey").alias("repository_locator_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0))).alias("k"))
    return cap.authorised(captures, locators, runs, resolutions).select("capture_id", "source_id", "repository_locator_id")


@query
def backdated_assignments(spark, d):
    e = L.events(spark, d).select("event_id", F.col("ts").alias("recorded_at"), F.when(F.col("event_id") % 4 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts")).alias("effective_at"))
    return governance.backdated(e).select("event_id")


@query
def incomplete_runs(spark, d):
    o = L.table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 11 == 0, "capture").otherwise("extraction").alias("run_type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("finished_at"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("outputs_hash"))
    return guards.incomplete_runs(runs, "extraction").select("run_id")


@query
def out_of_order(spark, d):
    """Line items shipped before they were ordered."""
    both = L.table(spark, d, "lineitem").join(L.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return guards.out_of_order(both, "o_orderdate", "l_shipdate").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query
def scope_mismatches(spark, d):
    side = lambda s: L.tree(spark, d, s).select(F.lit("both").alias("side"), "path")
    return planning.scope_mismatches(side("previous"), side("current")).groupBy("side", "fault").agg(F.count("*").alias("n"))


@query
def multiple_successors(spark, d):
    return reasoning.multiple_successors(L.events(spark, d).select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("superseded")), "superseded")


@query
def pattern_faults(spark, d):
    e = L.events(spark, d).select("event_type", F.col("user_id").alias("source_id"), F.date_trunc("day", "ts").cast("string").alias("source_revision_id"))
    return reasoning.pattern_faults(e, "event_type").groupBy("event_type", "what").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_occurrences"))


@query
def matching_facts(spark, d):
    """Selectors on a JSON field of the facts of a path."""
    facts = L.events(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_locator"), F.col("props").alias("normalized_value"))
    wanted = L.table(spark, d, "customer").select(
        F.col("c_custkey").alias("selector_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("source_locator"), F.lit("k").alias("field"),
        F.when(F.col("c_custkey") % 2 == 0, "equals").otherwise("contains").alias("op"), (F.col("c_custkey") % 10).cast("string").alias("expected"),
    )
    return reasoning.matching_facts(facts, wanted).select("selector_id", "n_matches")


@query
def fragments_over_assertions(spark, d):
    """Each document's paragraphs one after the other, and fragments of two neighbouring lines, of which some don't stand there."""
    a = L.markdown(L.artifacts(spark, d))
    said = extract.markdown_paragraphs(a).withColumn("line", F.regexp_extract("locator", r":L(\d+)-", 1).cast("int"))
    o = said.groupBy("source_locator").agg(F.min(F.struct("line", "statement")).alias("a"), F.max(F.struct("line", "statement")).alias("b"), F.count("*").alias("n")).where("n > 0")
    # the last words of the first paragraph and the first of the last: together only where the paragraphs are neighbours
    tail = lambda c: F.element_at(F.split(c, " "), -1)
    # only letters that become themselves again in lower case: the upper case of "ß" is "SS"
    louder = lambda c: F.translate(c, ascii_lowercase, ascii_uppercase)
    need = o.select(F.col("source_locator").alias("artifact"), F.concat_ws("  ", tail("a.statement"), louder(F.split("b.statement", " ")[0])).alias("fragment"))
    found = selectors.fragments_covered(need, said.select("locator", "statement", "line"), ["line"])
    return found.select("artifact", "covered")


@query
def locator_prefixes(spark, d):
    """Evidence of artifacts by prefix of the locator: paths that contain the mark themselves belong to several artifacts."""
    p = L.table(spark, d, "part")
    path = F.concat_ws(":", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")))
    e = p.select(F.concat(path, F.lit(":L"), F.col("p_size").cast("string"), F.lit("#x")).alias("locator"), "p_partkey")
    wanted = p.select(F.explode(F.array("p_type", F.concat_ws(":", "p_type", "p_brand"))).alias("artifact"))
    return selectors.by_prefix(e, wanted).groupBy("artifact").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query
def golden_probe(spark, d):
    """Orders as expected observations whose locators are their parts: those that no supplier line has, or that several have, are faults."""
    li = L.table(spark, d, "lineitem")
    groups = li.select(F.col("l_orderkey").alias("group_id"), F.concat(F.lit("part:"), (F.col("l_partkey") % 97).cast("string")).alias("locator"))
    s = L.table(spark, d, "supplier")
    records = s.select(F.concat(F.lit("part:"), (F.col("s_suppkey") % 61).cast("string")).alias("locator"), F.col("s_name").alias("record_id")).where("locator <> 'part:5'")
    return selectors.golden_cover(groups, records)


@query
def golden_supports(spark, d):
    """Locators of all expected observations with the record that they name, or why they don't name one."""
    groups = L.table(spark, d, "part").select(F.lit("g").alias("group_id"), F.concat(F.lit("p:"), "p_partkey").alias("locator"))
    records = L.table(spark, d, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("p:"), "l_partkey").alias("locator"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id")).where("length(record_id) % 2 = 0")
    return selectors.golden_supports(groups, records).select("locator", "n_records", "fault", "support_id")


def _pages(spark, d):
    """Each customer's orders as a list read in pages of five: some pages lack, failed, came twice or were read while the list changed."""
    o = L.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    made = o.withColumn("page", (F.floor(n / 5) + 1).cast("int")).groupBy("o_custkey", "page").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("items"))
    k = F.col("o_custkey")
    total = F.when(k % 5 != 4, F.col("all_") + F.when((k % 11 == 2) & (F.col("page") == 1), 1).otherwise(0))
    rows = made.join(o.groupBy("o_custkey").agg(F.count("*").alias("all_")), "o_custkey").select(
        F.concat(F.lit("c"), k.cast("string")).alias("request"), "page", F.lit(5).alias("page_size"), total.alias("total"), F.when((k % 13 == 3) & (F.col("page") == 1), 500).otherwise(200).alias("status"),
        F.when((k % 17 == 5) & (F.col("page") == 2), "b2").otherwise("b1").alias("merge_base"), "items", k.alias("k"),
    ).where("not (k % 7 = 1 and page = 2)")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.when((F.col("k") % 19 == 6) & (F.col("page") == 1), 2).otherwise(1)))).drop("copies", "k")


@query
def page_faults(spark, d):
    return pages.page_faults(_pages(spark, d), 4)


@query
def page_items(spark, d):
    """Items of the lists that are whole, with their places."""
    return pages.assembled(_pages(spark, d), 4)


@query
def commit_range_faults(spark, d):
    """The lists as commit ranges, of which some are said to be identical, end elsewhere or have another base."""
    p = tables.written(_pages(spark, d))
    last = p.groupBy("request").agg(F.max_by(F.element_at("items", -1), "page").alias("head"))
    k = F.regexp_replace("request", "c", "").cast("long")
    ranges = last.select("request", F.when(k % 3 == 0, "b0").otherwise("b1").alias("base"), F.when(k % 4 == 1, "x").otherwise(F.col("head")).alias("head"), F.when(k % 10 == 9, "identical").when(k % 23 == 7, "behind").otherwise("ahead").alias("range_status"))
    return pages.range_faults(p, ranges, 12)


@query
def identity_merge(spark, d):
    """Customers as sightings of repositories: three share a provider id, a renamed one names its neighbour, and some components belong to two sources."""
    k = F.col("c_custkey")
    group = F.floor(k / 3)
    c = L.table(spark, d, "customer").select(
        k.alias("hit_id"), F.when(group % 9 != 8, F.concat(F.lit("id"), group.cast("string"))).alias("provider_repository_id"), F.concat(F.lit("R"), k.cast("string")).alias("name"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("r"), (k + 1).cast("string")))).alias("aliases"), k.alias("observed_at"),
    )
    again = c.unionByName(c.where("hit_id % 6 = 0"))  # the same sightings again
    known = c.where("provider_repository_id is not null").select("provider_repository_id", F.floor(F.col("hit_id") / 3).alias("g")).distinct().where("g % 4 = 0 or g % 7 = 0").select("provider_repository_id", F.concat(F.lit("s"), (F.col("g") % 11).cast("string")).alias("source_id"))
    return identity.merged(again, known).distinct().select("hit_id", "state", F.when(F.col("state") == "resolved", F.col("source_id")).alias("source_id"), "component", F.array_join("aliases", ",").alias("aliases"))


def _workflows(spark, d):
    """Orders as workflow runs, their line items as jobs with a log and two steps, and as artifacts."""
    k = F.col("artifact_id")
    o = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("conclusion")).alias("run"))
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").alias("line"))
    # one aggregate of plain lines; the payload is built after it, where no sort holds it any more
    x = li.unionByName(o, allowMissingColumns=True).where(k.isNotNull()).groupBy("artifact_id").agg(F.max("run").alias("run"), F.array_sort(F.collect_list("line")).alias("x")).where("run is not null and size(x) > 0")
    step = lambda n, v: F.struct(F.lit(n).alias("number"), F.concat(F.lit("s"), v["l_returnflag"]).alias("name"), F.when(v["l_linestatus"] == "O", "success").alias("conclusion"))

    def job(v, i):
        log = F.struct(F.lit("available").alias("availability"), F.when((i + 1) % 2 == 0, 302).alias("http_status"))
        return F.struct((i + 1).alias("id"), v["l_returnflag"].alias("name"), log.alias("log"), F.array(step(1, v), step(2, v)).alias("steps"))

    return x.select(
        "artifact_id", F.concat(F.lit("$run/"), "artifact_id").alias("source_locator"), "run", (F.size("x") + F.when(k % 9 == 2, 1).otherwise(0)).alias("job_count"), F.size("x").alias("artifact_count"),
        F.transform("x", job).alias("jobs"), F.transform("x", lambda v, i: F.struct((i + 1).alias("id"), v["l_quantity"].cast("long").alias("size_in_bytes"))).alias("artifacts"),
    )


@query
def workflow_payload_facts(spark, d):
    """Runs, counts, jobs, logs, steps and artifacts in the order of their payload."""
    f = payloads.workflow_facts(_workflows(spark, d), "r")
    return f.select("artifact_id", "fact_index", "locator", "normalized_value")


@query
def workflow_count_faults(spark, d):
    return payloads.workflow_count_faults(_workflows(spark, d))


def _commits(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("artifact_id"), F.lit("$git/commit").alias("source_locator"), k.cast("string").alias("commit_sha"), F.col("o_orderstatus").alias("tree_sha"), F.when(k % 5 != 0, F.array((k - 1).cast("string"))).alias("parents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_timestamp"), F.lit(None).cast("string").alias("committer_timestamp"),
        F.when(k % 3 == 0, F.struct((k % 2 == 0).alias("verified"), F.lit("valid").alias("reason"))).alias("verification"), F.concat(F.lit("Order of  "), "o_orderpriority").alias("message"),
    )


@query
def commit_payload_facts(spark, d):
    """Commit facts with what is known of their verification, and identities."""
    return payloads.commit_facts(_commits(spark, d), "r").select("artifact_id", "evidence_id", "locator", "normalized_value")


@query
def commit_message_check(spark, d):
    """Fragments looked for in messages; what a requirement lacks and the capability that it needs."""
    k = F.col("o_orderkey")
    need = L.table(spark, d, "orders").select(k.alias("requirement_id"), (k + F.when(k % 6 == 0, 10**9).otherwise(0)).alias("artifact_id"), F.array(F.lit("order OF"), F.when(k % 2 == 0, "urgent").otherwise("low")).alias("fragments"), F.when(k % 4 == 0, "x").alias("needed_capability"))
    return payloads.message_check(need, payloads.commit_messages(_commits(spark, d))).select("requirement_id", "status", "locator", _joined("missing"), "needed_capability")


@query
def event_payload_facts(spark, d):
    """Each user's events as a history: three aggregates, then the fields that aren't null."""
    e = L.events(spark, d)
    one = F.struct(F.col("event_id").alias("provider_id"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("commit_id"))
    h = e.groupBy(F.col("user_id").alias("artifact_id")).agg(F.array_sort(F.collect_list(one)).alias("events")).select("artifact_id", F.concat(F.lit("i/"), "artifact_id").alias("source_locator"), F.lit("o/n").alias("repository_full_name"), F.col("artifact_id").alias("issue_number"), "events")
    return payloads.event_facts(h, "r").select("artifact_id", "fact_index", "locator", "normalized_value")


@query
def family_counts(spark, d):
    """Facts of commits and of paths by extractor family."""
    paths = extract.path_facts(L.artifacts(spark, d)).select("extractor_name")
    return payloads.family_counts(payloads.commit_facts(_commits(spark, d), "r").select("extractor_name").unionByName(paths))


def _results(spark, d):
    """Orders as requirements of their customer's case; urgent ones are recovered, those of no priority can't be checked."""
    o = L.table(spark, d, "orders")
    none = F.array().cast("array<string>")
    key = F.col("o_orderkey").cast("string")
    done = F.col("o_orderpriority") < "3"
    rows = o.where("o_orderkey % 8 <> 0").select(
        (F.col("o_custkey") % 50).cast("string").alias("case_id"), key.alias("requirement_id"), F.when(done, "recovered").otherwise("gap").alias("status"), F.when(~done, F.col("o_orderpriority")).alias("needed_capability"),
        F.when(done, F.array(F.concat(F.lit("a:"), key))).otherwise(none).alias("matched_locators"), F.when(~done, F.array(F.lit("f"), F.lit("g"))).otherwise(none).alias("missing"),
    )
    return reports.with_unsupported(rows, o.where("o_orderkey % 8 = 0").select((F.col("o_custkey") % 50).cast("string").alias("case_id"), key.alias("requirement_id"), F.lit("other").alias("needed_capability")))


@query
def report_lines(spark, d):
    return reports.report_lines(_results(spark, d)).select("section", "key", "at", "line")


@query
def report_cases(spark, d):
    return reports.case_summaries(_results(spark, d))


@query
def readiness_counts(spark, d):
    return governance.outcome_counts(readiness_outcome(spark, d))


@query
def watchlist_candidates(spark, d):
    """Customers as watchlist entries; some are mapped to a source."""
    c = L.table(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.col("c_name").alias("repository"))
    return governance.watchlist_candidates(c, c.where("position % 3 = 0").select("repository", F.concat(F.lit(" s"), "position").alias("source_id")))


@query
def elapsed_seconds(spark, d):
    """Seconds from an order to the shipping of its items; moments that can't be read give none."""
    li, o = L.table(spark, d, "lineitem"), L.table(spark, d, "orders")
    met = li.join(o, li.l_orderkey == o.o_orderkey).select("l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon").alias("a"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"))
    return met.withColumn("s", C.elapsed_seconds("a", "b")).groupBy("l_returnflag").agg(F.sum("s").alias("seconds"), F.count("s").alias("n"))


@query
def policy_faults(spark, d):
    """Orders as proposals, policy rules and supports, with faults of every kind."""
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey")
    when = lambda n, r, v, other=F.lit("x"): F.when(k % n == r, v).otherwise(other)
    p = o.select(k.cast("string").alias("proposal_id"), F.lit("s").alias("subject_id"), when(7, 1, F.lit(" ")).alias("source_id"), F.lit("t").alias("target"), when(11, 2, F.lit(None)).alias("rationale"), F.lit("r").alias("actor_role"))
    none, one = F.array().cast("array<string>"), F.array(F.lit("a"))
    r = o.select(
        k.cast("string").alias("rule_id"), when(3, 0, F.lit("require_role"), F.lit("prohibit")).alias("effect"), when(5, 1, F.array(F.lit("pin"), F.lit("pin")), when(5, 2, none, one)).alias("action_types"), F.lit("why").alias("rationale"),
        (k % 4).alias("n_supports"), when(2, 0, one, none).alias("allowed_actor_roles"),
    )
    kind = F.when(k % 3 == 0, "EvidenceFact").when(k % 3 == 1, "SourceAssertion").otherwise("Observation")
    s = o.select(k.cast("string").alias("support_id"), kind.alias("support_type"), F.when(k % 2 == 0, "v").alias("expected_value"), F.when(k % 5 == 0, F.array(F.lit(" "))).when(k % 5 == 1, one).otherwise(none).alias("fragments"))
    of = lambda df, what: df.withColumn("what", F.lit(what))
    return of(governance.proposal_faults(p), "proposal").unionByName(of(governance.rule_faults(r), "rule")).unionByName(of(governance.support_faults(s), "support")).groupBy("what", "fault").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("first"))


@query
def comparison_pair_faults(spark, d):
    """Consecutive orders as captures; sources are customers or, for some, priorities; some are dated the other way round."""
    o = L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = W.partitionBy((F.col("o_orderkey") % 50).alias("k")).orderBy("o_orderkey")
    pairs = o.select(
        F.col("o_orderkey").alias("pair_id"), (F.lag("o_custkey").over(w) % 3).alias("previous_source_id"), (F.col("o_custkey") % 3).alias("current_source_id"), F.lag("o_orderdate").over(w).alias("previous_observed_at"),
        F.col("o_orderdate").alias("current_observed_at"), F.lag("o_orderkey").over(w).alias("previous_captured_at"), F.when(F.col("o_orderkey") % 8 == 0, 0).otherwise(F.col("o_orderkey")).alias("current_captured_at"),
    ).where("previous_captured_at is not null")
    return comparison.pair_faults(pairs)


@query
def comparison_run_faults(spark, d):
    """Pairs of extraction runs of which some are unknown, of another type, unfinished, without digest or of another generation."""
    s = L.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    runs = s.where("s_suppkey % 13 <> 0").select(
        key.alias("run_id"), F.when(key % 11 == 0, "capture").otherwise("extraction").alias("run_type"), F.when(key % 7 != 0, F.lit("2026-01-01")).alias("finished_at"), F.when(key % 5 != 0, F.lit("x")).alias("outputs_hash"),
        (key % 2).cast("string").alias("code_version"), F.lit("1").alias("contract_schema_version"), F.when(key % 3 != 0, F.lit("p")).alias("policy_version"),
    )
    pairs = s.select(key.alias("pair_id"), key.alias("previous_run_id"), (key + 1 + key % 2).alias("current_run_id"))
    return comparison.run_faults(pairs, runs)


@query
def generation_faults(spark, d):
    """Line items as interval summaries: order and part size class have one each, or they are listed."""
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("interval_id"), (F.col("l_partkey") % 4).cast("string").alias("policy_version"))
    return comparison.generation_faults(li, ["interval_id"], ["policy_version"])


def _outputs(spark, d, changed: bool):
    a = L.artifacts(spark, d).withColumn("run_id", F.split("source_locator", "/")[0])
    value = F.col("normalized_value")
    if changed:
        value = F.when((F.col("artifact_id") % 97 == 0) & (F.col("run_id") == "src3"), F.concat(value, F.lit("!"))).otherwise(value)
    facts = extract.path_facts(a).withColumn("run_id", F.split("source_locator", "/")[0]).withColumn("evidence_id", F.col("locator")).withColumn("normalized_value", value)
    said = a.where("text is not null").select("run_id", F.col("source_locator").alias("assertion_id"), "artifact_id", F.col("source_locator").alias("locator"), F.substring("text", 1, 20).alias("statement"), F.lit("t").alias("extractor_name"), F.lit("1").alias("extractor_version"))
    return {"facts": facts, "assertions": said if not changed else said.where("not (run_id = 'src5' and artifact_id % 50 = 5)")}


@query
def tampered_runs(spark, d):
    """Runs whose stored facts or assertions were changed after their digest was recorded."""
    recorded = comparison.outputs_digest(_outputs(spark, d, False)).select("run_id", "outputs_hash")
    return comparison.tampered_runs(recorded, _outputs(spark, d, True)).select("run_id")


@query
def interval_summaries(spark, d):
    """Customers as intervals, their orders as summaries by priority: customers without any are listed too."""
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("interval_id"), F.col("o_orderpriority").alias("policy_version"))
    return comparison.generation_faults(o, ["interval_id"], ["policy_version"], L.table(spark, d, "customer").select(F.col("c_custkey").alias("interval_id")))


#: Planted breaks of the chain query: stage and condition on the customer.
_BREAKS = {"rows": ("change", "id % 11 = 3"), "params": ("plan", "id % 13 = 5"), "signed anew": ("segment", "id % 17 = 7"), "unknown": ("capture", "id % 19 = 4")}


@query
def envelope_chain(spark, d):
    """Customers as intervals with a run for each stage, their orders as the runs' outputs; breaks of four kinds are planted at four stages.

    Stored rows of `change` are altered, parameters of `plan` differ from those signed, outputs of `segment` are altered and signed anew, and captures have no record. Each interval
    is told with the first broken stage under its reduction.
    """
    stages = list(envelopes.STAGES)
    ids = L.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    runs = ids.select("id", F.explode(F.array(*map(F.lit, stages))).alias("stage")).select("id", F.concat_ws(":", "id", "stage").alias("run_id"), "stage", F.lit("1").alias("policy_version"), F.lit("{}").alias("params"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, read in envelopes.STAGES.items() for b in read)))
    reads = ids.select("id", pairs.alias("p")).select(F.concat_ws(":", "id", "p.a").alias("run_id"), F.col("p.b").alias("role"), F.concat_ws(":", "id", "p.b").alias("parent_id"))
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderpriority", F.element_at(F.array(*map(F.lit, stages)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("stage"))
    rows = o.withColumn("run_id", F.concat_ws(":", "id", "stage"))
    at = lambda what: (F.col("stage") == _BREAKS[what][0]) & F.expr(_BREAKS[what][1])
    stored = rows.withColumn("o_orderpriority", F.when(at("rows") | at("signed anew"), F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")))
    digests = lambda df: tables.written(envelopes.outputs_of({"rows": (df, ("o_orderkey", "o_orderpriority"))}))
    before, after = digests(rows), digests(stored)
    recorded = envelopes.signed(runs.join(before, "run_id", "left").fillna(envelopes.EMPTY, ["outputs_hash"]), reads)
    anew = after.select("run_id", F.col("outputs_hash").alias("anew"))
    found = (
        recorded.join(anew, "run_id", "left").withColumn("outputs_hash", F.when(at("signed anew"), F.coalesce("anew", "outputs_hash")).otherwise(F.col("outputs_hash")))
        .withColumn("params", F.when(at("params"), F.lit('{"limit":1}')).otherwise(F.col("params"))).where(~at("unknown")).drop("anew")
    )
    faults = envelopes.chain_faults(tables.written(found), reads, after)
    return faults.where("stage = 'reduce'").select(F.split("run_id", ":")[0].cast("long").alias("interval_id"), "fault", "first_stage", "first_fault")


def _ledger(spark, d):
    """A new ledger with the orders as facts of fifty runs."""
    o = L.table(spark, d, "orders")
    value = F.to_json(F.struct(F.col("o_orderpriority").alias("p")))
    rows = o.select(
        F.concat(F.lit("fact:"), "o_orderkey").alias("evidence_id"), F.concat(F.lit("c"), "o_custkey").alias("artifact_id"), F.concat(F.lit("orders/"), "o_orderkey", F.lit("#p")).alias("locator"), value.alias("raw_value"),
        value.alias("normalized_value"), F.lit("orders").alias("extractor_name"), F.lit("1").alias("extractor_version"), F.concat(F.lit("run-"), F.col("o_custkey") % 50).alias("run_id"), F.lit("1").alias("schema_version"),
    )
    ledger = tables.Ledger(spark, f"{tables.shared_folder(spark)}/ledger-{uuid.uuid4().hex}", buckets=16)
    ledger.append({"EvidenceFact": rows})
    return ledger


@query
def ledger_lookup(spark, d):
    """Facts of the orders that have a returned line item, by their keys."""
    ids = L.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("fact:"), "l_orderkey").alias("evidence_id"))
    return _ledger(spark, d).get("EvidenceFact", ids).select("evidence_id", "run_id", "normalized_value")


@query
def ledger_point(spark, d):
    """Facts of the three dearest orders: buckets by folder, keys in the files."""
    ids = L.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.concat(F.lit("fact:"), "o_orderkey").alias("evidence_id"))
    return _ledger(spark, d).get("EvidenceFact", ids).select("evidence_id", "run_id", "normalized_value")


@query
def ledger_run(spark, d):
    """Facts that one run made."""
    return _ledger(spark, d).of_run("EvidenceFact", "run-7").select("evidence_id", "artifact_id", "normalized_value")


@query
def strict_pair_faults(spark, d):
    """Suppliers as extraction runs; those with customers of their nation in debt have diagnostics, some were made under a tolerant policy."""
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, "tolerant").otherwise("strict").alias("policy_version"))
    debt = L.table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey"))
    diagnostics = s.join(debt, "s_nationkey").select("run_id")
    pairs = s.select(F.col("run_id").alias("pair_id"), F.col("run_id").alias("previous_run_id"), (F.col("run_id") + 1).alias("current_run_id"))
    return comparison.strict_faults(pairs, diagnostics, s, "strict")


@query
def foreign_evidence(spark, d):
    """Line items as evidence of their part's artifact, in captures by supplier; parts of some sizes weren't captured."""
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 5).alias("capture_id"), F.col("l_partkey").alias("artifact_id"))
    p = L.table(spark, d, "part").select((F.col("p_partkey") % 5).alias("capture_id"), F.col("p_partkey").alias("artifact_id"), F.when(F.col("p_size") == 7, "missing").otherwise("captured").alias("retrieval_status"))
    return comparison.foreign_evidence(li, p)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}
