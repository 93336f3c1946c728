"""Operators on small fixtures: rules, faults and edge cases."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sedimark import schemas
from sedimark.functions import columns as C
from sedimark.operators import capture, delta, extract, governance, guards, inspect, planning, reasoning
from sedimark.sources import provider, tables
from sedimark.streaming import ingest


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression).first()[0]


@pytest.mark.parametrize(
    "path, surface",
    [
        (".github/workflows/ci.yml", "WORKFLOW"), ("a/yarn.lock", "LOCKFILE"), ("requirements-dev.txt", "MANIFEST"), ("vendor/x.py", "VENDORED"), ("a/gen/x.ts", "GENERATED"), ("a.min.js", "GENERATED"),
        ("tests/data.bin", "TEST"), ("src/x.spec.ts", "TEST"), ("docs/x.py", "DOCS"), ("README", "DOCS"), ("Dockerfile", "CONFIG"), ("a/b.YAML", "CONFIG"), ("a/b.rs", "SOURCE"), ("bin/tool", "UNKNOWN"),
        ("third_party/package.json", "MANIFEST"), ("a/.json", "UNKNOWN"), ("x", "UNKNOWN"),
    ],
)
def test_surfaces(spark, path, surface):
    assert one(spark, C.change_surface("p"), p=path) == surface


def test_paths(spark):
    got = spark.createDataFrame([("a/b.tar.gz",), ("a/.env",), ("a/b.",), (" x/é.MD",), ("/a",), ("a//b",), ("a/../b",), ("",), ("a\0b",)], "p string").select(C.suffix("p").alias("s"), C.safe_path("p").alias("ok"), C.media_type("p").alias("m")).collect()
    assert [x.s for x in got[:4]] == [".gz", "", "", ".md"]
    assert [x.ok for x in got] == [True, True, True, True, False, False, False, False, False]
    assert got[3].m == "text/markdown" and got[0].m == "application/octet-stream"
    assert one(spark, C.path_group("p"), p='a"b/c') == 'top-level:"a\\"b"'
    assert one(spark, C.repository_name("p"), p=" https://host.example/owner/name.git/ ") == "owner/name"
    assert one(spark, C.repository_name("p"), p="nothing here") is None
    assert one(spark, C.utc("p"), p="2020-01-01T02:00:00+02:00") == "2020-01-01T00:00:00Z"
    assert one(spark, C.pointer_unescape(C.pointer_escape("p")), p="a/b~1c") == "a/b~1c"


def test_identities_mark_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "x string, y string")
    assert len({r[0] for r in df.select(C.identity("k", "x", "y")).collect()}) == 3


def artifact(spark, text, path="a.md"):
    return spark.createDataFrame([("1", path, text)], "artifact_id string, source_locator string, text string")


def test_markdown(spark):
    text = "# T\nfirst line\nsecond\n\n> q\n| a | b |\n---|---\nthird\n```\ncode\n~~~\nafter\n- item one\n  more\n\n\t* tab item\n      deep\n  out\n1) num\r\ntail"
    prose = sorted((r.locator, r.statement) for r in extract.markdown_paragraphs(artifact(spark, text)).collect())
    assert prose == [("a.md:L12-L12", "after"), ("a.md:L14-L14", "more"), ("a.md:L17-L18", "deep out"), ("a.md:L2-L3", "first line second"), ("a.md:L20-L20", "tail"), ("a.md:L8-L8", "third")]
    items = sorted((r.locator, r.statement) for r in extract.markdown_list_items(artifact(spark, text)).collect())
    assert items == [("a.md:L13-L14", "item one more"), ("a.md:L16-L17", "tab item deep"), ("a.md:L19-L19", "num")]
    assert extract.markdown_paragraphs(artifact(spark, None)).count() == 0


def facts(spark, text, path, extractors):
    return [(r.kind, r.locator[len(path) :], r.normalized if r.kind == "fact" else r.value) for r in extract.parsed(artifact(spark, text, path), extractors).collect()]


def test_json_pointers(spark):
    got = facts(spark, '{"b": [1, {"x/y": null}], "a~": "s", "e": {}, "f": []}', "d.json", (extract.JSON,))
    assert got == [("fact", "#/a~0", '"s"'), ("fact", "#/b/0", "1"), ("fact", "#/b/1/x~1y", "null")]
    assert facts(spark, "7", "d.json", (extract.JSON,)) == [("fact", "#", "7")]
    for bad in ("{", "NaN", '{"a": Infinity}'):
        assert facts(spark, bad, "d.json", (extract.JSON,))[0][0] == "diagnostic"


def test_manifests(spark):
    got = dict((a, b) for _, a, b in facts(spark, '{"name": " n ", "version": 3, "engines": {"node": ">1", "x": 1}, "scripts": {"b": "1", "a": "2"}}', "p/package.json", extract.DEFAULT))
    assert got == {"#$manifest.kind": '"package.json"', "#name": '"n"', "#engines": '{"node":">1"}', "#scripts": '["a","b"]'}
    got = dict((a, b) for _, a, b in facts(spark, '[project]\nname="n"\ndependencies=["b"," a","b"]\n[project.optional-dependencies]\nx=["q"]\n', "pyproject.toml", extract.DEFAULT))
    assert got["#project.dependencies"] == '["a","b"]' and got["#project.optional-dependencies.x"] == '["q"]'
    assert facts(spark, "[", "pyproject.toml", extract.DEFAULT)[0][0] == "diagnostic"


def test_python_facts(spark):
    text = '"""doc"""\nclass A(B):\n    """inner"""\n    def f(self, x, *, y=1):\n        z: int = g(x, k=1, **q)\n        try:\n            assert z, "m"\n        except E:\n            a.b().c[0](1)\n'
    got = facts(spark, text, "m.py", extract.PYTHON)
    said = [v for k, _, v in got if k == "assertion"]
    found = [(json.loads(v)["kind"], json.loads(v)) for k, _, v in got if k == "fact"]
    assert said == ["doc", "inner"]
    assert [k for k, _ in found] == ["class", "function", "assignment", "call", "try", "assert", "call", "call"]
    by = {k: v for k, v in reversed(found)}
    assert by["function"]["qualified_name"] == "A.f" and by["function"]["parameters"] == ["self", "x", "y"]
    assert by["assignment"]["value_call_keywords"] == {"k": "1"} and by["call"]["starred_keywords"] == ["q"]
    assert found[-2][1]["callee"] == "a.b().c[]" and by["try"]["handlers"] == ["E"]
    assert facts(spark, "def (", "m.py", extract.PYTHON)[0][0] == "diagnostic"


def test_typescript_lexer(spark):
    text = '/* a\n * b */\ntype T = string\ninterface I {}\nconst s = "if (x) f()"\nif (s) { throw new E(s) } // tail'
    got = facts(spark, text, "m.ts", extract.TYPESCRIPT)
    assert [v for k, _, v in got if k == "assertion"] == ["a b", "tail"]
    assert [json.loads(v)["kind"] for k, _, v in got if k == "fact"] == ["type_alias", "interface", "declaration", "if", "throw"]  # a constructor isn't called


def test_inspection(spark):
    a = artifact(spark, "l1\nlé2x\nl3")
    e = spark.createDataFrame([("1", "a.md:L2-L3"), ("1", "a.md:L9-L9"), ("1", "a.md#$path.basename"), ("1", "b.md:L1-L1"), ("2", "a.md:L1-L1")], "artifact_id string, locator string").withColumn("run_id", F.lit("r"))
    got = {(r.artifact_id, r.locator): r.excerpt for r in inspect.resolved(e, a).collect()}
    assert got["1", "a.md:L2-L3"] == "lé2x\nl3" and got["1", "a.md:L9-L9"] is None and got["1", "a.md#$path.basename"] == "a.md"
    runs = spark.createDataFrame([("r", "extraction", datetime.now(timezone.utc))], "run_id string, run_type string, finished_at timestamp")
    assert {(r.locator, r.fault) for r in inspect.audit(e, runs, a).collect()} == {("a.md:L9-L9", "place"), ("b.md:L1-L1", "place"), ("a.md:L1-L1", "artifact")}
    r = spark.createDataFrame([("1", "a.md:L2:C1-L2:C3#x"), ("1", "a.md:L2:C1-L2:C2#x")], "artifact_id string, locator string")
    assert {x.locator: x.excerpt for x in inspect.ranges(r, a).collect()} == {"a.md:L2:C1-L2:C3#x": "é", "a.md:L2:C1-L2:C2#x": None}
    made = {"entries": [{"path": "a/b", "mode": "1"}], "jobs": [{"id": 5, "steps": [{"number": 2, "name": "n"}]}]}
    assert inspect.resolve_pointer(made, "/entries/a~1b/mode") == "1" and inspect.resolve_pointer(made, "/jobs/5/steps/2/name") == "n"
    assert inspect.resolve_pointer(made, "/entry_count") == made["entries"]


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in guards.set_difference(a, b, "k").collect()} == {(1, "left"), (3, "right")}
    assert {(r.k, r.n) for r in guards.not_exactly_once(a, b, "k").collect()} == {(1, 0), (3, 1)}
    with pytest.raises(guards.GuardError, match=r"\+4 more"):
        guards.require_empty(spark.range(9), "too many")
    guards.require_empty(spark.range(0), "nothing")
    assert guards.over_ceiling(a, "k", 1).first().k == 2
    assert guards.mixed_generation(spark.createDataFrame([(1, None), (1, "x")], "k int, f string"), spark.createDataFrame([(1, None)], "k int, f string"), "k", ["f"]).count() == 1


def source(spark, last="2020-01-02"):
    return spark.createDataFrame([("s", "github_repository", "mixed", "h/o/n", datetime(2020, 1, 1), datetime.fromisoformat(last), "1")], schemas.schema("Source"))


def test_contracts(spark):
    assert len(schemas.KEYS) >= 35 and schemas.violations(source(spark), "Source").count() == 0
    bad = source(spark, "2019-01-01").withColumn("source_kind", F.lit("other")).withColumn("source_id", F.lit(" s"))
    assert {r.violation for r in schemas.violations(bad, "Source").collect()} == {"source_kind", "source_id", "last_seen_at not before first_seen_at"}
    with pytest.raises(KeyError):
        schemas.schema("Nothing")
    for name in schemas.KEYS:
        assert schemas.violations(spark.createDataFrame([], schemas.schema(name)), name).count() == 0


def test_ledger(spark, tmp_path):
    ledger = tables.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.append({"Source": source(spark)}) == 1 and ledger.append({"Source": source(spark)}) == 0
    with pytest.raises(guards.GuardError, match="same key"):
        ledger.append({"Source": source(spark, "2021-01-01")})
    with pytest.raises(guards.GuardError, match="contract"):
        ledger.append({"Source": source(spark, "2019-01-01").withColumn("source_id", F.lit("t"))})
    assert [r.source_id for r in ledger.read("Source").collect()] == ["s"]
    assert ledger.get("Source", spark.createDataFrame([("s",)], "source_id string")).count() == 1


def test_object_store(spark, tmp_path):
    store = tables.ObjectStore(spark, str(tmp_path / "objects"))
    data = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "data binary")
    store.put(data)
    store.put(data)
    assert store.rows().count() == 2
    refs = data.select(C.digest("data").alias("content_hash")).distinct()
    assert store.get(refs).count() == 2 and store.exists(refs).count() == 2
    spark.createDataFrame([("sha256:" + "0" * 64, b"z")], "content_hash string, data binary").write.mode("append").parquet(store.path)
    with pytest.raises(Exception, match="corrupt"):
        store.get(spark.createDataFrame([("sha256:" + "0" * 64,)], "content_hash string")).collect()


def test_streaming_ingestion(spark, tmp_path):
    ledger = tables.Ledger(spark, str(tmp_path / "ledger"))
    rows = ledger.payloads(source(spark), "Source")
    rows.write.mode("append").json(str(tmp_path / "landing"))
    run = lambda: ingest.into_ledger(ingest.landed(spark, str(tmp_path / "landing")), ledger, str(tmp_path / "conflicts"), str(tmp_path / "check")).awaitTermination()
    run()
    rows.write.mode("append").json(str(tmp_path / "landing"))
    ledger.payloads(source(spark, "2022-01-01"), "Source").write.mode("append").json(str(tmp_path / "landing"))
    run()
    assert ledger.rows().count() == 1 and spark.read.json(str(tmp_path / "conflicts")).count() >= 1


def test_structural_determinism(spark):
    f = spark.createDataFrame([("a.md", "a.md#x", "1")], "source_locator string, locator string, normalized_value string").withColumn("extractor_name", F.lit("e")).withColumn("extractor_version", F.lit("1"))
    g = f.withColumn("normalized_value", F.lit("2"))
    none = spark.createDataFrame([], "source_locator string, artifact_delta_id string, change_type string")
    assert delta.unexplained_structure(f, g, none).count() == 1 and delta.unexplained_structure(f, f, none).count() == 0


def test_first_parent_chain(spark):
    rows = [("r", k, k - 1 if k else None) for k in range(300)] + [("c", 1, 2), ("c", 2, 1)]
    got = planning.first_parent_chain(spark.createDataFrame(rows, "b string, n int, p int"), "b", "n", "p").collect()
    assert all(r.place == r.n for r in got if r.b == "r") and all(r.place is None for r in got if r.b == "c")


def test_commit_ranges(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "commit_sha string, ordinal int")
    assert planning.range_faults(c, "b", 2).count() == 0
    assert {r.fault for r in planning.range_faults(c.union(c), "a", 2).collect()} == {"not as many as declared", "repeated commits", "doesn't end at the head"}


def test_as_of(spark):
    t = spark.createDataFrame([("u", 10, "a"), ("u", 20, "b"), ("v", 5, "c")], "k string, at int, x string")
    f = spark.createDataFrame([("u", 9, 1), ("u", 10, 2), ("u", 25, 3), ("w", 9, 4)], "k string, t int, id int")
    assert {r.id: r.x for r in governance.as_of(f, t, "k", "t", "at", "x").collect()} == {1: None, 2: "a", 3: "b", 4: None}
    assert governance.timeline_ties(t.union(t), "k", "at").count() == 3


def test_closures(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "c string, p string")
    closed = reasoning.closure(e, "c", "p")
    assert {(r.child, r.ancestor): r.distance for r in closed.collect() if r.child == "a"} == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}
    assert {r.child for r in reasoning.cycles(closed).collect()} == {"x", "y"}


def test_capture(spark):
    asked = spark.createDataFrame([("c", "a.md"), ("c", "b.md"), ("c", "a.md")], "capture_id string, path string")
    got = spark.createDataFrame([("c", "a.md", b"x")], "capture_id string, path string, data binary")
    refs = capture.capture_refs(capture.requested_paths(asked), got)
    assert {(r.source_locator, r.retrieval_status, r.data) for r in refs.collect()} == {("a.md", "captured", b"x"), ("b.md", "missing", None)}
    with pytest.raises(Exception, match="unsafe"):
        capture.requested_paths(asked.withColumn("path", F.lit("../x"))).collect()
    tree = "tree_sha string, body struct<sha string, truncated boolean, tree array<struct<path string, mode string, type string, sha string, size bigint>>>"
    ok = ("t", ("t", False, [(" a", "1", "blob", "0" * 40, 1)]))
    assert capture.tree_entries(spark.createDataFrame([ok], tree)).first().path == " a"
    for bad in (("t", ("t", True, [])), ("t", ("u", False, [])), ("t", ("t", False, [("a", "1", "blob", "x", 1)]))):
        with pytest.raises(Exception, match="tree isn't whole|bad entry"):
            capture.tree_entries(spark.createDataFrame([bad], tree)).collect()


def test_provider(spark, tmp_path):
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "1.json").write_text('{"status_code": 200, "body": {"content": "aGVs\\nbG8="}}')
    got = provider.file_bytes(provider.payloads(spark, str(tmp_path), "file", "content string").select("body.content")).first()
    assert bytes(got.data) == b"hello"
    (tmp_path / "w.json").write_text('{"repositories": [{"repository": " o/n ", "revision": null}, {"repository": "p/q"}]}')
    assert [tuple(r) for r in provider.watchlist(spark, str(tmp_path / "w.json")).collect()] == [(1, "o/n", None), (2, "p/q", None)]
    (tmp_path / "w.json").write_text('{"repositories": [{"repository": "a"}, {"repository": "a"}]}')
    with pytest.raises(ValueError):
        provider.watchlist(spark, str(tmp_path / "w.json"))
    pages = spark.createDataFrame([("a", 1, 100), ("a", 2, 3), ("b", 1, 100), ("c", 1, 100), ("c", 3, 1)], "k string, page int, n_items int")
    assert {r.k for r in provider.paginated_faults(pages, "k", 100).collect()} == {"b", "c"}
    codes = spark.createDataFrame([(302,), (404,)], "c int").select(provider.log_availability(F.col("c")).alias("a")).collect()
    assert [r.a for r in codes] == ["available", "missing"]


def test_rules(spark):
    s = spark.createDataFrame([("r", "e1", "v", ["v"]), ("r", "e2", None, ["zz"]), ("r", "e9", None, [])], "rule_id string, evidence_id string, expected_value string, fragments array<string>")
    f = spark.createDataFrame([("e1", "v"), ("e2", "abc")], "evidence_id string, normalized_value string")
    assert {r.evidence_id for r in governance.unsupported_rules(s, f).collect()} == {"e2", "e9"}
    t = spark.createDataFrame([(["a", "b"], ["a"], True, True, False), (["a"], ["a", "c"], False, False, True), (["a"], ["a"], True, True, True)], "entries array<string>, required array<string>, exact boolean, whole boolean, truncated boolean")
    assert [r.holds for r in reasoning.tree_check(t).collect()] == [False, False, False]
    answers = spark.createDataFrame([("p", ["a", "b", "a"])], "packet_id string, cited array<string>")
    got = reasoning.normalized_packets(answers, spark.createDataFrame([("p", "a")], "packet_id string, support_id string")).first()
    assert (got.supports, got.rejected) == (["a"], ["b"])


def test_fragments_anywhere(spark):
    texts = ["xone two\n three  FOUR five six sevenx and more", "one two three four five seven", "short one", None, "", "a b c d e f g", "a b c d e f g"]
    asked = [(1, "One two three four five six seven"), (2, "one two three four five six eight"), (3, "ort on"), (4, "none"), (5, ""), (6, None), (7, "b c d e f g"), (8, "two four three five six seven"), (9, "e two three four five six s")]
    got = reasoning.fragment_hits_anywhere(spark.createDataFrame(asked, "requirement_id long, fragment string"), spark.createDataFrame([(t,) for t in texts], "statement string"))
    fold = lambda t: " ".join(t.lower().split())
    want = {i: f is not None and any(fold(f) in fold(t) for t in texts if t is not None) for i, f in asked}
    assert {r.requirement_id: r.covered for r in got.collect()} == want and sum(want.values()) == 5


def test_coverage_of_whole_items(spark, tmp_path):
    """An item stands in a document of whatever id, and its first words alone don't cover it."""
    from sedimark.plans import registry

    item = lambda k: " ".join(f"i{k}w{j}" for j in range(20))
    spark.createDataFrame([(k, item(k)) for k in range(6)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(k + 7, f"before {item(k)} after") for k in range(3)] + [(k, f"i{k}w0 i{k}w1 i{k}w2 and nothing else") for k in range(3, 6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.needed_capability: (r.n_required, r.n_covered) for r in registry.queries()["coverage_fraction"](spark, str(tmp_path)).collect()}
    assert got == {"total": (6, 3), "tree": (3, 2), "ast": (3, 1)}
    assert {r.needed_capability: r.n_gaps for r in registry.queries()["coverage_gaps"](spark, str(tmp_path)).collect()} == {"tree": 1, "ast": 2}


def test_extraction_runs(spark):
    from sedimark.plans import pipelines

    rows = [("1", "c", "a.md", "# h\nsome prose"), ("2", "c", "package.json", "{"), ("3", "c", "p/pyproject.toml", '[project]\nname = "x"\n')]
    artifacts = spark.createDataFrame(rows, "artifact_id string, capture_id string, source_locator string, text string")
    with pytest.raises(guards.GuardError, match="can't be read"):
        pipelines.strict_extraction(artifacts, "r")
    done = pipelines.strict_extraction(artifacts.where("artifact_id <> '2'"), "r")
    assert done.facts.count() == 8 + 2 and done.assertions.count() == 1
    assert done.recorded_facts().select("evidence_id").distinct().count() == 10 and [r.assertion_index for r in done.recorded_assertions().collect()] == [1]
    _, _, gaps = pipelines.gap_tolerant_pair(artifacts, artifacts.where("artifact_id <> '2'"), "r")
    assert [tuple(r) for r in gaps.collect()] == [("package.json", "previous", "package-json")]


def test_process_payloads(spark):
    rows = spark.createDataFrame([("a", 7, None, ["b", "a", "b"], " t ", None)], "artifact_id string, number int, state_reason string, labels array<string>, title string, body string")
    got = {r.locator: r.normalized_value for r in capture.process_facts(rows).collect()}
    assert got == {"$github/process#/number": "7", "$github/process#/state_reason": "null", "$github/process#/labels": '["a","b"]'}
    assert [r.statement for r in capture.process_assertions(rows).collect()] == ["t"]
    runs = spark.createDataFrame([("a", 1, "x")], "artifact_id string, id int, head_sha string")
    assert capture.run_facts(runs, spark.createDataFrame([("a", "x")], "artifact_id string, commit_sha string")).count() == 2
    with pytest.raises(Exception, match="another commit"):
        capture.run_facts(runs, spark.createDataFrame([("a", "y")], "artifact_id string, commit_sha string")).collect()
    events = spark.createDataFrame([("i", [(2, "2020-01-01T00:00:00Z"), (1, "2020-01-01T01:00:00+01:00")])], "issue_id string, events array<struct<id int, created_at string>>")
    assert [e.id for e in capture.ordered_events(events).first().events] == [1, 2]
