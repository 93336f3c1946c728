"""Structural selectors, fragments over assertions, paged collections and merged identities."""

import json

import pytest
from pyspark.sql import functions as F

from sedimark.operators import extract, identity, pages, selectors
from sedimark.sources import provider

MODULE = '''"""Doc."""
import x

LIMIT = Config(size=3, name='n')

class A:
    def f(self):
        """Said."""
        with open('p') as h:
            call(one, " Two  words ", key=x.y)
            assert h and  LIMIT
        def g():
            return call(inner, key=1)
        return g

async def top(a, *, b): other()
'''


def modules(spark):
    return spark.createDataFrame([("1", "a.py", MODULE), ("2", "b.py", "def broken(:"), ("3", "c.md", "x"), ("4", "d.py", None)], "artifact_id string, source_locator string, text string")


def test_nodes_are_nested_as_in_the_text(spark):
    rows = extract.python_nodes(modules(spark)).collect()
    assert {r.source_locator for r in rows} == {"a.py"} and len({r.pre for r in rows}) == len(rows)
    at = {(r.kind, r.name): r for r in rows}
    inside = lambda a, b: at[b].pre < at[a].pre and at[a].post < at[b].post
    assert inside(("function", "A.f"), ("class", "A")) and inside(("function", "A.f.g"), ("function", "A.f")) and not inside(("function", "top"), ("class", "A")) and not inside(("class", "A"), ("function", "A.f"))
    facts = extract.facts_of(extract.parsed(modules(spark), extract.PYTHON)).where("extractor_name = 'python-ast'")
    assert {r.locator for r in facts.collect()} == {r.locator for r in rows}


def test_python_selectors(spark):
    row = lambda r, k, kind, scope=None, name=None, args=None, kw=None, call=None, contains=None, inside=None: (r, k, "a.py", kind, scope, name, args, kw, call, contains, inside)
    asked = [
        row("all", 1, "function", name="A.f.g"), row("all", 2, "call", "A.f", "call", ["two words", "ONE"], {"key": "x.y"}), row("all", 3, "assignment", "<module>", "LIMIT", kw={"size": "3"}, call="Config"),
        row("all", 4, "assert", "A.f", contains="H and limit"), row("all", 5, "call", "A.f.g", "call", ["inner"], inside="A"), row("all", 6, "call", "top", "other", kw={"key": "None"}),
        row("none", 1, "call", "A.f", "call", ["three"]), row("none", 2, "call", "top", "other", inside="A"), row("none", 3, "assignment", "<module>", "LIMIT", kw={"size": "4"}, call="Config"), row("none", 4, "function", name="g"),
        row("none", 5, "function", name="top"),
    ]
    got = {r.requirement_id: r for r in selectors.assessed(selectors.python_matches(extract.python_nodes(modules(spark)), spark.createDataFrame(asked, selectors.SELECTOR))).collect()}
    assert got["all"].status == "recovered" and len(got["all"].matched_locators) == 6 and got["all"].matched_locators[0].endswith("#python/function")
    assert got["none"].status == "gap" and got["none"].missing == ["call:A.f:call", "call:top:other", "assignment:<module>:LIMIT:Config", "function:g"] and got["none"].matched_locators == []


def test_bundle_selectors(spark):
    facts = spark.createDataFrame([("a.ts", "a.ts:L1", json.dumps({"kind": "call", "callee": "t.Insert", "text": "t.Insert(x)"}))], "source_locator string, locator string, normalized_value string")
    said = spark.createDataFrame([("a.ts", "Confers  nothing", "a.ts:L2")], "source_locator string, statement string, locator string")
    asked = [("r", 1, "a.ts", "call", "callee", "insert", None), ("r", 2, "a.ts", "call", "callee", None, "t.Insert"), ("r", 3, "a.ts", "comment", None, "confers nothing", None), ("s", 1, "a.ts", "call", "callee", None, "insert"), ("s", 2, "b.ts", "comment", None, "nothing", None)]
    got = {r.requirement_id: r for r in selectors.assessed(selectors.bundle_matches(facts, said, spark.createDataFrame(asked, "requirement_id string, place int, artifact string, kind string, field string, contains string, equals string"))).collect()}
    assert got["r"].status == "recovered" and got["r"].matched_locators == ["a.ts:L1", "a.ts:L2"] and got["s"].missing == ["fact:call:callee:insert", "comment:nothing"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_fragments_cross_assertions(spark, block):
    words = [f"w{k}" for k in range(40)]
    said = [(f"a:b:L{k}-L{k}", " ".join(words[k : k + 2]).upper() if k % 4 else " ", k) for k in range(0, 40, 2)] + [("z#x", "alone", 1)]
    a = spark.createDataFrame(said, "locator string, statement string, line int")
    text = " ".join(s.lower() for _, s, _ in said[:-1] if s.strip())
    fragments = ["w2 w3", "w3 w6", "w6 w7  w10 W11", "w3 w4", "7 w1", text, "w38", "w39 w2", "alone"]
    need = spark.createDataFrame([(x, f) for x in ("a:b", "a", "q", "z") for f in fragments], "artifact string, fragment string")
    got = {(r.artifact, r.fragment): r.covered for r in selectors.fragments_covered(need, a, ["line"], block).collect()}
    folded = lambda f: " ".join(f.lower().split())
    assert got == {(x, f): {"a:b": folded(f) in text, "a": folded(f) in text, "z": f == "alone", "q": False}[x] for x in ("a:b", "a", "q", "z") for f in fragments}


def test_locator_prefixes(spark):
    e = spark.createDataFrame([("a/b.md:L1-L2",), ("a/b.md",), ("a#b:L1",), ("",), (None,)], "locator string")
    got = selectors.by_prefix(e, spark.createDataFrame([("a/b.md",), ("a",), ("a#b",), ("a/b.m",)], "artifact string")).collect()
    assert {(r.locator, r.artifact) for r in got} == {("a/b.md:L1-L2", "a/b.md"), ("a#b:L1", "a"), ("a#b:L1", "a#b")}


PAGE = "request string, page int, page_size int, total long, status int, merge_base string, items array<string>"


def test_page_faults(spark):
    full, one = ["a", "b"], ["c"]
    cases = {
        "fine": ([(1, 3, 200, full), (2, 3, 200, one)], set()), "short": ([(1, None, 200, full), (2, None, 200, [])], set()), "open": ([(1, None, 200, full)], {"end not seen"}), "gap": ([(1, 5, 200, full), (3, 5, 200, one)], {"page missing", "not as many as declared"}),
        "twice": ([(1, 2, 200, full), (1, 2, 200, full)], {"page twice", "not as many as declared"}), "changed": ([(1, 3, 200, full), (2, 4, 200, one)], {"total changed"}), "null": ([(1, 3, 200, full), (2, None, 200, one)], {"total changed"}),
        "inner": ([(1, 3, 200, one), (2, 3, 200, full)], {"short page before the last"}), "bad": ([(1, 1, None, one)], {"page failed"}), "many": ([(k, 8, 200, full) for k in (1, 2, 3, 4)], {"over the ceiling"}),
    }
    rows = [(r, p, 2, t, s, None, items) for r, (all_, _) in cases.items() for p, t, s, items in all_]
    df = spark.createDataFrame(rows, PAGE)
    got = {r: set() for r in cases}
    for x in pages.page_faults(df, 3).collect():
        got[x.request].add(x.fault)
    assert got == {r: w for r, (_, w) in cases.items()}
    assert [(x.request, x.ordinal, x.item) for x in pages.assembled(df, 3).orderBy("request", "ordinal").collect()] == [("fine", 1, "a"), ("fine", 2, "b"), ("fine", 3, "c"), ("short", 1, "a"), ("short", 2, "b")]


def test_landed_pages(spark, tmp_path):
    for request, page, body in (("r1", 1, {"page_size": 2, "total": 3, "items": [{"b": 1, "a": "é"}, "x"]}), ("r1", 2, {"page_size": 2, "total": 3, "items": ["y"]}), ("r2", 1, {"page_size": 2, "items": []}), ("bad", 2, {})):
        (tmp_path / request).mkdir(exist_ok=True)
        (tmp_path / request / f"page-{page}.json").write_text(json.dumps(body))
    got = provider.landed_pages(spark, str(tmp_path), ["r1"])
    assert got.rdd.getNumPartitions() == 2  # the incomplete request isn't looked at
    assert {(r.page, r.total, tuple(r.items)) for r in got.collect()} == {(1, 3, ('{"a":"é","b":1}', "x")), (2, 3, ("y",))}
    both = provider.landed_pages(spark, str(tmp_path), ["r1", "r2", "none"])
    assert both.where("request = 'r2'").count() == 1 and both.count() == 3  # a filter stays with its query
    assert [r.item for r in pages.assembled(both).orderBy("ordinal").collect()] == ['{"a":"é","b":1}', "x", "y"]
    with pytest.raises(Exception, match="aren't complete"):
        provider.landed_pages(spark, str(tmp_path)).collect()
    (tmp_path / "r2" / "page-1.json").write_text("{")
    with pytest.raises(Exception):
        provider.landed_pages(spark, str(tmp_path), ["r2"]).collect()


def test_components_of_long_chains(spark):
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(200)] + [("hub", f"c{k:04}") for k in range(0, 200, 3)] + [("x", "y"), ("z", "z"), (None, "q")]
    got = {r.node: r.component for r in identity.components(spark.createDataFrame(chain, "a string, b string").repartition(3)).collect()}
    assert {v for k, v in got.items() if k.startswith("c") or k == "hub"} == {"c0000"} and got["y"] == "x" and got["z"] == "z" and "q" not in got


def test_merged_identities(spark):
    rows = [
        (1, "7", "o/old", None, 1), (2, "7", "o/new", ["o/Older"], 2), (3, None, "O/OLDER", None, 0), (4, None, "p/alone", None, 1), (5, "8", "q/fresh", None, 1),
        (6, "9", "t/a", ["t/b"], 1), (7, "10", "t/b", None, 1), (2, "7", "o/new", ["o/Older"], 2),
    ]
    s = spark.createDataFrame(rows, "hit_id int, provider_repository_id string, name string, aliases array<string>, observed_at int")
    known = spark.createDataFrame([("7", "s1"), ("9", "s2"), ("10", "s3")], "provider_repository_id string, source_id string")
    got = {r.hit_id: (r.state, r.source_id if r.state != "created" else "new", r.aliases) for r in identity.merged(s, known).collect()}
    same = ("resolved", "s1", ["o/old", "o/older"])
    assert got == {1: same, 2: same, 3: same, 4: ("unresolved", None, []), 5: ("created", "new", []), 6: ("conflict", None, ["t/a"]), 7: ("conflict", None, ["t/a"])}
    assert identity.shared_sources(s, known).select(F.sum("n_hits")).first()[0] == 2
