"""Nodes and references of files that patterns over text can't read."""

import time

import pytest

from graphloom.sources import braces, extract

TS = r"""import type { A } from "./a";
import React, { useState } from './react';
export { one as uno, two } from "./re";
export * from "./all";
const re = /[/"'{]}\/{/g, half = total / 2; /* { */
const text = `a ${ `in ${ call({ x: "}" }) } ner` } } {`;

/**
 * Says who.
 */
export default abstract class Shape<T extends Base<X>> extends mixin(Base)<T> implements Runs, pkg.Walks<T> {
  @observed({ deep: true }) private readonly size?: Map<string, { a: number }> = new Map();
  static count = 0;
  #hidden = 1
  name: string
  handler = async (e: Event): Promise<void> => { this.run(e); };
  constructor(private a = /}/.test("}"), b?: { c: string }) { super(a); helper(); }
  get value(): { a: number } { return compute<number>(this.size); }
  abstract area(): number;
  public static async *load<K>(this: K, ...rest: string[]): AsyncGenerator<K> { yield* other(rest) }
  overload(a: string): void;
  overload(a: any) { if (a) /x{/.exec(a); }
}

// first line
// second line
export async function run({ a, b }: Props = {}, cb = () => ({})): Promise<Map<string, () => void>> {
  const inner = (x) => deep(x);
  for (const x of list) while (x) /{/.test(x) && go(x);
  function nested() { far(); }
  return new Widget<{ a: 1 }>(`}`);
}
export const arrow = async <T,>(x: T): Promise<T> => later(x), LIMIT = 3;
let counter = 0
var { skipped, names } = require("./req");
type Fn = { (a: string): { b: number } } | ((x: 1) => void);
enum Level { Low = 1, "High" = compute2(), Mid }
declare namespace Deep { function inside(): void; const limit: number }
app.get(
  "/health/:id",
  healthHandler,
);
router.post(`/made`, maker);
export function last() { return 1; }
"""

TSX = """export const Card = ({ title, on }: Props) => {
  const [n, set] = useState<number>(0);
  if (n < 3 && n > 1) return null;
  return <div className="a {b}" onClick={() => handle({ n })}>don't { n > 1 ? <b>{label(n)}</b> : <></> } {`}`} <Icon.Big {...rest} /></div>;
};
function After() { return done(); }
"""

RUST = r"""impl Order { pub fn total(&self) -> Money { self.lines.iter().map(|l| price::<u8>(l)).sum() } }
/// A point.
/// In space.
#[derive(Debug, Clone)]
pub struct Point<'a, T: Into<f64>> { pub x: T, label: &'a str, next: Option<Box<Point<'a, T>>> }
pub(crate) struct Pair(i32, i32);
enum Kind { Plain, Named { name: String }, Tuple(u8, u8) }
pub trait Draw { const N: usize; fn draw(&self); fn twice(&self) { self.draw(); self.draw() } }
impl<'a, T> Draw for Point<'a, T> where T: Into<f64> {
    fn draw(&self) { let s = r#"fn no() { "quoted" } "#; let c = '{'; paint!(s); shapes::paint(c); }
}
impl Draw for Outside { fn draw(&self) {} }
mod admin { pub async fn check(u: &User) -> Result<Token, Error> { let t = Token { id: 1 }; match t { Token { id } => verify(id) } } }
pub const MAX: u32 = limit(1);
static mut FLAG: bool = true;
use std::{fmt, io::{self as sio, Read}};
/* outer /* fn inner() { */ still } */
struct Order { id: u64, money: Money }
pub const fn made() -> Point<'static, f64> { Point { x: 1.0, label: "}", next: None } }
fn range() { for i in 0..n { step(i); } }
"""


def got(text, language):
    nodes, refs = braces.read(text, language)
    return {(n["kind"], "::".join([*n["scope"], n["name"]])): n for n in nodes}, {(k, n, "::".join(s)) for k, n, s, _ in refs}


def test_typescript():
    n, r = got(TS, "typescript")
    assert set(n) == {
        ("constant", "re"), ("constant", "half"), ("constant", "text"), ("class", "Shape"), ("property", "Shape::size"), ("property", "Shape::count"), ("property", "Shape::#hidden"), ("property", "Shape::name"),
        ("method", "Shape::handler"), ("method", "Shape::constructor"), ("method", "Shape::value"), ("method", "Shape::area"), ("method", "Shape::load"), ("method", "Shape::overload"), ("function", "run"),
        ("function", "run::nested"), ("function", "arrow"), ("constant", "LIMIT"), ("variable", "counter"), ("type_alias", "Fn"), ("enum", "Level"), ("enum_member", "Level::Low"), ("enum_member", "Level::High"),
        ("enum_member", "Level::Mid"), ("function", "Deep::inside"), ("constant", "Deep::limit"), ("route", "GET /health/:id"), ("route", "POST /made"), ("function", "last"),
    }
    shape, size, load, run = n["class", "Shape"], n["property", "Shape::size"], n["method", "Shape::load"], n["function", "run"]
    assert shape["docstring"] == "Says who." and shape["is_exported"] and shape["is_abstract"] and (shape["start_line"], shape["end_line"]) == (11, 23)
    assert size["visibility"] == "private" and n["property", "Shape::#hidden"]["visibility"] == "private" and n["property", "Shape::count"]["is_static"]
    assert load["is_static"] and load["is_async"] and load["visibility"] == "public" and load["return_type"] == "AsyncGenerator<K>"
    assert run["docstring"] == "first line\nsecond line" and run["is_async"] and run["return_type"] == "Promise<Map<string, () => void>>" and (run["start_line"], run["end_line"]) == (27, 32)
    assert n["method", "Shape::handler"]["return_type"] == "Promise<void>" and n["method", "Shape::handler"]["is_async"] and n["function", "arrow"]["is_exported"]
    assert n["function", "last"]["is_exported"] and not n["variable", "counter"]["is_exported"]
    assert {x for x in r if x[0] == "imports"} == {("imports", p, "") for p in ("./a", "./react", "./re", "./all", "./req")}
    assert {x for x in r if x[0] in ("extends", "implements", "decorates", "function_ref")} == {
        ("extends", "mixin", "Shape"), ("implements", "Runs", "Shape"), ("implements", "pkg.Walks", "Shape"), ("decorates", "observed", "Shape"), ("function_ref", "healthHandler", "GET /health/:id"), ("function_ref", "maker", "POST /made"),
    }
    assert {x for x in r if x[0] == "instantiates"} == {("instantiates", "Map", "Shape"), ("instantiates", "Widget", "run")}
    calls = {x[1:] for x in r if x[0] == "calls"}
    assert {
        ("call", ""), ("run", "Shape::handler"), ("helper", "Shape::constructor"), ("compute", "Shape::value"), ("other", "Shape::load"), ("deep", "run"), ("go", "run"), ("far", "run::nested"), ("later", "arrow"),
    } <= calls
    assert not {c for c, _ in calls} & {"super", "if", "while", "for", "no", "require"}


def test_elements():
    n, r = got(TSX, "tsx")
    assert set(n) == {("function", "Card"), ("function", "After")} and n["function", "Card"]["end_line"] == 5
    assert {("calls", "useState", "Card"), ("calls", "handle", "Card"), ("calls", "label", "Card"), ("calls", "done", "After")} == r


def test_rust():
    n, r = got(RUST, "rust")
    assert set(n) == {
        ("class", "Point"), ("property", "Point::x"), ("property", "Point::label"), ("property", "Point::next"), ("class", "Pair"), ("enum", "Kind"), ("enum_member", "Kind::Plain"), ("enum_member", "Kind::Named"),
        ("enum_member", "Kind::Tuple"), ("interface", "Draw"), ("constant", "Draw::N"), ("method", "Draw::draw"), ("method", "Draw::twice"), ("method", "Point::draw"), ("namespace", "Outside"), ("method", "Outside::draw"),
        ("namespace", "admin"), ("function", "admin::check"), ("constant", "MAX"), ("variable", "FLAG"), ("class", "Order"), ("property", "Order::id"), ("property", "Order::money"), ("method", "Order::total"), ("function", "made"), ("function", "range"),
    }
    assert n["class", "Point"]["docstring"] == "A point.\nIn space." and n["class", "Point"]["is_exported"] and n["property", "Point::x"]["is_exported"] and not n["property", "Point::label"]["is_exported"]
    assert n["function", "admin::check"]["is_async"] and n["function", "admin::check"]["return_type"] == "Result<Token, Error>"
    assert {
        ("returns", "Money", "Order::total"), ("returns", "Result", "admin::check"), ("returns", "Point", "made"), ("type_of", "Option", "Point::next"), ("type_of", "Money", "Order::money"), ("implements", "Draw", "Point"),
        ("implements", "Draw", "Outside"), ("instantiates", "Token", "admin::check"), ("instantiates", "Point", "made"), ("calls", "shapes::paint", "Point::draw"), ("calls", "verify", "admin::check"), ("calls", "step", "range"),
        ("calls", "limit", ""), ("imports", "std::{fmt,io::{self as sio,Read}}", ""), ("calls", "price", "Order::total"),
    } <= r
    assert not {x for x in r if x[1] in ("no", "inner", "paint", "str")}


@pytest.mark.parametrize("language", ["typescript", "tsx", "rust"])
def test_any_text_is_read(language):
    whole = {"typescript": TS, "tsx": TSX, "rust": RUST}[language]
    for k in range(0, len(whole), 7):
        braces.read(whole[:k], language)
        braces.read(whole[k:], language)
    for text in ("", "{", "}", "`${", "<", "'", "/*", "class", "fn", "import", "export", "const x =", "a" * 5000, "((((" * 100, "<a>" * 200, "}" * 300, "\u2028\x00é"):
        braces.read(text, language)


def test_time_grows_with_the_file():
    def seconds(k):
        text = "".join(f"export class C{i} {{ m{i}(a: number) {{ return f{i}(a) / 2; }} }}\n" for i in range(k))
        began = time.process_time()
        assert len(braces.read(text, "typescript")[0]) == 2 * k
        return time.process_time() - began

    seconds(100)
    assert seconds(4000) < 20 * max(seconds(500), 0.01)


def test_leaves():
    assert [x for _, _, x in braces.leaves("let a = /}/; // b\nf(`x${1}`)", "typescript", extract.KEYWORDS)] == ["let", "identifier", "=", "regex", ";", "comment", "identifier", "(", "string", "string", "$", "{", "number", "}", "string", ")"]


def test_python_annotations():
    rows = extract.file_rows("a.py", "X: int = 3\ny: str = f()\nclass A:\n    z: str\n    w: int = 1\n    def f(self) -> dict[str, int]:\n        v: int = g()\n", "python")
    n = {(r[2], "::".join([*r[4], r[3]])): r for r in rows if r[1] == "node"}
    assert set(n) == {("file", "a.py"), ("constant", "X"), ("variable", "y"), ("class", "A"), ("property", "A::z"), ("property", "A::w"), ("method", "A::f")}
    assert n["method", "A::f"][extract.FIELDS.index("return_type")] == "dict[str, int]"
    assert {(r[11], "::".join(r[4])) for r in rows if r[1] == "ref" and r[2] == "calls"} == {("f", ""), ("g", "A::f")}
