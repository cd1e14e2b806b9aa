from __future__ import annotations

import random

from siftstone.operators import scripts

SOURCE = r'''// function commented() {}
import { a } from "./a";
/* class Hidden { run() {} } */
/** Adds. */
export async function load<T>(url: string, { deep, more } = {}, ...rest: T[]): Promise<{ ok: boolean }> {
  const text = `function inTemplate() { ${call(`x${inner(1)}`)} }`;
  const re = /function fake\(\) \{[/"]/g, half = total / 2 / other;
  if (url && text || re) { return fetch(url)?.json(); }
  return helper.parse(text) ?? [];
}
const LIMIT = 10;
export const add = (x, y = 2) => x + twice(y)
const one = async z => { await wait(z); };
let plain = 'class No { }';
@Component({ name: "x" })
export default class Shop extends base.Store<Item> implements Open {
  #secret = 1;
  private count: number = 0;
  static async open(where?: string): Promise<void> { for (const x of where) { super.open(x); } }
  get size() { return this.items.length ? 1 : 0 }
  handle = (e: Event) => { this.emit(e) }
  constructor(items = []) { super(); this.items = new Map<string, number>(items); }
  abstract later(): void;
  'quoted name'() { return "}" }
  *walk() { yield* this.items }
}
function last(cb) { return cb(() => { nested() }) }
'''


def found():
    return {u["id"].removeprefix("s.ts::"): u for u in scripts.units_of("s.ts", SOURCE)}


def test_units_of_a_script():
    got = found()
    kinds = {k: u["type"] for k, u in got.items()}
    assert kinds == {"load": "async_function", "LIMIT": "constant", "add": "function", "one": "async_function", "Shop": "class", "Shop.open": "method", "Shop.size": "property", "Shop.handle": "method",
                     "Shop.constructor": "method", "Shop.quoted name": "method", "Shop.walk": "method", "last": "function"}
    load = got["load"]
    assert load["calls"] == ["call", "fetch", "inner", "json", "parse"] and load["docstring"] == "Adds." and (load["start_line"], load["end_line"]) == (5, 10)
    assert load["parameters"] == ["url: string", "{ deep, more} = ...".replace("{ ", "{"), "...rest: T[]"] and load["complexity"] == 5
    assert got["add"]["parameters"] == ["x", "y = ..."] and got["add"]["calls"] == ["twice"] and got["add"]["end_line"] == 12
    assert got["one"]["parameters"] == ["z"] and got["one"]["calls"] == ["wait"]
    assert got["Shop"]["bases"] == ["base.Store"] and got["Shop"]["decorators"] == ["Component"] and (got["Shop"]["start_line"], got["Shop"]["end_line"]) == (15, 26)
    assert got["Shop.size"]["complexity"] == 2 and got["Shop.handle"]["calls"] == ["emit"] and got["Shop.constructor"]["calls"] == ["Map"]
    assert got["last"]["calls"] == ["cb", "nested"]


def test_anything_ends_and_texts_hide_code():
    rng = random.Random(1)
    parts = ["function f(", "{", "}", "`${", "`", "class A ", "/x/", "/*", "*/", "'", '"', "=>", "(", ")", "=", "const a", "<", ">", "\n", "[", "]", "@x", ";", "async ", "get "]
    for _ in range(3000):
        scripts.units_of("x.js", "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
    assert scripts.units_of("x.js", "") == [] == scripts.units_of("x.js", "`class A {}`; /class B {}/; 'function c() {}'")
    assert "".join(t.text for t in scripts.lex("a / b / c")) == "a/b/c"


def test_as_a_table(spark):
    df = spark.createDataFrame([("s.ts", SOURCE), ("none.js", None)], "path string, source string")
    rows = scripts.parse_scripts(df).collect()
    assert {r.id for r in rows} == {f"s.ts::{k}" for k in found()}
