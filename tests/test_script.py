"""Hand-marked script files."""

from kairoscope.sources.script import parse_script

MARKED = r'''
import def, { a as b } from "./one";
import './side';
import type { T } from '../types';
export { x } from "./two";
export * from './three';
const lazy = () => import('./four');
const fs = require("fs"), path = require('path');
// function ghost() { no(); }
/* class Ghost { m() {} } */
const text = "function alsoGhost() { no(); }";
const pattern = /function rx\(\) { no(); }/g;
const half = total / 2; function afterDivision() { yes(half / 2); }
export default class Store extends Base {
  static count = 0;
  constructor(size) { super(size); this.init(size); }
  async load(id, opts = makeDefault()) {
    const inner = (x) => { innerCall(x); };
    items.map((y) => hiddenCall(y));
    function nested() { nestedCall(); }
    if (id) { await this.fetchOne(id); }
    return new Thing(`text ${templateCall(`deep ${deepCall()}`)} function no() {}`);
  }
  get value() { return read(); }
  private static helper<T>(a: T): Promise<Map<string, T>> { return wrap(a); }
}
abstract class Typed { abstract m(): void; run(): { a: number } { return go(); } }
export async function main(argv: string[]): Promise<void> {
  for (const a of argv) { step(a); step(a); }
  api.client.send(argv);
}
export const handler = async (event: Event): Promise<boolean> => {
  return check(event);
};
const generic = <T>(value: T) => identity(value)
next(generic)
let old = function named() { oldCall(); }, other = x => otherCall(x);
const typed: (a: number) => void = (a) => { typedCall(a); };
const object = { method() { objectCall(); }, arrow: () => { arrowCall(); }, plain: 1 };
use(function () { anonymous(); });
'''


def test_marked_file():
    rows = parse_script(MARKED)
    of = lambda kind: [r for r in rows if r[0] == kind]
    assert [r[1] for r in of("import")] == ["./one", "./side", "../types", "./two", "./three", "./four", "fs", "path"]
    assert [r[1] for r in of("class")] == ["Store", "Typed"]
    calls = {r[2]: r[6] for r in of("function")}
    assert calls == {
        "lazy": [],
        "afterDivision": ["yes"],
        "Store.constructor": ["init"],
        "Store.load": ["makeDefault", "map", "fetchOne", "templateCall", "deepCall"],
        "inner": ["innerCall"],
        "nested": ["nestedCall"],
        "Store.value": ["read"],
        "Store.helper": ["wrap"],
        "Typed.run": ["go"],
        "main": ["step", "send"],
        "handler": ["check"],
        "generic": ["identity"],
        "old": ["oldCall"],
        "other": ["otherCall"],
        "typed": ["typedCall"],
        "method": ["objectCall"],
    }
    lines = MARKED.split("\n")
    assert all(lines[r[4] - 1][r[5] :].lstrip("'\"").startswith(r[1]) for r in rows)


def test_broken_and_empty_text():
    assert parse_script("") == [] == parse_script("// only a comment")
    assert [r[1] for r in parse_script("function a() { b(; `${")] == ["a"]
    assert [r[1:3] for r in parse_script('const s = "open\nfunction f() {}')] == [("f", "f")]
    for text in ("}}}", "((((", "class", "function", "const x =", "import", "export", "`", "/", "a => ", "class A { m( }", "${"):
        assert isinstance(parse_script(text), list)
    assert [r[2] for r in parse_script("function f() { a(); }\nfunction f() { b(); }")] == ["f"]
