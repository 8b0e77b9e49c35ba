"""Structure of scripts, whole texts, manifests and catalogues."""

from pyspark.sql import functions as F

from quarryline.operators import scripts as J
from quarryline.operators import summary as P
from quarryline.operators.chunkers import whole_texts

JS = """import React, { useState as state, useRef } from 'react';
import * as path from "node:path";
import './side.css';
const fs = require('fs');

export default class Cart extends Base {
  static rate = 0.2;
  items = [];
  constructor(a) { super(a); }
  get total() { return this.sum(); }
  async add(item, ...more) {
    const line = { item };
    this.items.push(line);
    log(item);
    return compute(item.price, 2);
  }
  static of(x) { return new Cart(x); }
}

function compute(price, n = 1) {
  let out = price * n, label = 'x', list = [1], open = true, other = price;
  helper(out);
  return out;
}
async function* walk({ a }, [b]) {}
const helper = async (v) => { console.log(v); };
const twice = x => compute(x) * 2;
const old = function named(a, b) { helper(a); };
items.map(function () { compute(1); });
"""
TS = "abstract class Store<T> extends Base.Inner implements A, B<T> {\n  private readonly rows: Map<string, T> = new Map();\n  find(key: string, n?: number): { a: T } | undefined { return this.rows.get(key); }\n  abstract save(x: T): void;\n}\nexport const run = async <T,>(a: T): Promise<T> => a;\n"


def structure(text, language):
    return J.Script(text, language).run()


def names(rows, kind):
    return [r[1] for r in rows if r[0] == kind]


def test_javascript():
    rows = structure(JS, "javascript")
    assert {(r[1], r[2], r[4]) for r in rows if r[0] == "import"} == {("React", "default", "react"), ("state", "named", "react"), ("useRef", "named", "react"), ("path", "namespace", "node:path"), ("", "effect", "./side.css"), ("", "commonjs", "fs")}
    assert {(r[1], r[2], tuple(r[6]), tuple(r[7])) for r in rows if r[0] == "function"} == {
        ("compute", "declaration", ("price", "n"), ()), ("walk", "declaration", ("unknown", "unknown"), ("async", "generator")), ("helper", "arrow", ("v",), ("async",)), ("twice", "arrow", ("x",), ()), ("old", "expression", ("a", "b"), ()),
    }
    assert {(r[1], r[2], r[4]) for r in rows if r[0] in ("method", "property")} == {("rate", "static", "Cart"), ("items", "instance", "Cart"), ("total", "get", "Cart"), ("add", "method", "Cart"), ("of", "method", "Cart")}
    assert [(r[1], r[4]) for r in rows if r[0] == "inheritance"] == [("Cart", "Base")]
    calls = {(r[3], r[1]) for r in rows if r[0] == "call"}
    assert {("add", "log"), ("add", "compute"), ("compute", "helper"), ("helper", "console.log"), ("twice", "compute"), ("old", "helper"), ("anonymous", "compute"), ("add", "member.expression"), ("global", "items.map")} <= calls
    assert not {n for _, n in calls} & {"Cart", "add", "constructor"}
    types = {r[1]: r[2] for r in rows if r[0] == "variable" and r[3] in ("compute", "global")}
    assert types == {"fs": "any", "helper": "function", "twice": "function", "old": "function", "out": "any", "label": "string", "list": "array", "open": "boolean", "other": "unknown"}
    assert next(r[5] for r in rows if r[1] == "compute" and r[0] == "function") == JS[: JS.index("function compute")].count("\n") + 1


def test_typescript_and_odd_texts(spark):
    rows = structure(TS, "typescript")
    assert [(r[1], r[4], r[6]) for r in rows if r[0] == "class"] == [("Store", "Expression", ["A", "B"])]
    assert set(names(rows, "method")) == {"find", "save"} and names(rows, "property") == ["rows"] and names(rows, "function") == ["run"]
    for text in ("", "class", "function", "const", "import", "class A {", "x => ", "function (", "const a = ", "a(", "class A { b", "import {", "}" * 3, "let a = b, c"):
        structure(text, "javascript"), structure(text, "typescript")
    table = spark.createDataFrame([("a", JS, "javascript", 1), ("b", None, "javascript", 1), ("c", JS, "python", 1), ("d", "", "typescript", 1)], "key string, text string, language string, line int")
    got = J.script_structure(table, "key", "text", "language")
    assert {r.key for r in got.collect()} == {"a"}
    assert {(r.caller, r.callee) for r in J.resolved_calls(got).collect()} == {("add", "compute"), ("compute", "helper"), ("twice", "compute"), ("old", "helper"), ("anonymous", "compute")}
    assert J.script_structure(table.limit(0), "key", "text", "language").count() == 0


def test_whole_texts(spark):
    text = [f"l{i}" for i in range(1, 13)]
    piece = lambda a, b: (1, a, b, "\n".join(text[a - 1 : b]))
    rows = [piece(1, 5), piece(4, 9), piece(4, 9), piece(6, 8), piece(10, 12), (2, 1, 1, None), (2, 2, 2, "x"), (3, None, None, "alone\n"), (4, 1, 2, "a\n"), (4, 3, 3, "b")]
    got = {r.f: r.text for r in whole_texts(spark.createDataFrame(rows, "f int, start_line int, end_line int, content string"), "f").collect()}
    assert got == {1: "\n".join(text), 3: "alone\n", 4: "a\n\nb"}


def test_manifests_and_contents(spark):
    rows = [("a", "x/package.json", '{"dependencies": null, "scripts": {"t": "jest"}}'), ("a", "requirements.txt", ""), ("a", "pom.xml", None), ("b", "Cargo.toml", "no section"), (None, "requirements.txt", "numpy\n")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    assert {(r.repo, r.name, r.version) for r in P.dependencies(df, "repo", "path", "text").collect()} == {(None, "numpy", None)}
    assert {(r.repo, r.technology) for r in P.dependency_technologies(df, "repo", "path", "text").collect()} == {("a", "jest"), (None, "numpy")}
    texts = spark.createDataFrame([("a", "import React from 'react'"), ("a", "react.createElement"), ("b", None)], "repo string, text string")
    found = {r.technology: r.detections for r in P.content_technologies(texts, "repo", "text").where(F.col("repo") == "a").collect()}
    assert found["react"] == 2  # the cased pattern does not count the second text
    assert len(P.CONTENT_TECHNOLOGIES) == 32
