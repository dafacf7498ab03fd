"""Facts from tokens: one small file per language, and files cut off anywhere."""

from __future__ import annotations

import pytest

from factloom.sources.lexical import LexicalFacts

SOURCES = {
    "go": 'package shop\n\nimport (\n\t"fmt"\n\tio2 "io"\n)\n\ntype Cart struct {\n\tBase\n\tItems []string\n\tn int\n}\n\ntype Pricer interface {\n\tPrice(x int) float64\n}\n\ntype ID = string\n\nconst Max = 3\n\nvar (\n\ta = 1\n\tB string\n)\n\nfunc (c *Cart) Price(x int, y string) float64 {\n\ttotal := fmt.Sum(c.Items)\n\tif total > 1 {\n\t\treturn helper(total)\n\t}\n\treturn 0\n}\n\nfunc helper(t int) int { return t }\n',
    "typescript": 'import Def, { a, b as c } from "./m";\nimport * as ns from "n";\nimport "side";\nexport { z } from "./z";\n\n@Injectable()\nexport class Cart extends Base implements Pricer {\n  private items: string[] = [];\n  constructor(n: number) { super(n); }\n  public price(x: number): number {\n    const t = this.items.length;\n    return helper(t);\n  }\n}\nexport interface Pricer {\n  name: string;\n  price(x: number): number;\n}\nexport type Id = string;\nexport enum Color { Red, Green = 2 }\nnamespace N { export function f(a?: string) { return 1 } }\nexport const K = 3;\nlet v = (q) => { return q }\nexport abstract class Z<T> { abstract go(): void }\n',
    "javascript": 'const fs = require("fs");\nimport x from "y";\nexport function f(a, b = 1) {\n  if (a) { g(b.c) }\n}\nclass A extends B {\n  size = 1;\n  run(z) { return z }\n}\n',
    "rust": "use std::{io, fmt::{self, Write as W}};\nuse a::b::*;\n\n#[derive(Debug)]\npub struct Cart<T> {\n    pub items: Vec<T>,\n    n: u32,\n}\npub enum Color { Red, Green(u8) }\npub trait Pricer { fn price(&self, x: u32) -> f64; }\nimpl Pricer for Cart {\n    fn price(&self, x: u32) -> f64 { let c = 'a'; helper(self.n) }\n}\nfn helper<'a>(t: &'a str) -> f64 { 0.0 }\nmod inner { pub const K: u32 = 1; }\npub type Id = String;\nstatic S: u8 = 1;\nmacro_rules! mac { () => {} }\n",
    "c": '#include <stdio.h>\n#define MAX 3\n#define SQ(x) ((x)*(x))\nstruct point { int x; int y; };\ntypedef unsigned long word;\nenum color { RED, GREEN = 2 };\nint add(int a, const char *b);\nstatic int total = 0;\nint add(int a, const char *b) {\n  struct point p;\n  for (;;) { total += a; }\n  return p.x + other(a);\n}\n',
    "cpp": '#include "a.h"\nusing namespace std;\nnamespace shop {\ntemplate <typename T>\nclass Cart : public Base {\n  int n;\npublic:\n  Cart();\n  virtual double price(int x) const { return helper(x); }\n  std::string name;\n};\nenum class Color { Red, Green };\ndouble Cart::total(int y) { return n; }\n}\n',
    "java": 'package a.b;\nimport java.util.List;\nimport static a.B.c;\n@Service\npublic class Cart extends Base implements Pricer {\n  private static final int MAX = 3;\n  protected List<String> items;\n  public Cart(int n) { this.n = n; }\n  @Override\n  public double price(int x, String y) throws E { return helper(x).y; }\n  enum Color { RED, GREEN }\n}\ninterface Pricer { double price(int x); }\n',
    "php": '<?php\nnamespace App\\Shop;\nuse App\\Base;\nuse X\\Y as Z;\nrequire "a.php";\nconst K = 1;\ninterface Pricer { public function price($x); }\ntrait T { }\nfinal class Cart extends Base implements Pricer {\n  use T;\n  const MAX = 3;\n  private array $items = [];\n  public function price(int $x): float { return helper($x); }\n}\nfunction helper($t) { if ($t) { return new Cart(); } }\n',
    "ruby": 'require "json"\nrequire_relative "./x"\nmodule Shop\n  class Cart < Base\n    include Enumerable\n    MAX = 3\n    attr_reader :items, :n\n    def price(x, y = 1)\n      if x\n        helper(x)\n      end\n      items.each do |i|\n        puts i\n      end\n    end\n    private\n    def secret\n      while true do\n      end\n      x = 1 if y\n    end\n  end\nend\ndef helper(t)\nend\n',
}
#: symbols, members, imports that each file must give, all of them.
WANTED = {
    "go": (
        [('B', 'variable', 'public'), ('Cart', 'struct', 'public'), ('ID', 'type_alias', 'public'), ('Max', 'constant', 'public'), ('Price', 'method', 'public'), ('Pricer', 'interface', 'public'), ('a', 'variable', 'private'), ('helper', 'function', 'private'), ('shop', 'package', 'private'), ('total', 'variable', 'private')],
        [('Base', 'embedded', 'public'), ('Items', 'field', 'public'), ('Price', 'method', 'public'), ('Price', 'method', 'public'), ('n', 'field', 'private')],
        [('fmt', 'module', ''), ('io', 'module', 'io2')],
    ),
    "typescript": (
        [('Cart', 'class', 'public'), ('Color', 'enum', 'public'), ('Id', 'type_alias', 'public'), ('K', 'constant', 'public'), ('N', 'namespace', 'public'), ('Pricer', 'interface', 'public'), ('Z', 'class', 'public'), ('constructor', 'method', 'public'), ('f', 'function', 'public'), ('price', 'method', 'public'), ('price', 'method', 'public'), ('t', 'constant', 'public'), ('v', 'function', 'public')],
        [('Base', 'base_class', 'public'), ('Green', 'variant', 'public'), ('Pricer', 'base_class', 'public'), ('Red', 'variant', 'public'), ('constructor', 'method', 'public'), ('items', 'property', 'private'), ('name', 'property', 'public'), ('price', 'method', 'public'), ('price', 'method', 'public')],
        [('./m', 'default', 'Def'), ('./m', 'named', 'a:'), ('./m', 'named', 'b:c'), ('./z', 'reexport', '{z}'), ('n', 'namespace', 'ns'), ('side', 'side_effect', '')],
    ),
    "javascript": (
        [('A', 'class', 'private'), ('f', 'function', 'public'), ('fs', 'constant', 'private'), ('run', 'method', 'private')],
        [('B', 'base_class', 'public'), ('run', 'method', 'private'), ('size', 'property', 'private')],
        [('fs', 'require', 'fs'), ('y', 'default', 'x')],
    ),
    "rust": (
        [('Cart', 'struct', 'public'), ('Color', 'enum', 'public'), ('Id', 'type_alias', 'public'), ('K', 'constant', 'public'), ('Pricer', 'trait', 'public'), ('S', 'variable', 'private'), ('helper', 'function', 'private'), ('inner', 'module', 'private'), ('mac', 'function', 'private'), ('price', 'method', 'private'), ('price', 'method', 'private')],
        [('Green', 'variant', 'public'), ('Red', 'variant', 'public'), ('items', 'field', 'public'), ('n', 'field', 'private'), ('price', 'method', 'private'), ('price', 'method', 'private')],
        [('a::b::*', 'wildcard', ''), ('std::fmt::Write', 'module', 'W'), ('std::fmt::self', 'module', ''), ('std::io', 'module', '')],
    ),
    "c": (
        [('GREEN', 'constant', 'public'), ('MAX', 'constant', 'public'), ('RED', 'constant', 'public'), ('SQ', 'function', 'public'), ('add', 'function', 'public'), ('add', 'function', 'public'), ('color', 'enum', 'public'), ('p', 'variable', 'public'), ('point', 'struct', 'public'), ('total', 'variable', 'public'), ('word', 'type_alias', 'public')],
        [('GREEN', 'variant', 'public'), ('RED', 'variant', 'public'), ('x', 'field', 'public'), ('y', 'field', 'public')],
        [('stdio.h', 'header', '')],
    ),
    "cpp": (
        [('Cart', 'class', 'public'), ('Cart', 'method', 'public'), ('Color', 'enum', 'public'), ('price', 'method', 'public'), ('shop', 'namespace', 'public'), ('total', 'method', 'public')],
        [('Base', 'embedded', 'public'), ('Cart', 'method', 'public'), ('Green', 'variant', 'public'), ('Red', 'variant', 'public'), ('n', 'field', 'private'), ('name', 'field', 'public'), ('price', 'method', 'public')],
        [('a.h', 'header', ''), ('std', 'namespace', '')],
    ),
    "java": (
        [('Cart', 'class', 'public'), ('Cart', 'constructor', 'public'), ('Color', 'enum', 'package'), ('MAX', 'constant', 'private'), ('Pricer', 'interface', 'package'), ('a.b', 'package', 'package'), ('price', 'method', 'public'), ('price', 'method', 'public')],
        [('Base', 'base_class', 'public'), ('Cart', 'constructor', 'public'), ('GREEN', 'variant', 'public'), ('MAX', 'constant', 'private'), ('Pricer', 'base_class', 'public'), ('RED', 'variant', 'public'), ('items', 'field', 'protected'), ('price', 'method', 'public'), ('price', 'method', 'public')],
        [('a.B.c', 'static', ''), ('java.util.List', 'module', '')],
    ),
    "php": (
        [('App\\Shop', 'namespace', 'public'), ('Cart', 'class', 'public'), ('K', 'constant', 'public'), ('Pricer', 'interface', 'public'), ('T', 'trait', 'public'), ('helper', 'function', 'public'), ('price', 'method', 'public'), ('price', 'method', 'public')],
        [('Base', 'base_class', 'public'), ('MAX', 'constant', 'public'), ('Pricer', 'base_class', 'public'), ('T', 'embedded', 'public'), ('items', 'property', 'private'), ('price', 'method', 'public'), ('price', 'method', 'public')],
        [('App\\Base', 'type', ''), ('X\\Y', 'type', 'Z'), ('a.php', 'file', '')],
    ),
    "ruby": (
        [('Cart', 'class', 'public'), ('Shop', 'module', 'public'), ('helper', 'function', 'public'), ('price', 'method', 'public'), ('secret', 'method', 'private')],
        [('Base', 'base_class', 'public'), ('Enumerable', 'embedded', 'public'), ('MAX', 'constant', 'public'), ('items', 'property', 'public'), ('n', 'property', 'public')],
        [('./x', 'relative', ''), ('json', 'module', '')],
    ),
}


def facts(language, text):
    return LexicalFacts("p", text, language).rows


@pytest.mark.parametrize("language", SOURCES)
def test_declarations(language):
    rows = facts(language, SOURCES[language])
    for fact, want in zip(("symbol", "member", "import"), WANTED[language], strict=True):
        assert sorted((r[2], r[3], r[5] if fact == "import" else r[5].partition(":")[0]) for r in rows if r[0] == fact) == want
    assert len({r[1] for r in rows}) == len(rows)
    scopes = {r[1] for r in rows if r[0] == "scope"}
    assert all(r[4] in scopes for r in rows if r[0] == "reference")
    assert ("helper", "call") in {(r[2], r[3]) for r in rows if r[0] == "reference"} or language in ("javascript", "c")


@pytest.mark.parametrize("language", SOURCES)
def test_files_cut_off_anywhere(language):
    text = SOURCES[language]
    for k in range(0, len(text) + 1, 3):
        for part in (text[:k], text[k:]):
            assert all(r[6:8] <= r[8:10] for r in facts(language, part))


def test_methods_before_their_type():
    rows = facts("go", "package a\nfunc (c *T) F() {}\ntype T struct {\n}\n")
    held = next(r[1] for r in rows if r[2] == "T" and r[0] == "symbol")
    assert {r[0] for r in rows if r[2] == "F" and r[4] == held} == {"symbol", "member"}


def test_brackets_in_strings_and_remarks_do_not_nest():
    rows = facts("java", 'class A { String s = "{"; // {\n /* { */ int f() { return 1; } }\nclass B { }\n')
    assert {(r[2], r[4] is None) for r in rows if r[0] == "symbol"} == {("A", True), ("f", False), ("B", True)}


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("go", "package a\nfunc Map[T, U any, V ~int](x []T) U { }\ntype P[T any] struct {\n}\ntype Q [4]int\n", [("T", "type", "0:any"), ("U", "type", "1:any"), ("V", "type", "2:~int"), ("T", "type", "0:any")]),
        ("java", "class A<T extends B<T>, U> {\n  <V> V f(V v) { return v; }\n}\n", [("T", "type", "0:extends B<T>"), ("U", "type", "1:"), ("V", "type", "0:")]),
        ("rust", "struct A<'a, T: Copy + Clone, const N: usize> { x: &'a T }\nfn f<F: Fn(i32) -> i32>(g: F) { }\n", [("'a", "lifetime", "0:"), ("T", "type", "1:Copy + Clone"), ("N", "value", "2:usize"), ("F", "type", "0:Fn(i32) -> i32")]),
        ("cpp", "template <typename T, int N = 3>\nclass A { };\ntemplate <class U> U f(U u) { return u; }\n", [("T", "type", "0:"), ("N", "value", "1:"), ("U", "type", "0:")]),
        ("typescript", "function f<T extends X = Y>(a: T[]): T { return a[0] }\nconst g = <U>(a: U): U => a;\n", [("T", "type", "0:X"), ("U", "type", "0:")]),
    ],
)
def test_type_parameters(language, text, want):
    assert sorted((r[2], r[3], r[5]) for r in facts(language, text) if r[0] == "type_parameter") == sorted(want)


def test_parameters_and_returns():
    rows = facts("go", "package a\nfunc (s *T) F(a, b int, c ...string) (x, y int, err error) { }\nfunc G(int, string) ([]byte, error) { }\n")
    got = {(r[2], r[3], r[5]) for r in rows if r[0] == "parameter"}
    assert got >= {("s", "receiver", "0:*T"), ("a", "parameter", "0:int"), ("b", "parameter", "1:int"), ("x", "return", "0:int"), ("y", "return", "1:int"), ("err", "return", "2:error"), ("", "return", "0:[]byte"), ("", "return", "1:error")}


def test_functions_held_by_constants():
    rows = facts("javascript", "const f = (a, b) => a + b;\nconst g = async x => { return f(x) };\nconst h = function (q) { };\nconst n = (1 + 2);\nconst m = list.map(x => x);\n")
    assert {(r[2], r[3]) for r in rows if r[0] == "symbol"} == {("f", "function"), ("g", "function"), ("h", "function"), ("n", "constant"), ("m", "constant")}
    assert sorted(r[2] for r in rows if r[0] == "parameter") == ["a", "b", "q", "x"]
